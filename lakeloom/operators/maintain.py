"""Aggregates kept up to date from signed changes.

A change adds its rows to sums and counts or takes them away, so groups that nothing changed are neither read nor written. A
minimum or maximum can only move outwards when rows come; when the row at the edge goes, the edge is found anew from the rows of
that group alone.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.sources.lake import committed

ROWS = "_rows"


@dataclass(frozen=True)
class Measures:
    """What is kept of each group `by`: sums of whole numbers, counts of non-null values, and edges (`min` or `max`, column), each under its
    own name. The number of rows is kept as `_rows`, and that of the values of a sum as `_n_<name>`."""

    by: tuple[str, ...]
    sums: Mapping[str, Column | str] = field(default_factory=dict)
    counts: Mapping[str, Column | str] = field(default_factory=dict)
    edges: Mapping[str, tuple[str, str]] = field(default_factory=dict)

    def kept(self) -> list[str]:
        return [ROWS, *self.sums, *[f"_n_{name}" for name in self.sums], *self.counts]


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _totals(measures: Measures, sign: Column) -> list[Column]:
    """Sums and counts, each row taken `sign` times."""
    out = [F.sum(sign).alias(ROWS)]
    for name, value in measures.sums.items():
        out += [F.coalesce(F.sum(_column(value).cast("bigint") * sign), F.lit(0)).alias(name),
                F.sum(F.when(_column(value).isNotNull(), sign).otherwise(F.lit(0))).alias(f"_n_{name}")]
    out += [F.sum(F.when(_column(value).isNotNull(), sign).otherwise(F.lit(0))).alias(name)
            for name, value in measures.counts.items()]
    return out


def _edges(measures: Measures, when: Column | None = None, prefix: str = "") -> list[Column]:
    pick = {"min": F.min, "max": F.max}
    return [pick[how](_column(value) if when is None else F.when(when, _column(value))).alias(f"{prefix}{name}")
            for name, (how, value) in measures.edges.items()]


def aggregate(rows: DataFrame, measures: Measures) -> DataFrame:
    """The state of all rows: one row per group."""
    return rows.groupBy(*measures.by).agg(*_totals(measures, F.lit(1).cast("bigint")), *_edges(measures))


def result(state: DataFrame, measures: Measures) -> DataFrame:
    """The aggregates as a query over the rows gives them: a sum without any value is null."""
    return state.select(*measures.by, *[F.when(F.col(f"_n_{name}") > 0, F.col(name)).alias(name) for name in measures.sums],
                        *measures.counts, *measures.edges)


def totals(rows: DataFrame, measures: Measures) -> DataFrame:
    """The aggregates of all rows, without a state to maintain: a sum without any value is null."""
    return rows.groupBy(*measures.by).agg(
        *[F.sum(_column(value).cast("bigint")).alias(name) for name, value in measures.sums.items()],
        *[F.count(_column(value)).alias(name) for name, value in measures.counts.items()], *_edges(measures))


def signed_totals(signed: DataFrame, measures: Measures) -> DataFrame:
    """What signed rows change: sums and counts by difference, and the edges of the rows that come (`_in_`) and go (`_out_`)."""
    sign = F.col("sign").cast("bigint")
    return signed.groupBy(*measures.by).agg(
        *_totals(measures, sign), *_edges(measures, sign > 0, "_in_"), *_edges(measures, sign < 0, "_out_"))


def maintained(state: DataFrame | None, changes: DataFrame, rows: DataFrame | Callable[[DataFrame], DataFrame], measures: Measures,
               along: Sequence[str] = ()) -> DataFrame:
    """The groups of `state` and of `changes` (`signed_totals`) after the changes, a group without rows left out.

    `rows` are the rows as they are after the changes, or a function that finds those of some groups (a table of their keys); it is read
    only for groups an edge of which went. Groups keep null keys apart from others, as GROUP BY does. Both sides meet in one shuffle, by
    the columns `along` if there are any: columns of both that follow from the group. They are kept, and without edges the
    rows stay together by them.
    """
    by, kept, edges = [*along, *measures.by], measures.kept(), list(measures.edges)
    came, went = [f"_in_{name}" for name in edges], [f"_out_{name}" for name in edges]
    kinds = dict(changes.dtypes)
    none = [F.lit(None).cast(kinds[f"_in_{name}"]) for name in edges]
    both = changes.select(*by, *kept, *[value.alias(name) for value, name in zip(none, edges)], *came, *went)
    if state is not None:
        both = state.select(*by, *kept, *edges, *[value.alias(name) for value, name in zip([*none, *none], [*came, *went])]).unionByName(both)
    if along:
        both = both.repartition(*along)
    summed = both.groupBy(*by).agg(*[F.sum(name).alias(name) for name in kept],
                                   *[F.max(name).alias(name) for name in (*edges, *came, *went)]).filter(F.col(ROWS) > 0)
    if not edges:
        return summed
    outwards = {"min": F.least, "max": F.greatest}
    # An edge that goes is known again if a row comes that is as far out, as one does that is updated.
    lost = F.lit(False)
    for name, (how, _) in measures.edges.items():
        as_far = F.col(f"_in_{name}") <= F.col(name) if how == "min" else F.col(f"_in_{name}") >= F.col(name)
        lost = lost | F.coalesce((F.col(f"_out_{name}") == F.col(name)) & ~F.coalesce(as_far, F.lit(False)), F.lit(False))
    # Read for the groups that lost an edge, and for the others.
    staged = committed(summed.select(
        *by, *kept, *[outwards[how](F.col(name), F.col(f"_in_{name}")).alias(name) for name, (how, _) in measures.edges.items()],
        lost.alias("_lost")), "staged")
    columns, gone = [*by, *kept, *edges], staged.filter("_lost")
    groups = gone.select(*[F.col(name).alias(f"_{name}") for name in measures.by])
    match = F.lit(True)
    for name in measures.by:
        match = match & F.col(name).eqNullSafe(F.col(f"_{name}"))
    live = rows(gone.select(*measures.by)) if callable(rows) else rows
    again = live.join(groups, match, "left_semi").groupBy(*measures.by).agg(*_edges(measures))
    found = again.select(*[F.col(name).alias(f"_{name}") for name in measures.by], *[F.col(name).alias(f"_new_{name}") for name in edges])
    mended = gone.join(found, match, "left").select(*by, *kept, *[F.col(f"_new_{name}").alias(name) for name in edges])
    return staged.filter("NOT _lost").select(*columns).unionByName(mended)
