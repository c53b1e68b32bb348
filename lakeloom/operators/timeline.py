"""Operators along the timeline of a key: the neighbouring event, and the event in force at a time.

Both run a window per key. A hot key is cut into slices of its timeline (see `skew.cut_hot`); within a slice the window runs as
usual, and a second window over one row per key and slice carries the missing neighbour across slice borders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.operators.skew import TASK_ROWS, cut_hot


def with_neighbour(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str], forward: bool = True,
                   task_rows: int = TASK_ROWS, examine: DataFrame | None = None) -> DataFrame:
    """Add values of the following (or, with `forward=False`, preceding) row of the key; null where there is none.

    `columns` maps a new column to the column it is taken from. `order` is unique within a key.
    `examine` is where hot keys are looked for, if not in `df` (see `cut_hot`); it has the key columns.
    """
    step = F.lead if forward else F.lag
    row = F.struct(*[F.col(source).alias(name) for name, source in columns.items()])

    def moved(rows: DataFrame, *group: str) -> DataFrame:
        return rows.withColumn("_near", step(row).over(Window.partitionBy(*group).orderBy(*order)))

    cut = cut_hot(df, keys, order, task_rows, examine)
    if cut is None:
        near = moved(df, *keys)
    else:
        cold, hot = cut
        edge_of = F.min_by if forward else F.max_by
        edges = hot.groupBy(*keys, "_slice").agg(edge_of(row, F.struct(*order)).alias("_edge"))
        across = Window.partitionBy(*keys).orderBy("_slice")
        edges = edges.select(*keys, "_slice", step("_edge").over(across).alias("_across"))
        inside = moved(hot, *keys, "_slice").join(edges, [*keys, "_slice"])
        inside = inside.withColumn("_near", F.coalesce("_near", "_across")).drop("_slice", "_across")
        near = moved(cold, *keys).unionByName(inside)
    return near.select(*df.columns, *[F.col(f"_near.{name}").alias(name) for name in columns])


def as_of(facts: DataFrame, history: DataFrame, keys: list[str], time: str, since: str, until: str,
          columns: list[str], task_rows: int = TASK_ROWS) -> DataFrame:
    """Facts with `columns` of the history row in force at their time: `since <= time < until`, open end if null.

    The intervals of a key do not overlap, so there is at most one match; facts without one are dropped. Key columns
    have the same names on both sides and, like the times, are not null. Facts and history rows are sorted together and
    the latest history row is carried forward: the work is linear in both, where a range join would compare all facts
    of a key with all its versions.
    """
    payload = [name for name in facts.columns if name not in (*keys, time)]
    carried = F.struct(*columns, F.col(until).alias("_until"))
    events = history.select(*keys, F.col(since).alias(time), F.lit(0).alias("_kind"), carried.alias("_row"))
    marked = facts.select(*keys, time, F.lit(1).alias("_kind"), F.struct(F.lit(True).alias("_is"), *payload).alias("_fact"))
    both = marked.unionByName(events, allowMissingColumns=True)

    # Among versions that start together, only the one that ends last has any extent.
    order = [F.col(time), F.col("_kind"), F.col("_row._until").asc_nulls_last()]

    def filled(rows: DataFrame, *group: str) -> DataFrame:
        so_far = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.withColumn("_row", F.last("_row", ignorenulls=True).over(so_far)).filter(F.col("_kind") == 1)

    cut = cut_hot(both, keys, order, task_rows)
    if cut is None:
        found = filled(both, *keys)
    else:
        cold, hot = cut
        start = F.struct(F.col(time), F.col("_row._until").isNull(), F.col("_row._until"))
        ends = hot.groupBy(*keys, "_slice").agg(F.max_by("_row", F.when(F.col("_kind") == 0, start)).alias("_end"))
        earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(*keys, "_slice", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
        inside = filled(hot, *keys, "_slice").join(ends, [*keys, "_slice"])
        inside = inside.withColumn("_row", F.coalesce("_row", "_carried")).drop("_slice", "_carried")
        found = filled(cold, *keys).unionByName(inside)

    in_force = F.col("_row").isNotNull() & (F.col("_row._until").isNull() | (F.col(time) < F.col("_row._until")))
    return found.filter(in_force).select(
        *[F.col(name) if name in (*keys, time) else F.col(f"_fact.{name}").alias(name) for name in facts.columns],
        *[F.col(f"_row.{name}").alias(name) for name in columns])
