"""Table mutation as joins: MERGE with conditions, ordered upsert, lookups against a table."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.operators import cdc

Expression = Column | str


def _expr(value: Expression) -> Column:
    return F.expr(value) if isinstance(value, str) else value


@dataclass(frozen=True)
class Update:
    """WHEN MATCHED [AND condition] THEN UPDATE SET ...; columns not named keep their value.

    `values=None` sets every column from the source column of the same name.
    """

    values: Mapping[str, Expression] | None = None
    condition: Expression = "true"


@dataclass(frozen=True)
class Delete:
    """WHEN MATCHED [AND condition] THEN DELETE."""

    condition: Expression = "true"


@dataclass(frozen=True)
class Insert:
    """WHEN NOT MATCHED [AND condition] THEN INSERT; columns not named become null.

    `values=None` takes every column from the source column of the same name.
    """

    values: Mapping[str, Expression] | None = None
    condition: Expression = "true"


def _check_names(target: DataFrame, clauses) -> None:
    for clause in clauses:
        unknown = set(getattr(clause, "values", None) or {}) - set(target.columns)
        if unknown:
            raise ValueError(f"the target has no column {', '.join(sorted(unknown))}")


def _matched_once(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The target rows; the job fails if one of them has several source rows. Only keys that repeat are joined, which are
    few, and source rows that repeat a key the target lacks do no harm."""
    repeated = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    checked = target.join(repeated, keys, "left")
    return checked.filter(F.expr("assert_true(_n IS NULL, 'several merge source rows match one target row') IS NULL")).select(
        *target.columns)


def merge_into(target: DataFrame, source: DataFrame, keys: list[str], matched: list[Update | Delete] = (),
               not_matched: list[Insert] = (), target_filter: Expression | None = None) -> DataFrame:
    """The target after a MERGE: `ON` equality of `keys` and `target_filter` on the target row.

    Clauses are tried in order and the first whose condition holds is taken; without one, a matched row stays and an
    unmatched source row is dropped. Expressions refer to columns as `tgt.x` and `src.x`. As in SQL, a null key matches
    nothing, source rows that share a key and match no target row are each inserted, and several that match one target row make the
    job fail, since the outcome would be ambiguous. Clauses may name only columns of the target. Target keys are unique
    within `target_filter`.
    """
    columns = target.columns
    _check_names(target, [*matched, *not_matched])
    has_key = F.lit(True)
    for key in keys:
        has_key = has_key & F.col(key).isNotNull()
    in_scope = has_key if target_filter is None else has_key & F.coalesce(_expr(target_filter), F.lit(False))
    keyed = source.filter(has_key)

    left = _matched_once(target.filter(in_scope), keyed, keys).withColumn("_old", F.lit(True)).alias("tgt")
    right = keyed.withColumn("_new", F.lit(True)).alias("src")
    same = F.lit(True)
    for key in keys:
        same = same & (F.col(f"tgt.{key}") == F.col(f"src.{key}"))
    pairs = left.join(right, same, "full_outer")
    is_pair = F.col("tgt._old").isNotNull() & F.col("src._new").isNotNull()
    is_new = F.col("tgt._old").isNull()

    # Which clause applies: 0 keeps the target row, 1.. are matched clauses, -1.. insert clauses; null drops the row.
    action = F.when(is_new, _first_clause(not_matched, -1, F.lit(None))).otherwise(
        F.when(is_pair, _first_clause(matched, 1, F.lit(0))).otherwise(F.lit(0)))
    deletes = [i for i, clause in enumerate(matched, 1) if isinstance(clause, Delete)]
    staged = pairs.withColumn("_action", action)
    staged = staged.filter(F.col("_action").isNotNull() & ~F.col("_action").isin(deletes or [len(matched) + 1]))

    kinds = {f.name: f.dataType for f in target.schema.fields}
    merged = staged.select(*[
        _value(name, matched, not_matched).cast(kinds[name]).alias(name) for name in columns])
    parts = [merged, target.filter(~in_scope)]
    if not_matched:
        parts.append(_insert_null_keys(source.filter(~has_key), target, not_matched))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _first_clause(clauses, step: int, default: Column) -> Column:
    chosen = default.cast("int")
    for i, clause in reversed(list(enumerate(clauses, 1))):
        chosen = F.when(_expr(clause.condition), F.lit(i * step)).otherwise(chosen)
    return chosen


def _value(name: str, matched, not_matched) -> Column:
    value = F.col(f"tgt.{name}")
    for i, clause in enumerate(matched, 1):
        if isinstance(clause, Update):
            new = F.col(f"src.{name}") if clause.values is None else clause.values.get(name)
            if new is not None:
                value = F.when(F.col("_action") == i, _expr(new)).otherwise(value)
    for i, clause in enumerate(not_matched, 1):
        new = F.col(f"src.{name}") if clause.values is None else clause.values.get(name, F.lit(None))
        value = F.when(F.col("_action") == -i, _expr(new)).otherwise(value)
    return value


def _insert_null_keys(rows: DataFrame, target: DataFrame, not_matched: list[Insert]) -> DataFrame:
    """Source rows with a null key match nothing: insert them without joining (a join would gather them in one task)."""
    staged = rows.alias("src").withColumn("_action", _first_clause(not_matched, -1, F.lit(None)))
    staged = staged.filter(F.col("_action").isNotNull())
    columns = []
    for field_ in target.schema.fields:
        value = F.lit(None)
        for i, clause in enumerate(not_matched, 1):
            new = F.col(f"src.{field_.name}") if clause.values is None else clause.values.get(field_.name, F.lit(None))
            value = F.when(F.col("_action") == -i, _expr(new)).otherwise(value)
        columns.append(value.cast(field_.dataType).alias(field_.name))
    return staged.select(*columns)


def upsert(target: DataFrame | None, changes: DataFrame, keys: list[str]) -> DataFrame:
    """State after applying ordered changes: per key the row with the highest sequence, from target or changes.

    Rows are state rows (fields, ts_ms, lsn, deleted). A delete stays as a row with `deleted` set, so that an older
    change arriving later cannot bring the key back. One shuffle by key, no join; applying changes again, in another
    order or in other batches gives the same state.
    """
    rows = changes if target is None else target.unionByName(changes.select(*target.columns))
    return cdc.latest(rows, keys)


def touched_rows(state: DataFrame, batch: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of a state whose key occurs in the batch, and the others. Spark sends the keys of a small batch to the state, which
    is then not shuffled."""
    used = batch_keys(batch, keys)
    return state.join(used, keys, "left_semi"), state.join(used, keys, "left_anti")


def upsert_touched(target: DataFrame | None, changes: DataFrame, keys: list[str]) -> DataFrame:
    """`upsert` of a batch that is small against the table: only rows of its keys are shuffled, all others pass. The table and the
    batch are read twice, so they should be tables rather than long plans."""
    if target is None:
        return upsert(None, changes, keys)
    touched, others = touched_rows(target, changes, keys)
    return others.unionByName(upsert(touched, changes, keys))


def visible(state: DataFrame) -> DataFrame:
    """What readers of a state table see: live rows, without the bookkeeping columns."""
    return state.filter(~F.col("deleted")).drop("deleted", *cdc.SEQUENCE)


def purge(state: DataFrame, before_ms: int) -> DataFrame:
    """Drop delete markers older than `before_ms`; changes older than that must no longer arrive."""
    return state.filter(~(F.col("deleted") & (F.col("ts_ms") < before_ms)))


def batch_keys(batch: DataFrame, keys: list[str]) -> DataFrame:
    return batch.select(*keys).distinct()


def lookup_existing(target: DataFrame, batch: DataFrame, keys: list[str],
                    where: Expression | None = None) -> DataFrame:
    """Target rows whose key occurs in the batch. The keys stay distributed; Spark broadcasts them if they are few."""
    rows = target if where is None else target.filter(_expr(where))
    return rows.join(batch_keys(batch, keys), keys, "left_semi")


def new_rows(batch: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Batch rows whose key does not occur in the target."""
    return batch.join(batch_keys(target, keys), keys, "left_anti")


def signed_changes(before: DataFrame | None, after: DataFrame) -> DataFrame:
    """What turns one state into another: each row that goes, with `sign` -1, and each that comes, with `sign` 1; an updated row is
    both. Rows that are equal in all columns cancel out, so keys need not be unique, and `before` may be None for an empty state.
    """
    columns = after.columns
    rows = after.withColumn("sign", F.lit(1))
    if before is not None:
        rows = before.select(*columns).withColumn("sign", F.lit(-1)).unionByName(rows)
    net = rows.groupBy(*columns).agg(F.sum("sign").alias("_net")).filter("_net <> 0")
    return net.select(*columns, F.explode(F.array_repeat(F.signum("_net").cast("int"), F.abs("_net").cast("int"))).alias("sign"))


def signed_upsert(before: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """`signed_changes` from what readers see of a state of unique keys, to what they see of its `upsert` with the changes: a key's row
    before and its row after meet once, in the shuffle that merges them."""
    rest = [name for name in before.columns if name not in (*keys, *cdc.SEQUENCE, "deleted")]
    # The order of `cdc.latest`: nulls are least.
    row = F.struct(*cdc.SEQUENCE, "deleted", *rest)
    rows = before.select(*keys, row.alias("_row"), F.lit(True).alias("_held")).unionByName(
        changes.select(*keys, row.alias("_row"), F.lit(False).alias("_held")))
    # A hash in front of the keys settles nearly all comparisons.
    pairs = rows.groupBy(F.xxhash64(*keys).alias("_name"), *keys).agg(
        F.max(F.when(F.col("_held"), F.col("_row"))).alias("_old"), F.max("_row").alias("_new"))

    def seen(side: str) -> Column:
        """The values that readers see, null if they see no row."""
        return F.when(~F.col(f"{side}.deleted"), F.struct(F.lit(0).alias("_"), *[F.col(f"{side}.{name}").alias(name) for name in rest]))

    shown = pairs.select(*keys, seen("_old").alias("_old"), seen("_new").alias("_new")).filter(~F.col("_old").eqNullSafe(F.col("_new")))
    signed = F.array(F.struct(F.lit(-1).alias("sign"), F.col("_old").alias("_row")), F.struct(F.lit(1).alias("sign"), F.col("_new").alias("_row")))
    out = shown.select(*keys, F.explode(signed).alias("_one")).filter("_one._row IS NOT NULL")
    columns = [name for name in before.columns if name not in (*cdc.SEQUENCE, "deleted")]
    return out.select(*[F.col(name) if name in keys else F.col(f"_one._row.{name}").alias(name) for name in columns], F.col("_one.sign").alias("sign"))


def changed_rows(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that differ between two states of a table with unique keys, with column `change`: 'insert', 'update' or
    'delete' (then with the old values)."""
    rest = [name for name in after.columns if name not in keys]
    old = before.select(*keys, F.struct(*rest).alias("_old"))
    new = after.select(*keys, F.struct(*rest).alias("_new"))
    pairs = old.join(new, keys, "full_outer").filter(~F.col("_old").eqNullSafe(F.col("_new")))
    change = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").otherwise("update")
    row = F.coalesce("_new", "_old")
    return pairs.select(change.alias("change"), *keys, row.alias("_row")).select(
        "change", *[F.col(name) if name in keys else F.col(f"_row.{name}").alias(name) for name in after.columns])
