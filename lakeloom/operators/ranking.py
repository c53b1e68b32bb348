"""Top rows by rank, ties included."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.sources.lake import committed

# Up to this n Spark keeps each task's n leading rows of a group before the shuffle (its own limit for that).
LEADING = 1000
# Without groups each task keeps its n leading rows for any n, but all of these meet in one task, so n should not be large.
LEADING_OVERALL = 1 << 12


def top_by_rank(df: DataFrame, value: str, n: int = 10, by: list[str] | None = None) -> DataFrame:
    """Rows whose `rank()` by descending `value` is at most `n`, overall or within each group of `by`.

    Ranks skip after ties and all ties at rank n are kept, so the result may hold more than n rows. Ranking in one
    window would send every tied row to one task. Instead, `row_number() <= n` (limited before the shuffle to n rows per
    task and group) gives the n leading rows; the rank of a value is the smallest row number it has there. Joining
    these at most n values per group back to the data finds the ties where they are. For larger n, where Spark drops that limit or too
    many rows would meet, values are ranked by ranges (`value_ranks`). `df` is read twice, so it should be a table rather than a long plan.
    """
    by = by or []
    if n > (LEADING if by else LEADING_OVERALL):
        ranks = value_ranks(df, value, by).filter(F.col("rank") <= n)
    else:
        ranks = _leading_ranks(df, value, n, by)
    ranks = ranks.select(*[F.col(name).alias(f"_{name}") for name in [*by, value]], "rank")
    same = F.lit(True)
    for name in [*by, value]:
        same = same & F.col(name).eqNullSafe(F.col(f"_{name}"))
    return df.join(ranks, same).select(*df.columns, "rank")


def _leading_ranks(df: DataFrame, value: str, n: int, by: list[str]) -> DataFrame:
    window = Window.partitionBy(*by).orderBy(F.col(value).desc_nulls_last())
    values = df.select(*by, value)
    if not by:
        # Each task keeps its n leading rows, and only those meet.
        values = values.orderBy(F.col(value).desc_nulls_last()).limit(n)
    leaders = values.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= n)
    return leaders.groupBy(*by, value).agg(F.min("_rn").cast("int").alias("rank"))


def value_ranks(df: DataFrame, value: str, by: list[str], ranges: int | None = None) -> DataFrame:
    """(*by, value, rank) of every different value, whatever the size of a group: `rank()` by descending value.

    Values are counted before they are shuffled and cut into ranges of similar size, across groups and inside them, so a
    group with all rows is spread like many small ones. The rank of a value is one more than the rows before it: those of the
    earlier ranges of its group, by a prefix sum over one row per group and range, and those before it in its own.
    """
    counted = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    order = [*[F.col(name).asc() for name in by], F.col(value).desc_nulls_last()]
    ranged = counted.repartitionByRange(*([ranges] if ranges else []), *order)
    # Committed, as two steps read the ranges and must see the same cuts.
    cut = committed(ranged.withColumn("_range", F.spark_partition_id()), "rank-ranges")
    sums = cut.groupBy(*by, "_range").agg(F.sum("_n").alias("_rows"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(name).alias(f"_{name}") for name in by], F.col("_range").alias("_at"),
                       F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_earlier"))
    inside = Window.partitionBy(*by, "_range").orderBy(F.col(value).desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    before = cut.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    same = F.col("_range") == F.col("_at")
    for name in by:
        same = same & F.col(name).eqNullSafe(F.col(f"_{name}"))
    return before.join(sums, same).select(*by, value, (F.col("_earlier") + F.col("_before") + 1).cast("int").alias("rank"))
