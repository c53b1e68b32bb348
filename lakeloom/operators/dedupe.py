"""Deterministic deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.sources.lake import committed

# So many repeated keys are sent to the tasks as numbers, 8 MB of them.
FEW = 1 << 20


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row per key: the first by `order`, which should be a total order so that the survivor is determined.

    Spark turns `row_number() = 1` into a group limit that also runs before the shuffle, so each task sends at most
    one row per key: a key with a third of all rows shrinks to one row per task before rows of a key meet.
    """
    # A hash in front of several key columns settles nearly all comparisons of the two sorts with one number.
    leading = [F.xxhash64(*keys)] if len(keys) > 1 else []
    window = Window.partitionBy(*leading, *keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") == 1).drop("_rn")


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return keep_first(df, keys, [F.col(name).desc_nulls_last() for name in order])


def split_repeated(df: DataFrame, keys: list[str], examine: DataFrame | None = None,
                   few: int = FEW) -> tuple[DataFrame, DataFrame] | None:
    """(rows whose key is theirs alone, other rows), or None if more than `few` keys repeat.

    For a table in which few rows repeat a key: only hashes of the keys are shuffled, and the rows stay where they are, in the order
    of their files. Keys with equal hashes count as repeated, which puts rows that need not be there among the others. `df` is
    read several times, so it should be a table; `examine` is what the hashes are taken from, if not `df`.
    """
    name = F.xxhash64(*keys).alias("_name")
    counted = (df if examine is None else examine).groupBy(name).agg(F.count(F.lit(1)).alias("_n"))
    repeated = committed(counted.filter("_n > 1").select("_name"), "repeated-keys")
    if repeated.count() > few:
        return None
    named, sent = df.withColumn("_name", name), F.broadcast(repeated)  # the bound is `few`
    return (named.join(sent, "_name", "left_anti").select(*df.columns),
            named.join(sent, "_name", "left_semi").select(*df.columns))
