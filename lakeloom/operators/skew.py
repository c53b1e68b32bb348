"""Cutting the timelines of hot keys.

One key may hold a large share of all rows. Aggregations are safe, since Spark combines rows before the shuffle, and skewed
joins are split by adaptive execution. Windows are not: all rows of the key would meet in one task. `cut_hot` looks for such
keys in the data, whatever its size, and cuts their timelines into slices of similar numbers of rows, for operators that can
stitch slices together. The hot keys stay a distributed table; only the sum of their rows reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.sources.lake import committed

# Rows of one key that one task handles well. A key with fewer is not worth cutting.
TASK_ROWS = 4_000_000


def hot_keys(df: DataFrame, keys: list[str], task_rows: int = TASK_ROWS) -> DataFrame:
    """All keys of `df` with more than `task_rows` rows, with their number as `_rows`."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > task_rows)


def cut_hot(df: DataFrame, keys: list[str], order: list[str | Column], task_rows: int = TASK_ROWS,
            examine: DataFrame | None = None) -> tuple[DataFrame, DataFrame] | None:
    """(rows of other keys, rows of hot keys with `_slice`), or None if no key is hot.

    Rows of a key in slice i come before those in slice i+1 by `order`. Slices are the ranges that Spark cuts the sorted rows
    into from a sample of them, so a key with all its rows in one day is cut as evenly as any other. They are committed,
    since several steps read them and must see the same cuts. Rows with a null key count as not hot.
    `examine` is where hot keys are looked for, `df` itself by default: when `df` is the outcome of a long plan, name the table
    its keys come from, so that the plan is not run once more for it.
    """
    hot = hot_keys(df if examine is None else examine, keys, task_rows)
    total = hot.agg(F.sum("_rows")).first()[0]
    if total is None:
        return None
    hot = committed(hot.select(*keys), "hot-keys")
    ranged = df.join(hot, keys, "left_semi").repartitionByRange(-(-total // task_rows), *keys, *order)
    sliced = committed(ranged.withColumn("_slice", F.spark_partition_id()), "slices")
    return df.join(hot, keys, "left_anti"), sliced
