"""Constraint checks: each is one job and returns rows, it never stops a load by itself."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def _per_rule(df: DataFrame, failed: Mapping[str, Column]) -> DataFrame:
    """Rows (rule, rows, failed), all rules counted in one pass over the data."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"),
                    *[F.count(F.when(bad, 1)).alias(f"_f{i}") for i, bad in enumerate(failed.values())])
    entries = [F.struct(F.lit(name).alias("rule"), F.col("_rows").alias("rows"), F.col(f"_f{i}").alias("failed"))
               for i, name in enumerate(failed)]
    return counts.select(F.inline(F.array(*entries)))


def observed(df: DataFrame, failed: Mapping[str, Column]) -> tuple[DataFrame, Observation]:
    """The same rows, and counts of them (`rows`) and of those that fail each rule, which are there once a job has written the rows.
    The rules are counted as the rows pass; the data is not read for them."""
    counts = Observation()
    return df.observe(counts, F.count(F.lit(1)).alias("rows"),
                      *[F.count(F.when(F.coalesce(bad, F.lit(True)), 1)).alias(name) for name, bad in failed.items()]), counts


def not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return _per_rule(df, {name: F.col(name).isNull() for name in columns})


def expect(df: DataFrame, rules: Mapping[str, Column | str]) -> DataFrame:
    """Rows not satisfying each rule; a rule that is null for a row fails there."""
    conditions = {name: F.expr(rule) if isinstance(rule, str) else rule for name, rule in rules.items()}
    return _per_rule(df, {name: ~F.coalesce(rule, F.lit(False)) for name, rule in conditions.items()})


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows. A key with a null is no duplicate, as in SQL."""
    has_key = F.lit(True)
    for key in keys:
        has_key = has_key & F.col(key).isNotNull()
    return df.filter(has_key).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: number of duplicated keys, and of rows beyond the first of each."""
    return duplicates(df, keys).agg(F.count(F.lit(1)).alias("duplicated_keys"),
                                    F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).alias("extra_rows"))


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Non-null values of a foreign key that the parent lacks, with their number of rows.

    The child is first reduced to one row per value, so a value with many rows costs no more than another in the join.
    """
    used = child.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    return used.join(parent.select(F.col(key).alias(column)), column, "left_anti")
