"""Checks on a list of slice predicates, such as those of a parallel JDBC read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slice_counts(df: DataFrame, predicates: list[str]) -> DataFrame:
    """Rows (hits, slice, rows): per row of `df`, how many predicates hold and which one is the first to.

    The slices are sound when hits is 1 throughout: every row is read, and read once.
    """
    tests = [F.coalesce(F.expr(predicate.replace('"', "`")), F.lit(False)) for predicate in predicates]
    marks = df.select(F.array(*tests).alias("_t"))
    marks = marks.select(F.size(F.filter("_t", lambda t: t)).alias("hits"),
                         (F.array_position("_t", True) - 1).cast("int").alias("slice"))
    return marks.groupBy("hits", "slice").agg(F.count(F.lit(1)).alias("rows"))
