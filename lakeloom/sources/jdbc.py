"""Parallel reads of relational tables over JDBC.

Every read is cut into disjoint slices, one task each, that together cover the table: a slice is a predicate the
database evaluates. (Plain `lowerBound`/`upperBound` only set a stride and never filter, and `numPartitions` without a
partition column reads through a single connection, so neither is used to bound a read here.)
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class JdbcConnection:
    url: str
    driver: str | None = None
    user: str | None = None
    password: str | None = field(default=None, repr=False)
    fetchsize: int = 10_000
    batchsize: int = 10_000

    @classmethod
    def from_env(cls, prefix: str, env: dict[str, str] | None = None) -> "JdbcConnection":
        """Settings from `<PREFIX>_URL`, `_DRIVER`, `_USER`, `_PASSWORD`, `_FETCHSIZE` and `_BATCHSIZE`."""
        env = os.environ if env is None else env
        get = lambda name, default=None: env.get(f"{prefix}_{name}", default)
        return cls(url=env[f"{prefix}_URL"], driver=get("DRIVER"), user=get("USER"), password=get("PASSWORD"),
                   fetchsize=int(get("FETCHSIZE", 10_000)), batchsize=int(get("BATCHSIZE", 10_000)))

    def properties(self) -> dict[str, str]:
        known = {"driver": self.driver, "user": self.user, "password": self.password}
        return {**{k: v for k, v in known.items() if v is not None},
                "fetchsize": str(self.fetchsize), "batchsize": str(self.batchsize)}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def range_predicates(key: str, low: int, high: int, parts: int) -> list[str]:
    """At most `parts` disjoint half-open id ranges covering low..high (both included), of almost equal width."""
    if high < low:
        return []
    span = high - low + 1
    parts = max(1, min(parts, span))
    edges = [low + span * i // parts for i in range(parts + 1)]
    column = quoted(key)
    return [f"{column} >= {a} AND {column} < {b}" for a, b in zip(edges, edges[1:])]


def month_starts(start: datetime, end: datetime) -> list[datetime]:
    """`start`, then the first instant of each following month before `end`, then `end`."""
    edges = [start]
    year, month = start.year, start.month
    while True:
        year, month = (year + 1, 1) if month == 12 else (year, month + 1)
        edge = datetime(year, month, 1)
        if edge >= end:
            return edges + [end]
        edges.append(edge)


def month_predicates(column: str, start: datetime, end: datetime, pieces: int = 1) -> list[str]:
    """Disjoint half-open ranges, `pieces` equal ones per calendar month, covering `start` (included) to `end` (excluded)."""
    if end <= start:
        return []
    months = month_starts(start, end)
    edges = [a + (b - a) * i / pieces for a, b in zip(months, months[1:]) for i in range(pieces)] + [end]
    column = quoted(column)
    stamp = lambda moment: f"TIMESTAMP '{moment.isoformat(sep=' ', timespec='microseconds')}'"
    return [f"{column} >= {stamp(a)} AND {column} < {stamp(b)}" for a, b in zip(edges, edges[1:])]


def key_bounds(spark: SparkSession, conn: JdbcConnection, table: str, key: str) -> tuple[int, int] | None:
    """Smallest and largest key, computed by the database: one row comes back."""
    column = quoted(key)
    row = (spark.read.format("jdbc").options(**conn.properties()).option("url", conn.url)
           .option("query", f"SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {table}").load().first())
    return None if row is None or row[0] is None else (int(row[0]), int(row[1]))


def jdbc_range(spark: SparkSession, conn: JdbcConnection, table: str, key: str, parts: int = 10,
               low: int | None = None, high: int | None = None) -> DataFrame:
    """Read a table by ranges of a numeric, non-null key. `low`/`high` bound the read; without them it is whole."""
    if low is None or high is None:
        found = key_bounds(spark, conn, table, key)
        if found is None:
            return spark.read.jdbc(conn.url, table, properties=conn.properties())
        low, high = found[0] if low is None else low, found[1] if high is None else high
    predicates = range_predicates(key, low, high, parts) or ["1 = 0"]
    return spark.read.jdbc(conn.url, table, predicates=predicates, properties=conn.properties())


def jdbc_months(spark: SparkSession, conn: JdbcConnection, table: str, column: str, start: datetime,
                end: datetime, pieces: int = 1) -> DataFrame:
    """Read the rows dated `start` (included) to `end` (excluded), all months in parallel; `pieces` cuts each month
    further, where single months are too large for a task."""
    predicates = month_predicates(column, start, end, pieces) or ["1 = 0"]
    return spark.read.jdbc(conn.url, table, predicates=predicates, properties=conn.properties())
