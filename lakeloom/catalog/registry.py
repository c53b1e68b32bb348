"""Registered queries: name -> job, and name -> SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register the decorated function under its name, with the SQL it is checked against, if SQL can express it."""
    def register(job: Query) -> Query:
        QUERIES[job.__name__] = job
        if sql is not None:
            ORACLE[job.__name__] = sql
        return job
    return register


def doubles(df: DataFrame) -> DataFrame:
    """Decimals as doubles: the type money has outside the marts."""
    return df.select(*[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, DecimalType)
                       else F.col(f.name) for f in df.schema.fields])
