"""The serving store: JDBC appends and sorted exports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.schemas import SERVING_DEFAULTS, project
from lakeloom.sources.jdbc import JdbcConnection
from lakeloom.sources.lake import PACKED


def jdbc_append(df: DataFrame, conn: JdbcConnection, table: str, fields: Mapping[str, str] | None = None,
                connections: int = 16, batch_id: int | None = None) -> None:
    """Append to a database table, `conn.batchsize` rows per insert, over at most `connections` connections.

    `fields` projects onto the table's columns first, so helper columns never reach it. A task that is retried may
    insert rows twice, as a database append is not part of Spark's commit; `batch_id` adds a column `_batch_id`, by
    which a repeated batch can be recognised and removed.
    """
    rows = df if fields is None else project(df, fields, defaults=SERVING_DEFAULTS)
    if batch_id is not None:
        rows = rows.withColumn("_batch_id", F.lit(batch_id).cast("bigint"))
    # The shuffle keeps the plan below at its own width; only the insert is as narrow as the connections.
    (rows.repartition(connections).write.format("jdbc").mode("append").options(**conn.properties())
     .option("url", conn.url).option("dbtable", table).option("numPartitions", connections).save())


def sorted_export(df: DataFrame, path: str, keys: list[str], max_rows_per_file: int = 10_000_000) -> None:
    """Overwrite `path` with files that hold disjoint, sorted ranges of the key, so that a reader looking for a key range
    skips most files and row groups. Keys are unique, so Spark's range cut yields files of similar size."""
    (df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite")
     .option("maxRecordsPerFile", max_rows_per_file).options(**PACKED).parquet(path))
