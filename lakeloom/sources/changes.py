"""Change streams: one message per changed source row, JSON text in column `value`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cdc_stream(spark: SparkSession, kind: str, *, topic: str | None = None, servers: str | None = None,
               path: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """A streaming frame with the single string column `value`.

    kind 'kafka' subscribes to `topic` from its earliest offset and goes on when old offsets have expired;
    kind 'files' follows a folder of text files with one message per line (the same messages, for replays and tests).
    """
    if kind == "kafka":
        reader = (spark.readStream.format("kafka")
                  .option("kafka.bootstrap.servers", servers)
                  .option("subscribe", topic)
                  .option("startingOffsets", "earliest")
                  .option("failOnDataLoss", "false"))
    elif kind == "files":
        reader = spark.readStream.format("text").schema("value string")
    else:
        raise ValueError(f"unknown stream kind {kind!r}")
    reader = reader.options(**(options or {}))
    stream = reader.load() if kind == "kafka" else reader.load(path)
    return stream.select(F.col("value").cast("string").alias("value"))
