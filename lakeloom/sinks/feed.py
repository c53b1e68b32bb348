"""A feed of what changed in a table, for serving stores and marts that follow it.

The feed holds signed rows: a row that goes has `sign` -1 and one that comes 1. Each batch is a partition, named by the run and the
number of the batch, and counts once it is in the ledger. A batch that is repeated after a crash replaces its own
partition, and one that the ledger has is not written again, so a repeated batch adds nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.sources.lake import LakeTable

BATCH = ("_run", "_batch")


@dataclass(frozen=True)
class ChangeFeed:
    """Signed rows of one table below `path`."""

    path: str

    @property
    def rows(self) -> LakeTable:
        return LakeTable(f"{self.path}/rows", BATCH)

    @property
    def ledger(self) -> LakeTable:
        return LakeTable(f"{self.path}/ledger")

    def holds(self, spark: SparkSession, run: str, batch_id: int) -> bool:
        if not self.ledger.exists(spark):
            return False
        return not self.ledger.read(spark, (F.col("_run") == run) & (F.col("_batch") == batch_id)).isEmpty()

    def write(self, signed: DataFrame, run: str, batch_id: int) -> None:
        """Add a batch, unless the feed has it."""
        spark = signed.sparkSession
        if self.holds(spark, run, batch_id):
            return
        named = signed.withColumns({"_run": F.lit(run), "_batch": F.lit(batch_id).cast("bigint")})
        self.rows.replace_partitions(named, clustered=True)  # one partition: each task writes its rows where they are
        self.ledger.append(spark.range(1).select(F.lit(run).alias("_run"), F.lit(batch_id).cast("bigint").alias("_batch")))

    def batches(self, spark: SparkSession) -> DataFrame:
        """(_run, _batch) of the batches that count."""
        if not self.ledger.exists(spark):
            return spark.createDataFrame([], "_run string, _batch bigint")
        return self.ledger.read(spark).distinct()

    def read(self, spark: SparkSession) -> DataFrame | None:
        """All rows that count, with `_run` and `_batch`; None before the first."""
        if not self.rows.exists(spark):
            return None
        rows = self.rows.read(spark).withColumns({"_run": F.col("_run").cast("string"), "_batch": F.col("_batch").cast("bigint")})
        return rows.join(self.batches(spark), list(BATCH), "left_semi")

    def read_batch(self, spark: SparkSession, run: str, batch_id: int) -> DataFrame | None:
        """The signed rows of one batch; None if it changed nothing, or is not in the ledger."""
        if not self.holds(spark, run, batch_id) or f"_run={run}/_batch={batch_id}" not in self.rows.folders(spark, 2):
            return None
        return self.rows.read_partition(spark, _run=run, _batch=batch_id).drop(*BATCH)


def replay(feed: DataFrame) -> DataFrame:
    """The table that the signed rows add up to, from an empty one."""
    columns = [name for name in feed.columns if name not in (*BATCH, "sign")]
    net = feed.groupBy(*columns).agg(F.sum("sign").alias("_net")).filter("_net > 0")
    return net.select(*columns, F.explode(F.sequence(F.lit(1), F.col("_net"))).alias("_copy")).drop("_copy")
