"""Partitioned lake tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from lakeloom.session import fresh_dir

# Files of tables are written once and read often, so they are packed tighter than by Spark's default.
PACKED = {"compression": "zstd"}


def compact_by(df: DataFrame, columns: list[str] | tuple[str, ...]) -> DataFrame:
    """Bring the rows of one table partition together before a partitioned write.

    This is Spark's REBALANCE: rows are shuffled by the partition columns so that a partition gets few files, and at
    run time a partition that is too large for one task (say a month with a third of all rows) is split over several
    tasks while small ones share a task.
    """
    return df.hint("rebalance", *columns) if columns else df.hint("rebalance")


def committed(df: DataFrame, label: str) -> DataFrame:
    """The same rows, written to the shared folder and read back: for a result that several later steps read, which would
    otherwise each compute it again, and which outlives the executors that made it."""
    path = fresh_dir(df.sparkSession, label)
    df.write.options(**PACKED).parquet(path)
    return df.sparkSession.read.parquet(path)


@dataclass(frozen=True)
class LakeTable:
    """A table of files below `path`, partitioned by columns.

    With a transactional `fmt` on the classpath (Delta) the same calls commit atomically. With Parquet, replacing several
    partitions is not atomic for a concurrent reader: each partition switches on its own when the job commits.
    """

    path: str
    partition_by: tuple[str, ...] = ()
    fmt: str = "parquet"

    def exists(self, spark: SparkSession) -> bool:
        try:
            spark.read.format(self.fmt).load(self.path).schema
            return True
        except AnalysisException as error:
            if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return False
            raise

    def read(self, spark: SparkSession, where: str | Column | None = None) -> DataFrame:
        """The table; a `where` on partition columns prunes the files that are listed and read."""
        table = spark.read.format(self.fmt).load(self.path)
        return table if where is None else table.filter(where)

    def read_partition(self, spark: SparkSession, **values: object) -> DataFrame:
        """One value of the leading partition column(s). With Parquet only the folder of that partition is listed, so the
        cost does not grow with the number of partitions the table has."""
        if self.fmt != "parquet":
            return self.read(spark, " AND ".join(f"{name} = {value!r}" for name, value in values.items()))
        folder = "/".join(f"{name}={value}" for name, value in values.items())
        return spark.read.option("basePath", self.path).parquet(f"{self.path}/{folder}")

    def folders(self, spark: SparkSession, levels: int) -> dict[str, tuple[int, int]]:
        """The partition folders of the first `levels` columns, relative to the table, with their bytes and number of files. For
        tables of files; the driver lists them as it does to read the table."""
        root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = root.getFileSystem(spark._jsc.hadoopConfiguration())
        found = system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, "/".join(["*=*"] * levels)))
        out = {}
        for status in found or ():
            held = system.getContentSummary(status.getPath())
            parts = status.getPath().toString().split("/")
            out["/".join(parts[-levels:])] = held.getLength(), held.getFileCount()
        return out

    def remove(self, spark: SparkSession, folders: list[str] | None = None) -> None:
        """Delete partition folders, relative to the table, or the whole table."""
        root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = root.getFileSystem(spark._jsc.hadoopConfiguration())
        for folder in [""] if folders is None else folders:
            system.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}" if folder else self.path), True)

    def append(self, df: DataFrame) -> None:
        self._writer(df, "append").save(self.path)

    def overwrite(self, df: DataFrame, clustered: bool = False) -> None:
        """Replace the whole table. Rows that come `clustered`, those of a partition together as `compact_by` or the files of
        a table with the same partitions leave them, are written where they are, without another shuffle."""
        self._writer(df, "overwrite", clustered).option("partitionOverwriteMode", "static").save(self.path)

    def replace_partitions(self, df: DataFrame, clustered: bool = False) -> None:
        """Replace exactly the partitions that occur in `df`, so that running a load twice changes nothing. `clustered` as in
        `overwrite`."""
        if not self.partition_by:
            raise ValueError("replace_partitions needs a partitioned table")
        self._writer(df, "overwrite", clustered).option("partitionOverwriteMode", "dynamic").save(self.path)

    def touched(self, df: DataFrame, columns: tuple[str, ...] | None = None) -> Column:
        """A predicate selecting the partitions `df` falls in, by all partition columns or the ones named.

        Distinct partition values reach the driver, never keys: no more than the partitions that it lists to read the table
        and commits when `df` is merged into it.
        """
        columns = columns or self.partition_by
        values = df.select(*columns).distinct().collect()
        if not values:
            return F.lit(False)
        kinds = [df.schema[name].dataType for name in columns]
        # One flat list of structs, in which null equals null; a chain of thousands of conditions would be too deep.
        places = [F.struct(*[F.lit(value).cast(kind).alias(name) for name, kind, value in zip(columns, kinds, row)])
                  for row in values]
        return F.struct(*[F.col(name).cast(kind).alias(name) for name, kind in zip(columns, kinds)]).isin(places)

    def _writer(self, df: DataFrame, mode: str, clustered: bool = False):
        rows = df if clustered else compact_by(df, self.partition_by)
        packed = PACKED if self.fmt == "parquet" else {}
        return rows.write.format(self.fmt).mode(mode).options(**packed).partitionBy(*self.partition_by)
