"""The batch load: sources to bronze, silver, gold, and on to the serving store.

Each stage is one job per table over all its rows and commits a table the next stage reads, so a lost executor costs at
most a stage. Running a stage again replaces what it wrote, and so does `export`; `publish` appends, as the serving store's
writer does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lakeloom import schemas
from lakeloom.operators import quality
from lakeloom.operators.dedupe import split_repeated
from lakeloom.plans import bronze, gold, silver
from lakeloom.sinks.serving import jdbc_append, sorted_export
from lakeloom.sources.jdbc import JdbcConnection
from lakeloom.sources.lake import LakeTable, committed, compact_by
from lakeloom.streaming import programs

TABLES = ("users", "products", "orders")


@dataclass(frozen=True)
class Lake:
    """Where the tables of each layer are."""

    root: str
    fmt: str = "parquet"

    def bronze(self, name: str) -> LakeTable:
        return LakeTable(f"{self.root}/bronze/{name}", bronze.PARTITIONS[name], self.fmt)

    def silver(self, name: str) -> LakeTable:
        return LakeTable(f"{self.root}/silver/{name}", silver.PARTITIONS[name], self.fmt)

    def live(self, spark: SparkSession, name: str) -> DataFrame:
        """Silver as its readers see it, whether the batch load or a stream wrote it last: deltas merged, no delete markers."""
        return replace(programs.TABLES[name](self.root), fmt=self.fmt).visible(spark)

    def rejects(self, name: str) -> LakeTable:
        return LakeTable(f"{self.root}/rejects/{name}", bronze.PARTITIONS[name], self.fmt)

    def gold(self, name: str) -> LakeTable:
        parts = ("year", "month") if name == "sales_summary_by_product" else ()
        return LakeTable(f"{self.root}/gold/{name}", parts, self.fmt)


def load_bronze(lake: Lake, sources: Mapping[str, DataFrame]) -> None:
    """Bronze from source tables (users, products, orders): whole tables, replacing what is there."""
    for name in TABLES:
        lake.bronze(name).overwrite(getattr(bronze, name)(sources[name]))


def load_silver(spark: SparkSession, lake: Lake, as_of: str | None = None,
                domains: Mapping[str, Column] | None = None) -> DataFrame:
    """Silver from bronze. `domains` names the rows a table accepts (see `silver.domain_filter`), by default all; the others
    are kept as a table of rejects.

    Returns (name, rule, rows, failed): how many of the bronze rows lack a required value, are outside the domain, or repeat a
    key, counted by the jobs that write silver, without another pass over the data.
    """
    report = []
    for name in TABLES:
        bronze_rows = lake.bronze(name).read(spark)
        rows, seen = quality.observed(bronze_rows, {
            **{column: F.col(column).isNull() for column in schemas.REQUIRED[name]},
            "domain": ~F.coalesce((domains or {}).get(name, F.lit(True)), F.lit(False))})
        if domains and name in domains:
            _, rejected = silver.domain_filter(bronze_rows, domains[name])
            lake.rejects(name).overwrite(rejected)
            rows, _ = silver.domain_filter(rows, domains[name])
        table, parts = lake.silver(name), None
        if name == "orders":
            plain = silver.domain_filter(bronze_rows, domains[name])[0] if domains and name in domains else bronze_rows
            # The rows are counted as their keys are looked at, and bronze has the months of silver: its rows stay in place.
            parts = split_repeated(plain, schemas.SOURCE_KEYS[name], examine=rows)
            made = silver.orders(plain) if parts is None else parts[0].unionByName(
                compact_by(silver.orders(parts[1]), table.partition_by))
        else:
            made = getattr(silver, name)(rows, as_of)
        written = Observation()
        table.overwrite(made.observe(written, F.count(F.lit(1)).alias("rows")), clustered=parts is not None)
        counts = seen.get
        kept = counts["rows"] - counts["domain"]
        report += [(name, rule, counts["rows"], counts[rule]) for rule in (*schemas.REQUIRED[name], "domain")]
        report.append((name, "unique", kept, kept - written.get["rows"]))
    return spark.createDataFrame(report, "name string, rule string, rows bigint, failed bigint")


def load_gold(spark: SparkSession, lake: Lake, top: int = 10) -> None:
    """The marts from silver. The top products are ranked from the committed summary, not computed a second time."""
    orders = lake.live(spark, "orders")
    if programs.TABLES["orders"](lake.root).deltas.exists(spark):
        orders = committed(orders, "orders")  # two marts read them, and each would merge the deltas
    lifetime = gold.customer_lifetime_value(orders, lake.live(spark, "users"))
    lake.gold("customer_lifetime_value").overwrite(lifetime)
    table = lake.gold("sales_summary_by_product")
    summary = gold.sales_summary_by_product(orders, lake.live(spark, "products"), table.partition_by)
    table.overwrite(summary, clustered=True)
    summary = table.read(spark).select(*summary.columns)
    lake.gold("top_products_by_revenue").overwrite(gold.top_products_by_revenue(summary, top))


def run_batch(spark: SparkSession, lake: Lake, sources: Mapping[str, DataFrame], as_of: str | None = None,
              domains: Mapping[str, Column] | None = None, serving: JdbcConnection | None = None) -> Lake:
    """All stages in order; the serving store is loaded last and only from committed tables."""
    load_bronze(lake, sources)
    load_silver(spark, lake, as_of, domains)
    load_gold(spark, lake)
    if serving is not None:
        publish(spark, lake, serving)
    return lake


def publish(spark: SparkSession, lake: Lake, serving: JdbcConnection, narrow: bool = False, run: int | None = None) -> None:
    """Append each silver table to the serving table of its name, on that table's columns. `run` numbers the load, as `_batch_id`
    of its rows, so that the rows of a load that was cut off, or is run again, can be found and removed (see
    `jdbc_append`): an append by itself does not replace what an earlier run sent."""
    fields = {"users": schemas.SERVING_USERS, "products": schemas.SERVING_PRODUCTS, "orders": schemas.SERVING_ORDERS}
    for name in TABLES:
        target = fields[name] if narrow else schemas.wide(fields[name])
        jdbc_append(lake.live(spark, name), serving, name, target, **({} if run is None else {"batch_id": run}))


def export(spark: SparkSession, lake: Lake, path: str) -> None:
    """The serving projection of each silver table as files sorted by its serving key; a load that is run again replaces them."""
    fields = {"users": schemas.SERVING_USERS, "products": schemas.SERVING_PRODUCTS, "orders": schemas.SERVING_ORDERS}
    for name in TABLES:
        rows = schemas.project(lake.live(spark, name), schemas.wide(fields[name]), defaults=schemas.SERVING_DEFAULTS)
        sorted_export(rows, f"{path}/{name}", schemas.SERVING_KEYS[name])


@dataclass(frozen=True)
class Ledger:
    """What became of each slice of a backfill, below `path`: (slice, run, ok, error, rows)."""

    path: str

    @property
    def table(self) -> LakeTable:
        return LakeTable(self.path)

    def add(self, spark: SparkSession, one: str, run: str, ok: bool, error: str | None) -> None:
        row = spark.createDataFrame([(one, run, ok, error)], "slice string, run string, ok boolean, error string")
        self.table.append(row.withColumn("at", F.current_timestamp()))

    def read(self, spark: SparkSession) -> DataFrame:
        if not self.table.exists(spark):
            return spark.createDataFrame([], "slice string, run string, ok boolean, error string, at timestamp")
        return self.table.read(spark)

    def done(self, spark: SparkSession, run: str) -> set[str]:
        """The slices that some attempt of this run has loaded."""
        return {row.slice for row in self.read(spark).filter((F.col("run") == run) & F.col("ok")).select("slice").distinct().collect()}


def resume(spark: SparkSession, ledger: Ledger, run: str, slices: Iterable[str], load: Callable[[str], None]) -> DataFrame:
    """`backfill` that can be started again: slices that the ledger has as loaded in this run are left alone, the others are loaded
    and entered as they end. Returns (slice, ok, error) of the slices tried this time."""
    done = ledger.done(spark, run)

    def one(name: str) -> None:
        try:
            load(name)
        except Exception as error:
            ledger.add(spark, name, run, False, f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}")
            raise
        ledger.add(spark, name, run, True, None)

    return backfill(spark, [name for name in slices if name not in done], one)


def backfill(spark: SparkSession, slices: Iterable[str], load: Callable[[str], None]) -> DataFrame:
    """Call `load(slice)` for each slice, going on after a failure; returns (slice, ok, error).

    For repairing parts of a table, where each slice is a job of its own; a whole table is loaded in one job instead.
    A slice that fails leaves its partitions as they were and is reported, never skipped silently.
    """
    outcome = []
    for one in slices:
        try:
            load(one)
            outcome.append((one, True, None))
        except Exception as error:  # noqa: BLE001 - recorded in the result
            outcome.append((one, False, f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"))
    return spark.createDataFrame(outcome, "slice string, ok boolean, error string")
