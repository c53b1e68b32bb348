"""Continuous loads: change messages to bronze, silver and, if wanted, the serving store.

Every micro-batch writes its parsed messages to its own partition of the change table, and its changes to its own partitions of
the deltas, beside the silver partitions they belong to: what a batch writes grows with the batch, not with the table. Readers see
silver with its deltas merged (`CdcTable.state`), and only rows of keys with deltas are merged for it. A bucket whose deltas have
grown against it, or are many files, is compacted: merged into silver once for many batches.

State and history are functions of the set of changes, so all steps give the same tables when a batch is repeated: a stream
that is restarted after a crash, or replayed from an older offset, neither loses nor repeats a change, and a compaction that was cut off
before it removed the deltas does no harm. Batches are told apart by run and number: a stream with a new checkpoint counts from 0
again but never replaces what an earlier run wrote.

A stream may follow a batch load into the same silver tables. The loaded rows are adopted once, as changes older than any
in the stream, and kept aside as the base that silver is a function of, together with the change table (`rebuild`).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakeloom.functions.bands import bucket_key, decade, price_range, year_month
from lakeloom.operators import cdc, merge, scd2
from lakeloom.operators.dedupe import split_repeated
from lakeloom.schemas import ORDERS, PRODUCTS, USERS
from lakeloom.sinks.feed import BATCH, ChangeFeed
from lakeloom.sources.lake import LakeTable, committed, compact_by

BUCKETS = 20
# A bucket is compacted when its deltas have more than this share of its bytes, or more files than this.
DELTA_SHARE, DELTA_FILES = 0.5, 64
# With more deltas than this share of the table's bytes, readers sort both together: looking up the keys would shuffle the table twice.
MOST = 0.1


@dataclass(frozen=True)
class CdcTable:
    """A table fed by a change stream.

    mode 'upsert' keeps the latest row per key, 'scd2' every version. `derive` adds the columns that follow from the row;
    `bucket` names the silver partition columns, which follow from the key alone, so that all rows of a key are in one
    partition and a batch is merged into the partitions of its own keys only.
    """

    name: str
    root: str
    fields: Mapping[str, str]
    keys: tuple[str, ...]
    mode: str = "upsert"
    derive: Callable[[], Mapping[str, Column]] = dict
    bucket: Callable[[], Mapping[str, Column]] = dict
    bronze_by: tuple[str, ...] = ()
    encodings: Mapping[str, str] = field(default_factory=dict)
    fmt: str = "parquet"
    checkpoints: str = "checkpoints"

    @property
    def bronze(self) -> LakeTable:
        """The parsed messages. They have their own place: the bronze tables of a batch load hold rows, not changes."""
        return LakeTable(f"{self.root}/changes/{self.name}", ("_run", "_batch", *self.bronze_by), self.fmt)

    @property
    def base(self) -> LakeTable:
        """What a batch load had put into silver before the first change."""
        return LakeTable(f"{self.root}/base/{self.name}", (), self.fmt)

    @property
    def silver(self) -> LakeTable:
        return LakeTable(f"{self.root}/silver/{self.name}", tuple(self.bucket()), self.fmt)

    @property
    def deltas(self) -> LakeTable:
        """Changes that silver does not have yet."""
        return LakeTable(f"{self.root}/deltas/{self.name}", (*self.bucket(), *BATCH), self.fmt)

    @property
    def feed(self) -> ChangeFeed:
        return ChangeFeed(f"{self.root}/feed/{self.name}")

    @property
    def checkpoint(self) -> str:
        return f"{self.root}/{self.checkpoints}/{self.name}"

    def parse(self, messages: DataFrame) -> DataFrame:
        parsed = cdc.parse(messages, self.fields, list(self.keys), self.encodings)
        return parsed.withColumns(dict(self.derive())) if self.derive() else parsed

    def merge(self, state: DataFrame | None, changes: DataFrame, most: bool = False) -> DataFrame:
        """The state after changes. Changes to `most` of the rows are sorted together with them; of others the keys are looked up
        first, which leaves the rest of the state in place."""
        upsert = merge.upsert if most else merge.upsert_touched
        return (scd2.scd2 if self.mode == "scd2" else upsert)(state, changes, list(self.keys))

    def by_key(self, rows: DataFrame) -> tuple[DataFrame, DataFrame] | None:
        """(rows that are the state of their key by themselves, other rows), found without moving the rows; None if they have to be
        merged together: if too many keys repeat, or every version is kept. `rows` should be a table."""
        return split_repeated(rows, list(self.keys)) if self.mode == "upsert" else None

    def in_place(self, single: DataFrame, repeated: DataFrame) -> DataFrame:
        """The state of rows `by_key` that are in files of silver's buckets, for a clustered write: only repeated keys move."""
        return single.unionByName(compact_by(self.merge(None, repeated), self.silver.partition_by))

    def state(self, spark: SparkSession, where: Column | None = None, of: DataFrame | None = None,
              without: tuple[str, int] | None = None) -> DataFrame | None:
        """Silver with its deltas merged, None if there is nothing; `where` selects buckets, `of` keys, and `without` leaves out the deltas of
        one batch (run, number)."""
        def part(table: LakeTable) -> DataFrame | None:
            if not table.exists(spark):
                return None
            rows = table.read(spark, where)
            return rows if of is None else merge.lookup_existing(rows, of, list(self.keys))

        held, late = part(self.silver), part(self.deltas)
        if late is None:
            return held
        if without is not None:
            late = late.filter(~((F.col("_run").cast("string") == without[0]) & (F.col("_batch") == without[1])))
        return self.merge(held, late.drop(*BATCH), most=of is not None or self._late_share(spark) > MOST)

    def _late_share(self, spark: SparkSession) -> float:
        """The bytes of the deltas against those of silver."""
        levels = len(self.bucket())
        late, held = (sum(size for size, _ in table.folders(spark, levels).values()) for table in (self.deltas, self.silver))
        return late / max(held, 1)

    def visible(self, spark: SparkSession) -> DataFrame:
        """Silver as its readers see it."""
        return self.shown(self.state(spark))

    def visible_of(self, spark: SparkSession, of: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
        """The rows that readers see with the values of `of`, a table of some key columns (where null equals null). Only rows with
        these values are merged, and if nothing but key columns is asked for, only what tells whether a key is there."""
        if self.mode != "upsert" or not set(of.columns) <= set(self.keys) or not self.deltas.exists(spark):
            rows, merged = self.visible(spark), True
        else:
            held = self.silver.read(spark)
            few = columns is not None and set(columns) <= set(self.keys)
            names = [*self.keys, *cdc.SEQUENCE, "deleted"] if few else held.columns
            rows, merged = held.select(*names).unionByName(self.deltas.read(spark).select(*names)), False
        values, match = of.select(*[F.col(name).alias(f"_of_{name}") for name in of.columns]), F.lit(True)
        for name in of.columns:
            match = match & F.col(name).eqNullSafe(F.col(f"_of_{name}"))
        rows = rows.join(values, match, "left_semi")
        return rows if merged else self.shown(self.merge(None, rows))

    def shown(self, state: DataFrame) -> DataFrame:
        """The rows of a state that readers see; of a table that no stream has written, all."""
        hide = scd2.visible if self.mode == "scd2" else merge.visible
        return hide(state) if "deleted" in state.columns else state


def users_table(root: str, encodings: Mapping[str, str] | None = None, buckets: int = BUCKETS) -> CdcTable:
    """Users: upserted; `created_at` is the day of the change, so that it does not depend on when the stream ran."""
    return CdcTable(
        "users", root, USERS, ("id",), encodings=encodings or {"date_of_birth": "micros"}, bronze_by=("birth_decade",),
        derive=lambda: {"birth_decade": decade("date_of_birth"),
                        "created_at": F.to_date(F.timestamp_millis("ts_ms"))},
        bucket=lambda: {"partition_key": bucket_key("id", buckets=buckets)})


def products_table(root: str, buckets: int = BUCKETS) -> CdcTable:
    """Products: every version is kept."""
    return CdcTable(
        "products", root, PRODUCTS, ("id",), mode="scd2", bronze_by=("price_range",),
        derive=lambda: {"price_range": price_range("price")},
        bucket=lambda: {"partition_key": bucket_key("id", buckets=buckets)})


def orders_table(root: str, encodings: Mapping[str, str] | None = None) -> CdcTable:
    """Orders: upserted by the composite key, partitioned by the month, which follows from the key."""
    return CdcTable(
        "orders", root, ORDERS, ("user_id", "product_id", "date"), encodings=encodings or {"date": "micros"},
        bucket=lambda: year_month("date"))


TABLES = {"users": users_table, "products": products_table, "orders": orders_table}


def apply_batch(spark: SparkSession, table: CdcTable, messages: DataFrame, batch_id: int,
                publish: Callable[[DataFrame, int], None] | None = None, run: str = "run", feed: bool = False) -> None:
    """One micro-batch: changes, silver, then `publish(rows, batch_id)` with the silver rows of the batch's keys. `run`
    names the checkpoint that numbers the batches. With `feed` the signed rows of what changed for readers go to `table.feed`."""
    if messages.isEmpty():
        return
    parsed = table.parse(messages).withColumns({"_run": F.lit(run), "_batch": F.lit(batch_id).cast("bigint")})
    # A batch is one partition, unless the table has more levels: each task writes its messages where they are.
    table.bronze.replace_partitions(parsed, clustered=not table.bronze_by)

    # Read the batch back from bronze: later steps neither read the source again nor depend on cached blocks of an
    # executor that may be lost.
    changes = cdc.accepted(table.bronze.read_partition(spark, _run=run, _batch=batch_id))
    changes = changes.select(*table.fields, *table.derive(), *cdc.SEQUENCE, "deleted").withColumns(dict(table.bucket()))
    if table.silver.exists(spark):
        adopt(spark, table)
    if feed and not table.feed.holds(spark, run, batch_id):
        # Before the batch counts for readers, so that a batch repeated after a crash gives the same signed rows.
        table.feed.write(signed_batch(spark, table, changes, run, batch_id), run, batch_id)
    _commit(spark, table, changes, run, batch_id)
    if publish is not None:
        publish(table.state(spark, _touched(table, changes), changes), batch_id)


def signed_batch(spark: SparkSession, table: CdcTable, changes: DataFrame, run: str, batch_id: int) -> DataFrame:
    """What a batch changes for readers: signed rows of its keys. Other keys are read, but not merged or compared."""
    before = table.state(spark, _touched(table, changes), changes, without=(run, batch_id))
    if before is not None:
        before = committed(before, "before")  # merged and compared, and finding it shuffles the table
    if table.mode == "upsert" and before is not None:
        return merge.signed_upsert(before, changes, list(table.keys))
    after = table.shown(table.merge(before, changes, most=True))
    return merge.signed_changes(None if before is None else table.shown(before), after)


def _commit(spark: SparkSession, table: CdcTable, changes: DataFrame, run: str, batch_id: int) -> None:
    if not table.silver.exists(spark):
        parts = table.by_key(changes)
        table.silver.replace_partitions(
            table.merge(None, changes) if parts is None else parts[0].unionByName(table.merge(None, parts[1])))
        return
    named = changes.withColumns({"_run": F.lit(run), "_batch": F.lit(batch_id).cast("bigint")})
    table.deltas.replace_partitions(named)
    compact(spark, table)


def compact(spark: SparkSession, table: CdcTable, share: float = DELTA_SHARE, files: int = DELTA_FILES) -> list[str]:
    """Merge the deltas of buckets into silver where they have more than `share` of the bucket's bytes or more than `files` files;
    returns these buckets. Only they are read and written."""
    levels = len(table.bucket())
    held, late_held = table.silver.folders(spark, levels), table.deltas.folders(spark, levels)
    due = [bucket for bucket, (size, count) in late_held.items()
           if size > share * held.get(bucket, (0, 0))[0] or count > files]
    if not due:
        return []
    merged = [folder for folder in table.deltas.folders(spark, levels + len(BATCH))
              if folder.rsplit("/", len(BATCH))[0] in set(due)]
    late = spark.read.option("basePath", table.deltas.path).format(table.fmt).load(
        [f"{table.deltas.path}/{folder}" for folder in merged]).drop(*BATCH)
    state = table.silver.read(spark, _touched(table, late))
    parts = None
    if table.mode == "upsert" and all(count + held.get(bucket, (0, 0))[1] <= files for bucket, (_, count) in late_held.items() if bucket in due):
        # Few files: both are in files of the same buckets, which become files of silver, and are brought together once they are many.
        parts = table.by_key(state.unionByName(late.select(*state.columns)))
    if parts is None:
        table.silver.replace_partitions(table.merge(state, late, most=True))
    else:
        table.silver.replace_partitions(table.in_place(*parts), clustered=True)
    table.deltas.remove(spark, merged)
    return due


def adopt(spark: SparkSession, table: CdcTable) -> None:
    """Give silver rows of a batch load the columns that order changes; nothing for a table that has them.

    A loaded row counts as a change at the day it is valid from, or was created; without such a day, as the first of
    all. This rewrites the table once. The rows are kept as the base first, so an adoption that is cut off is mended by `rebuild`.
    """
    rows = table.silver.read(spark)
    if "deleted" in rows.columns:
        return
    day = next((F.col(name) for name in ("valid_from", "created_at") if name in rows.columns), None)
    since = F.lit(0).cast("bigint") if day is None else F.coalesce(
        F.unix_date(day.cast("date")).cast("bigint") * 86_400_000, F.lit(0).cast("bigint"))
    base = rows.withColumns({"ts_ms": since, "lsn": F.lit(-1).cast("bigint"), "deleted": F.lit(False)})
    typed = [F.col(name).cast(kind).alias(name) for name, kind in table.fields.items()]
    table.base.overwrite(base.select(*typed, *table.derive(), *cdc.SEQUENCE, "deleted"), clustered=True)
    # The base has the rows in the order of silver's files. A load leaves one row per key, so hardly any have to move.
    base = table.base.read(spark).withColumns(dict(table.bucket()))
    parts = table.by_key(base)
    if parts is None:
        table.silver.overwrite(table.merge(None, base))
    else:
        table.silver.overwrite(table.in_place(*parts), clustered=True)


def first_seen(stream: DataFrame, table: CdcTable, within: str = "1 day") -> DataFrame:
    """The messages of a stream without those that a connector sends again: of usable messages with the same key, ts_ms and lsn the
    first to arrive stays, and those that arrive no more than `within` later go. Messages that are not usable all pass, as the change
    table keeps them. The state holds the identities that arrived in that time. It goes by arrival, so no late change is dropped.

    Silver does not need this, since a change that is applied again is the same; it keeps the change table and the bytes
    of a batch small when a source is re-read.
    """
    named = stream.select(F.col("value").alias("_message"))  # a field of the table may have that name
    parsed = cdc.parse(named, table.fields, list(table.keys), table.encodings, value="_message", keep=["_message"])
    usable = F.col("kind").isin(*cdc.ACCEPTED)
    sent = parsed.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", within)
    once = sent.filter(usable).dropDuplicatesWithinWatermark([*table.keys, *cdc.SEQUENCE, "op"])
    return once.union(sent.filter(~usable)).select(F.col("_message").alias("value"))


def run_of(spark: SparkSession, checkpoint: str) -> str:
    """The id of the stream that a checkpoint belongs to; a new checkpoint has a new one."""
    return spark.read.json(f"{checkpoint}/metadata").first()["id"]


def _touched(table: CdcTable, changes: DataFrame) -> Column:
    return table.silver.touched(changes.withColumns(dict(table.bucket())))


def rebuild(spark: SparkSession, table: CdcTable) -> None:
    """Silver from the base and all changes, in one job: the repair for a commit that was cut off."""
    changes = cdc.accepted(table.bronze.read(spark)).select(*table.fields, *table.derive(), *cdc.SEQUENCE, "deleted")
    if table.base.exists(spark):
        changes = table.base.read(spark).select(*changes.columns).unionByName(changes)
    table.silver.overwrite(table.merge(None, changes.withColumns(dict(table.bucket()))))
    table.deltas.remove(spark)


def run_cdc(stream: DataFrame, table: CdcTable, trigger: Mapping[str, object] | None = None,
            publish: Callable[[DataFrame, int], None] | None = None, feed: bool = False,
            after: Callable[[str, int], None] | None = None) -> StreamingQuery:
    """Start the stream of messages into its tables; every two minutes unless `trigger` says otherwise. `after(run, batch_id)` is called
    when a batch is committed, as to bring marts up to date from its feed."""
    spark = stream.sparkSession

    def one(batch: DataFrame, batch_id: int) -> None:
        run = run_of(spark, table.checkpoint)
        apply_batch(spark, table, batch, batch_id, publish, run, feed)
        if after is not None:
            after(run, batch_id)

    return (stream.writeStream.queryName(f"cdc_{table.name}").foreachBatch(one)
            .outputMode("append").option("checkpointLocation", table.checkpoint)
            .trigger(**(trigger or {"processingTime": "2 minutes"})).start())


def run_all(streams: list[tuple[DataFrame, CdcTable]], trigger: Mapping[str, object] | None = None,
            publish: Mapping[str, Callable[[DataFrame, int], None]] | None = None, feed: bool = False) -> None:
    """Run several streams side by side in one session until all have ended or one has failed. `publish` names the steps
    that send the rows of a batch's keys on, by table name; with `feed` every table has a feed of signed changes."""
    steps = publish or {}
    started = [run_cdc(stream, table, trigger, steps.get(table.name), feed) for stream, table in streams]
    try:
        for one in started:
            one.awaitTermination()
    finally:
        for one in started:
            if one.isActive:
                one.stop()
