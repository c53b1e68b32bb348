"""Marts that follow a feed of signed changes instead of being computed anew.

The state of a mart is a table of aggregates, cut into buckets by a hash of the group. A batch reads and replaces the buckets of its
groups only. Each bucket says, in a row of its own, which batch of each run it has last seen, and is replaced as a whole, so a batch
that is applied again changes nothing, also where a crash left some buckets before and some after it. Batches of a run come in order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators.maintain import Measures, aggregate, maintained, result, signed_totals
from lakeloom.plans import gold
from lakeloom.sources.lake import LakeTable
from lakeloom.streaming.programs import CdcTable

SEEN, BUCKET, MARK, PIECE = "_seen", "_bucket", "_mark", "_piece"
PIECE_BYTES = 16 << 20  # of a bucket's files that one task brings together with a batch


def _unseen() -> Column:
    return F.lit(None).cast("map<string,bigint>")


@dataclass(frozen=True)
class Mart:
    """Aggregates below `root`, kept up to date from signed rows."""

    root: str
    name: str
    measures: Measures
    buckets: int = 64

    @property
    def table(self) -> LakeTable:
        return LakeTable(f"{self.root}/marts/{self.name}", (BUCKET,))

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*self.measures.by), F.lit(self.buckets)).cast("int"))

    def build(self, rows: DataFrame) -> None:
        """The state of all rows, which have seen no batch of a feed."""
        state = self._dealt(aggregate(rows, self.measures))
        self.table.overwrite(state.withColumns({SEEN: _unseen(), MARK: F.lit(False)}))

    def refresh(self, spark: SparkSession, signed: DataFrame, rows: DataFrame | Callable[[DataFrame], DataFrame], run: str,
                batch_id: int) -> None:
        """Apply a batch of signed rows, a table; `rows` are all rows as they are now, or a function that finds those of some groups."""
        signed = self._dealt(signed)
        # Numbers of buckets, of which there are few; buckets that have seen the batch stay as they are.
        due = [row[0] for row in signed.select(BUCKET).distinct().collect()]
        held, seen, size = None, None, 0
        if self.table.exists(spark):
            held = self.table.read(spark, F.col(BUCKET).isin(due))
            seen = held.filter(F.col(MARK)).select(BUCKET, SEEN)
            known = {row[0]: row[1] or {} for row in seen.collect()}
            due = [bucket for bucket in due if known.get(bucket, {}).get(run, batch_id - 1) < batch_id]
            size = sum(size for size, _ in self.table.folders(spark, 1).values())
        if not due:
            return
        # A row per bucket: joins to them leave the groups where they are.
        buckets = spark.range(1).select(F.explode(F.lit(due).cast("array<int>")).alias(BUCKET))
        pieces = max(1, -(-size // (self.buckets * PIECE_BYTES)))

        def placed(groups: DataFrame) -> DataFrame:
            return groups.join(F.broadcast(buckets), BUCKET, "left_semi").withColumn(
                PIECE, F.pmod(F.shiftright(F.xxhash64(*self.measures.by), 24), F.lit(pieces)).cast("int"))

        changes = placed(self._dealt(signed_totals(signed, self.measures)))
        state = None if held is None else placed(held.filter(~F.col(MARK)).drop(SEEN, MARK))
        after = maintained(state, changes, rows, self.measures, along=(BUCKET, PIECE))
        columns = [*self.measures.by, *self.measures.kept(), *self.measures.edges]
        # A bucket keeps a row without a group, so that an empty one also knows what it has seen.
        kinds = dict(after.dtypes)
        marks = buckets.withColumn(SEEN, _unseen()) if seen is None else buckets.join(F.broadcast(seen), BUCKET, "left")
        others = F.map_filter(F.coalesce(F.col(SEEN), F.expr("CAST(map() AS map<string,bigint>)")), lambda k, _: k != run)
        marks = marks.select(*[F.lit(None).cast(kinds[name]).alias(name) for name in columns], BUCKET, F.lit(True).alias(MARK),
                             F.map_concat(others, F.create_map(F.lit(run), F.lit(batch_id).cast("bigint"))).alias(SEEN))
        new = after.select(*columns, BUCKET, F.lit(False).alias(MARK), _unseen().alias(SEEN)).unionByName(marks)
        # The groups of a bucket met in as many tasks as it has pieces, and are written there, unless edges were found anew.
        self.table.replace_partitions(new, clustered=not self.measures.edges)

    def read(self, spark: SparkSession) -> DataFrame:
        return result(self.table.read(spark).filter(~F.col(MARK)), self.measures)


def sales(root: str, buckets: int = 64) -> Mart:
    return Mart(root, "sales", gold.sales_measures(), buckets)


def lifetime(root: str, buckets: int = 64) -> Mart:
    return Mart(root, "lifetime", gold.lifetime_measures(), buckets)


def follow_orders(spark: SparkSession, marts: list[Mart], orders: CdcTable, run: str, batch_id: int) -> None:
    """Bring marts up to date with one batch of the orders stream (a table with a feed)."""
    signed = orders.feed.read_batch(spark, run, batch_id)
    if signed is not None:
        for mart in marts:
            wanted = [*mart.measures.by, *[column for _, column in mart.measures.edges.values()]]
            mart.refresh(spark, signed, lambda groups, wanted=wanted: orders.visible_of(spark, groups, wanted), run, batch_id)

