"""Deltas, compaction, the feed of signed changes, and marts that follow it."""

import random

import pytest
from pyspark.sql import functions as F

from lakeloom.operators import maintain, merge, scd2
from lakeloom.operators.maintain import Measures
from lakeloom.plans.batch import Ledger, resume
from lakeloom.plans.marts import Mart
from lakeloom.sinks.feed import ChangeFeed, replay
from lakeloom.streaming.programs import apply_batch, compact, first_seen, products_table, rebuild, run_cdc, users_table
from tests.conftest import rows
from tests.test_streaming import DRAIN, drop, follow, message, product


def frame(spark, messages):
    return spark.createDataFrame([(m,) for m in messages], "value string")


def user(id, name="a"):
    return {"id": id, "name": name, "phone": "1", "date_of_birth": 0}


def log(seed, count=60, keys=9):
    """Random product changes, in batches of ten, with late ones and deletes."""
    rng = random.Random(seed)
    changes = []
    for n in range(count):
        id, at = rng.randrange(keys), rng.randrange(40) * 1000
        changes.append(message("d", at, {"id": id}, n) if rng.random() < 0.25 else message("u", at, product(id, float(n)), n))
    return [changes[i:i + 10] for i in range(0, count, 10)]


def size(table, spark):
    return sum(held for held, _ in table.folders(spark, len(table.partition_by)).values())


def test_a_batch_writes_in_proportion_to_itself(spark, tmp_path):
    """500 keys of 50,000 are written, not the buckets they are in."""
    table = users_table(str(tmp_path))
    apply_batch(spark, table, frame(spark, [message("c", 1, user(i, f"name {i * 7919}")) for i in range(50_000)]), 0)
    whole, files = size(table.silver, spark), set(table.silver.read(spark).inputFiles())
    apply_batch(spark, table, frame(spark, [message("u", 2, user(i * 97, "new")) for i in range(500)]), 1)
    assert set(table.silver.read(spark).inputFiles()) == files
    assert 0 < size(table.deltas, spark) < whole / 5
    assert table.visible(spark).filter("name = 'new'").count() == 500 and table.visible(spark).count() == 50_000


@pytest.mark.parametrize("make", [products_table, users_table])
def test_deltas_compacted_and_rebuilt_show_the_same(spark, tmp_path, make):
    table = make(str(tmp_path), buckets=3)
    batches = log(1) if make is products_table else [
        [message("d" if (n + i) % 4 == 0 else "u", 1000 * ((7 * n + i) % 11), user(i, f"{n}"), n) for i in range(8)] for n in range(6)]
    for n, batch in enumerate(batches):
        apply_batch(spark, table, frame(spark, batch), n)
    shown = rows(table.visible(spark).select(sorted(table.visible(spark).columns)))
    compact(spark, table, share=0.0)
    assert not table.deltas.folders(spark, 3)
    assert rows(table.visible(spark).select(sorted(table.visible(spark).columns))) == shown
    assert rows(table.shown(table.silver.read(spark)).select(sorted(table.visible(spark).columns))) == shown
    rebuild(spark, table)
    assert rows(table.visible(spark).select(sorted(table.visible(spark).columns))) == shown and shown


def test_only_due_buckets_are_compacted(spark, tmp_path):
    table = users_table(str(tmp_path), buckets=4)
    apply_batch(spark, table, frame(spark, [message("c", 1, user(i, f"name {i * 7919}")) for i in range(20_000)]), 0)
    for n in range(1, 4):
        apply_batch(spark, table, frame(spark, [message("u", 1 + n, user(5, f"x{n}"))]), n)
    assert compact(spark, table) == [] and len(table.deltas.folders(spark, 3)) == 3
    files = set(table.silver.read(spark).inputFiles())
    assert len(compact(spark, table, files=2)) == 1 and not table.deltas.folders(spark, 3)
    assert len(files - set(table.silver.read(spark).inputFiles())) >= 1
    assert len(files & set(table.silver.read(spark).inputFiles())) >= 3
    assert rows(table.visible(spark).filter("id = 5"), "name") == [("x3",)]


def test_compaction_cut_off_before_the_deltas_went(spark, tmp_path):
    table = products_table(str(tmp_path), buckets=2)
    for n, batch in enumerate(log(2, 30)):
        apply_batch(spark, table, frame(spark, batch), n)
    shown = rows(table.visible(spark))
    table.silver.replace_partitions(table.state(spark))  # merged, but the deltas are still there
    assert rows(table.visible(spark)) == shown


@pytest.mark.parametrize("seed", [3, 4])
def test_the_feed_adds_up_to_what_readers_see(spark, tmp_path, seed):
    table = products_table(str(tmp_path), buckets=2)
    for n, batch in enumerate(log(seed, 50)):
        apply_batch(spark, table, frame(spark, batch), n, feed=True)
        if n == 2:
            compact(spark, table, share=0.0)
    columns = sorted(table.visible(spark).columns)
    assert rows(replay(table.feed.read(spark)).select(columns)) == rows(table.visible(spark).select(columns))


def test_a_repeated_batch_adds_nothing_to_the_feed(spark, tmp_path):
    table = users_table(str(tmp_path))
    batches = [[message("c", 1, user(1)), message("c", 1, user(2))], [message("u", 2, user(1, "b")), message("d", 2, {"id": 2})]]
    for n in (0, 1, 1, 0, 1):
        apply_batch(spark, table, frame(spark, batches[n]), n, feed=True)
    signed = rows(table.feed.read(spark), "_batch", "sign", "id", "name")
    assert signed == [(0, 1, 1, "a"), (0, 1, 2, "a"), (1, -1, 1, "a"), (1, -1, 2, "a"), (1, 1, 1, "b")]
    # A batch whose feed was cut off before the ledger is written once more, from the same state.
    table.feed.ledger.overwrite(spark.createDataFrame([("run", 0)], "_run string, _batch bigint"))
    assert rows(table.feed.read(spark), "_batch") == [(0,), (0,)]
    apply_batch(spark, table, frame(spark, batches[1]), 1, feed=True)
    assert rows(table.feed.read(spark), "_batch", "sign", "id", "name") == signed


def test_a_batch_that_changes_nothing(spark, tmp_path):
    table = users_table(str(tmp_path))
    for n, at in enumerate((5, 3)):
        apply_batch(spark, table, frame(spark, [message("c", at, user(1))]), n, feed=True)
    assert table.feed.read_batch(spark, "run", 1) is None and table.feed.holds(spark, "run", 1)
    assert ChangeFeed(str(tmp_path / "none")).read(spark) is None


def test_signed_changes_of_rows_that_repeat(spark):
    before = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, v string")
    after = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (3, "c")], "k int, v string")
    assert rows(merge.signed_changes(before, after), "k", "v", "sign") == [(1, "a", -1), (3, "c", 1), (3, "c", 1)]
    assert rows(merge.signed_changes(None, after.filter("k = 2")), "k", "sign") == [(2, 1)]


MEASURES = dict(by=("g",), sums={"total": "v"}, counts={"n": "v"}, edges={"low": ("min", "t"), "high": ("max", "t")})


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_maintained_aggregates_equal_a_full_recompute(spark, tmp_path, seed):
    rng = random.Random(seed)
    measures = Measures(**MEASURES)
    mart = Mart(str(tmp_path), "m", measures, buckets=3)
    made = lambda: (rng.choice([None, "a", "b", "c"]), rng.choice([None, 1, 2, 3]), rng.choice([None, *range(6)]))
    schema = "g string, v int, t int"
    held = [made() for _ in range(12)]
    mart.build(spark.createDataFrame(held, schema))
    for batch in range(4):
        gone = [held.pop(rng.randrange(len(held))) for _ in range(rng.randrange(min(6, len(held) + 1)))]
        come = [made() for _ in range(rng.randrange(5))]
        held += come
        signed = spark.createDataFrame([(*r, -1) for r in gone] + [(*r, 1) for r in come], f"{schema}, sign int")
        now = spark.createDataFrame(held, schema)
        for _ in range(1 + batch % 2):
            mart.refresh(spark, signed, now, "run", batch)
        assert rows(mart.read(spark).select("g", "total", "n", "low", "high")) == rows(
            maintain.totals(now, measures).select("g", "total", "n", "low", "high"))


def test_a_mart_from_nothing_that_becomes_empty(spark, tmp_path):
    mart = Mart(str(tmp_path), "m", Measures(**MEASURES), buckets=2)
    one = spark.createDataFrame([("a", 1, 5)], "g string, v int, t int")
    mart.refresh(spark, one.withColumn("sign", F.lit(1)), one, "run", 0)
    assert rows(mart.read(spark)) == [("a", 1, 1, 5, 5)]
    mart.refresh(spark, one.withColumn("sign", F.lit(-1)), one.limit(0), "run", 1)
    mart.refresh(spark, one.withColumn("sign", F.lit(-1)), one.limit(0), "run", 1)
    assert rows(mart.read(spark)) == []
    mart.refresh(spark, one.withColumn("sign", F.lit(1)), one, "other", 0)
    assert rows(mart.read(spark)) == [("a", 1, 1, 5, 5)]


def test_edges_are_looked_up_only_for_groups_that_lost_one(spark):
    measures = Measures(**MEASURES)
    state = maintain.aggregate(spark.createDataFrame([("a", 1, 1), ("a", 1, 9), ("b", 1, 1)], "g string, v int, t int"), measures)
    signed = spark.createDataFrame([("a", 1, 9, -1)], "g string, v int, t int, sign int")
    now = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "g string, v int, t int")
    after = maintain.maintained(state, maintain.signed_totals(signed, measures), now, measures)
    assert rows(after, "g", "total", "low", "high") == [("a", 1, 1, 1), ("b", 1, 1, 1)]
    assert "LeftSemi" in after._jdf.queryExecution().optimizedPlan().toString()


def test_messages_sent_again_are_kept_once(spark, tmp_path):
    table, inbox = users_table(str(tmp_path / "lake")), tmp_path / "in"
    drop(inbox, "1", message("c", 1000, user(1), 1), message("c", 1000, user(1), 1), "damaged", "damaged")
    drop(inbox, "2", message("c", 1000, user(1), 1), message("u", 500, user(1, "late"), 0), message("d", 1000, {"id": 1}, 1))
    stream = first_seen(follow(spark, inbox), table)
    run_cdc(stream, table, DRAIN).awaitTermination()
    kept = table.bronze.read(spark)
    assert rows(kept, "kind", "ts_ms", "lsn", "op") == sorted([
        ("upsert", 1000, 1, "c"), ("upsert", 500, 0, "u"), ("delete", 1000, 1, "d"), ("malformed", None, 0, None),
        ("malformed", None, 0, None)], key=repr)


def test_a_backfill_goes_on_where_it_failed(spark, tmp_path):
    ledger, tried = Ledger(str(tmp_path / "ledger")), []

    def load(one):
        tried.append(one)
        if one == "b" and tried.count("b") == 1:
            raise ValueError("no")
    assert rows(resume(spark, ledger, "r", ["a", "b", "c"], load), "slice", "ok") == [("a", True), ("b", False), ("c", True)]
    assert rows(resume(spark, ledger, "r", ["a", "b", "c"], load), "slice", "ok") == [("b", True)]
    assert resume(spark, ledger, "r", ["a", "b", "c"], load).count() == 0 and tried == ["a", "b", "c", "b"]
    assert resume(spark, ledger, "other", ["a"], load).count() == 1
    assert rows(ledger.read(spark).filter("run = 'r'"), "slice", "ok", "error") == sorted(
        [("a", True, None), ("b", False, "ValueError: no"), ("b", True, None), ("c", True, None)], key=repr)


def test_history_chains_only_the_keys_of_a_batch(spark, tmp_path):
    changes = "id int, ts_ms bigint, lsn bigint, deleted boolean, v string"
    spark.createDataFrame([(i, 1000, 0, False, "a") for i in range(500)], changes).write.parquet(str(tmp_path / "c"))
    scd2.versions(spark.read.parquet(str(tmp_path / "c")), ["id"]).write.parquet(str(tmp_path / "h"))
    history = spark.read.parquet(str(tmp_path / "h"))
    batch = spark.createDataFrame([(3, 2000, 0, False, "b")], changes)
    after = scd2.scd2(history, batch, ["id"])
    text = after._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in text and "LeftAnti" in text
    assert after.count() == 501 and rows(after.filter("id = 3"), "v", "is_current") == [("a", False), ("b", True)]
