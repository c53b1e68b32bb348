"""What whole loads shuffle: plans of the tables they write."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401 (registers queries)
from lakeloom.catalog.registry import QUERIES
from lakeloom.operators import merge
from lakeloom.operators.dedupe import split_repeated
from lakeloom.operators.maintain import Measures, aggregate, maintained, signed_totals
from lakeloom.plans import marts
from lakeloom.plans.marts import Mart
from lakeloom.sources.lake import LakeTable, committed, compact_by
from lakeloom.streaming import programs
from lakeloom.streaming.programs import CdcTable, apply_batch, compact

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def written(monkeypatch):
    """(table path, plan) of every write of a table."""
    seen = []
    for name in ("overwrite", "replace_partitions"):
        def write(table, df, *args, _kept=getattr(LakeTable, name), **options):
            seen.append((table.path, df._jdf.queryExecution().optimizedPlan().toString()))
            return _kept(table, df, *args, **options)
        monkeypatch.setattr(LakeTable, name, write)
    return seen


def test_backfill_joins_once(spark, written):
    QUERIES["backfill_years"](spark, SMALL)
    slices = [plan for path, plan in written if path.endswith("/bronze")]
    assert len(slices) > 2 and not any("Join" in plan for plan in slices)
    assert len(written) == len(slices) + 1


def test_rows_in_order_are_written_without_a_shuffle(spark, table_dir):
    rows = spark.range(40).selectExpr("id", "id % 3 AS part")
    table = LakeTable(table_dir, ("part",))
    table.overwrite(compact_by(committed(rows, "rows"), ("part",)), clustered=True)
    assert sorted(r.id for r in table.read(spark).collect()) == list(range(40))
    assert set(table.folders(spark, 1)) == {"part=0", "part=1", "part=2"}
    table.overwrite(rows.filter("part > 0"), clustered=True)
    assert set(table.folders(spark, 1)) == {"part=1", "part=2"}


def test_mart_is_shuffled_by_month_once(spark, written):
    QUERIES["gold_roundtrip"](spark, SMALL)
    assert len(written) == 2 and not any("Aggregate" in plan or "Join" in plan for _, plan in written)


def test_clustered_write_has_no_exchange(spark, table_dir, monkeypatch):
    asked = []
    monkeypatch.setattr("lakeloom.sources.lake.compact_by", lambda df, columns: asked.append(columns) or df)
    table = LakeTable(table_dir, ("part",))
    table.overwrite(spark.range(4).selectExpr("id", "id % 2 AS part"), clustered=True)
    assert not asked
    table.overwrite(spark.range(4).selectExpr("id", "id % 2 AS part"))
    assert asked == [("part",)]


def test_only_repeated_keys_move(spark):
    rows = committed(spark.range(1000).selectExpr("id % 990 AS k", "CAST(null AS int) AS n", "id"), "rows")
    single, repeated = split_repeated(rows, ["k", "n"])
    assert single.count() == 980 and sorted({r.k for r in repeated.collect()}) == list(range(10)) and repeated.count() == 20
    assert "Exchange hashpartitioning" not in single._jdf.queryExecution().executedPlan().toString()
    assert split_repeated(rows, ["k", "n"], few=9) is None
    assert split_repeated(rows.limit(0), ["k"])[0].count() == 0


def test_load_moves_no_silver_row_whose_key_is_its_own(spark, written):
    QUERIES["batch_lifetime_value"](spark, SMALL)
    plans = [plan for path, plan in written if path.endswith("/silver/orders")]
    assert len(plans) == 1 and "LeftAnti" in plans[0] and "LeftSemi" in plans[0]


def test_the_joins_of_two_loads_run_once(spark, written):
    QUERIES["batch_top_products"](spark, SMALL)
    plans = [plan for path, plan in written if path.endswith("/bronze/orders")]
    assert len(plans) == 2 and not any("Join" in plan for plan in plans)


def test_large_batches_move_only_repeated_keys(spark, written, table_dir, no_broadcast):
    """The first batch and a compaction: rows whose key is theirs alone are not sorted by key, with the state that sorting gives."""
    table = CdcTable("t", table_dir, {"k": "bigint", "v": "int"}, ("k",), bucket=lambda: {"part": F.pmod("k", F.lit(3))})
    row = '{{"after": {{"k": {}, "v": {}}}, "source": {{"ts_ms": {}, "lsn": 0}}, "op": "c"}}'
    first = [row.format(k, 0, 1) for k in range(100)] + [row.format(5, 1, 2)]
    second = [row.format(k, 2, 3) for k in range(99, 260)] + [row.format(7, 9, 0)]
    for batch, messages in enumerate((first, second)):
        apply_batch(spark, table, spark.createDataFrame([(m,) for m in messages], "value string"), batch)
    plans = [plan for path, plan in written if path == table.silver.path]
    assert len(plans) == 2 and all("LeftAnti" in plan and "LeftSemi" in plan for plan in plans)
    assert "Rebalance" not in plans[1].split("LeftAnti")[0] and not table.deltas.exists(spark)
    found = {r.k: r.v for r in table.visible(spark).collect()}
    assert found == {**{k: 0 for k in range(99)}, 5: 1, **{k: 2 for k in range(99, 260)}} and table.visible(spark).count() == 260


def test_many_files_are_brought_together(spark, written, table_dir):
    table = CdcTable("t", table_dir, {"k": "bigint", "v": "int"}, ("k",), bucket=lambda: {"part": F.lit(0)})
    row = '{{"after": {{"k": {}, "v": 0}}, "source": {{"ts_ms": 1, "lsn": 0}}, "op": "c"}}'
    for batch in range(3):
        messages = [(row.format(1000 * batch + k),) for k in range(500)]
        apply_batch(spark, table, spark.createDataFrame(messages, "value string"), batch)
    compact(spark, table, share=0.0, files=1)
    assert table.silver.folders(spark, 1)["part=0"][1] == 1 and table.visible(spark).count() == 1500


def test_marts_are_not_shuffled_by_bucket_to_find_what_they_saw(spark, table_dir, no_broadcast, monkeypatch):
    mart = Mart(table_dir, "m", Measures(("g",), sums={"s": "v"}))
    mart.build(spark.range(100).selectExpr("id AS g", "1 AS v"))
    plans = []
    kept = LakeTable.replace_partitions
    monkeypatch.setattr(LakeTable, "replace_partitions", lambda table, df, **options: (
        plans.append(df._jdf.queryExecution().executedPlan().toString()), kept(table, df, **options)))
    signed = spark.range(50).selectExpr("id AS g", "2 AS v", "1 AS sign")
    for _ in range(2):
        mart.refresh(spark, signed, signed, "run", 0)
    assert len(plans) == 1 and plans[0].count("BroadcastHashJoin") >= 3
    assert {r.g: r.s for r in mart.read(spark).collect()} == {g: 3 if g < 50 else 1 for g in range(100)}


def test_rows_of_a_batch_before_it_are_found_once(spark, table_dir, monkeypatch):
    labels = []
    kept = programs.committed
    monkeypatch.setattr(programs, "committed", lambda df, label: labels.append(label) or kept(df, label))
    table = CdcTable("t", table_dir, {"k": "bigint", "v": "int"}, ("k",), bucket=lambda: {"part": F.lit(0)})
    row = '{{"after": {{"k": 1, "v": {}}}, "source": {{"ts_ms": {}, "lsn": 0}}, "op": "u"}}'
    for batch in range(2):
        apply_batch(spark, table, spark.createDataFrame([(row.format(batch, batch),)], "value string"), batch, feed=True)
    assert labels == ["before"]
    assert sorted((r.v, r.sign) for r in table.feed.read(spark).collect()) == [(0, -1), (0, 1), (1, 1)]


def test_a_batch_meets_a_mart_in_one_shuffle(spark, table_dir, no_broadcast, monkeypatch):
    mart = Mart(table_dir, "m", Measures(("g",), sums={"s": "v"}), buckets=4)
    mart.build(spark.range(100).selectExpr("id AS g", "1 AS v"))
    plans, totals = [], []
    kept, found = LakeTable.replace_partitions, marts.signed_totals
    monkeypatch.setattr(marts, "signed_totals", lambda *args: totals.append(1) or found(*args))
    monkeypatch.setattr(LakeTable, "replace_partitions", lambda table, df, **options: (
        plans.append(df._jdf.queryExecution().executedPlan().toString()), kept(table, df, **options)))
    signed = spark.range(50).selectExpr("id AS g", "2 AS v", "1 AS sign")
    for _ in range(2):
        mart.refresh(spark, signed, signed, "run", 0)
    # The rows of a range are by group already. A batch that all its buckets have seen is not added up.
    assert len(plans) == 1 and plans[0].count("Exchange hashpartitioning") == 1 and "Rebalance" not in plans[0] and "SortMergeJoin" not in plans[0]
    assert len(totals) == 1 and mart.table.folders(spark, 1).keys() == {f"_bucket={n}" for n in range(4)}
    assert {r.g: r.s for r in mart.read(spark).collect()} == {g: 3 if g < 50 else 1 for g in range(100)}


def test_an_updated_row_at_the_edge_is_not_looked_up(spark):
    measures = Measures(("g",), sums={"s": "v"}, edges={"low": ("min", "t"), "high": ("max", "t")})
    schema, asked = "g int, v int, t int", []
    state = aggregate(spark.createDataFrame([(g, 1, t) for g in (1, 2, 3) for t in (1, 5, 9)], schema), measures)
    signed = spark.createDataFrame([(1, 1, 1, -1), (1, 2, 1, 1), (2, 1, 9, -1), (3, 1, 1, -1), (3, 1, 0, 1)], f"{schema}, sign int")
    now = spark.createDataFrame([(2, 1, 1), (2, 1, 5)], schema)

    def rows(groups):
        asked.extend(r.g for r in groups.collect())
        return now

    after = maintained(state, signed_totals(signed, measures), rows, measures)
    assert {(r.g, r.s, r.low, r.high) for r in after.collect()} == {(1, 4, 1, 9), (2, 2, 1, 5), (3, 3, 0, 9)}
    assert asked == [2]


def test_rows_of_some_groups_are_found_before_they_are_merged(spark, table_dir, no_broadcast):
    table = CdcTable("t", table_dir, {"k": "bigint", "d": "int", "v": "int"}, ("k", "d"), bucket=lambda: {"part": F.lit(0)})
    row = '{{"{}": {{"k": {}, "d": {}, "v": {}}}, "source": {{"ts_ms": {}, "lsn": 0}}, "op": "{}"}}'
    first = [row.format("after", k, d, 0, 1, "c") for k in range(1000) for d in range(3)]
    second = [row.format("before", 5, 0, 0, 2, "d"), row.format("after", 5, 1, 7, 2, "u"), row.format("after", 6, 9, 7, 2, "c")]
    for batch, messages in enumerate((first, second)):
        apply_batch(spark, table, spark.createDataFrame([(m,) for m in messages], "value string"), batch, feed=True)
    assert table.deltas.exists(spark)
    some = spark.createDataFrame([(5,), (6,)], "k bigint")
    every = table.visible_of(spark, some)
    assert sorted((r.k, r.d, r.v) for r in every.collect()) == [(5, 1, 7), (5, 2, 0), (6, 0, 0), (6, 1, 0), (6, 2, 0), (6, 9, 7)]
    keys = table.visible_of(spark, some, ["k", "d"])
    assert sorted(map(tuple, keys.select("k", "d").collect())) == [(5, 1), (5, 2), (6, 0), (6, 1), (6, 2), (6, 9)] and "v" not in keys.columns
    plan = every._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("LeftSemi")
    signed = table.feed.read_batch(spark, "run", 1)
    assert sorted((r.k, r.d, r.v, r.sign) for r in signed.collect()) == [(5, 0, 0, -1), (5, 1, 0, -1), (5, 1, 7, 1), (6, 9, 7, 1)]


def test_signed_upsert_is_what_two_states_differ_by(spark):
    kinds = "k int, v int, ts_ms bigint, lsn bigint, deleted boolean"
    before = spark.createDataFrame([(1, 1, 5, 0, False), (2, 1, 5, 0, True), (3, None, 5, 0, False), (4, 1, 5, 0, False)], kinds)
    changes = spark.createDataFrame([(1, 2, 4, 0, False), (2, 3, 6, 0, False), (3, None, 7, 0, False), (4, 1, 6, 0, True),
                                     (5, 1, 1, 0, False), (5, 2, 1, 0, False), (6, 1, 1, 0, True)], kinds)
    after = merge.upsert(before, changes, ["k"])
    expected = merge.signed_changes(merge.visible(before), merge.visible(after))
    found = merge.signed_upsert(before, changes, ["k"])
    assert found.columns == expected.columns
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect())) == [(2, 3, 1), (4, 1, -1), (5, 2, 1)]
