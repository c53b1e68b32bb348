import dataclasses
import json

import pytest
from pyspark.sql import functions as F

from lakeloom.operators import merge
from lakeloom.plans.batch import Lake, load_gold, run_batch
from lakeloom.sources.changes import cdc_stream
from lakeloom.streaming.programs import apply_batch, orders_table, products_table, rebuild, run_all, run_cdc, users_table
from tests.conftest import rows

DRAIN = {"availableNow": True}


def message(op, ts_ms, row, lsn=0):
    body = {"before": row} if op == "d" else {"after": row}
    return json.dumps({**body, "source": {"lsn": lsn}, "op": op, "ts_ms": ts_ms})


def product(id, price, name="p"):
    return {"id": id, "name": name, "price": price}


def drop(folder, name, *messages):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("".join(m + "\n" for m in messages))


def follow(spark, folder, **options):
    return cdc_stream(spark, "files", path=str(folder), options={"maxFilesPerTrigger": "1", **options})


def test_stream_restarts_where_it_stopped(spark, tmp_path):
    table, inbox = products_table(str(tmp_path / "lake")), tmp_path / "in"
    drop(inbox, "1", message("c", 1000, product(1, 10.0)), message("c", 1000, product(2, 950.0)), "damaged")
    run_cdc(follow(spark, inbox), table, DRAIN).awaitTermination()
    drop(inbox, "2", message("u", 3000, product(1, 300.0)), message("d", 2000, {"id": 2}))
    drop(inbox, "3", message("u", 2000, product(1, 200.0)))  # late
    run_cdc(follow(spark, inbox), table, DRAIN).awaitTermination()
    got = rows(table.visible(spark), "id", "price", "price_range", F.unix_seconds(F.col("valid_from").cast("timestamp")),
               F.unix_seconds(F.col("valid_to").cast("timestamp")), "is_current")
    assert got == sorted([(1, 10.0, "5-105", 1, 2, False), (1, 200.0, "105-205", 2, 3, False),
                          (1, 300.0, "205-305", 3, None, True), (2, 950.0, "905-1000", 1, 2, False)], key=repr)
    kept = table.bronze.read(spark)
    assert rows(kept.groupBy("kind").count()) == [("delete", 1), ("malformed", 1), ("upsert", 4)]
    assert rows(kept.select("_batch").distinct()) == [(0,), (1,), (2,)]
    assert kept.filter("kind = 'malformed'").first().raw == "damaged"


def test_repeated_batch_changes_nothing(spark, tmp_path):
    table = users_table(str(tmp_path))
    user = {"id": 1, "name": "a", "phone": "1", "date_of_birth": 0}
    frames = [spark.createDataFrame([(m,) for m in some], "value string") for some in (
        [message("c", 86_400_000, user)], [message("u", 172_800_000, {**user, "name": "b"}), message("c", 1, {**user, "id": 2})])]
    for batch_id in (0, 1, 0, 1, 1):
        apply_batch(spark, table, frames[batch_id], batch_id)
    assert table.bronze.read(spark).count() == 3
    assert rows(table.visible(spark), "id", "name", "birth_decade", F.col("created_at").cast("string")) == [
        (1, "b", 1970, "1970-01-03"), (2, "a", 1970, "1970-01-01")]


def test_silver_can_be_rebuilt_from_bronze(spark, tmp_path):
    table = products_table(str(tmp_path))
    for n in range(3):
        batch = [(message("u", 1000 * (5 - n), product(i, 10.0 * n + i)),) for i in range(40)]
        apply_batch(spark, table, spark.createDataFrame(batch, "value string"), n)
    before = rows(table.silver.read(spark).select(sorted(table.silver.read(spark).columns)))
    table.silver.overwrite(table.silver.read(spark).limit(0).union(spark.createDataFrame(
        table.silver.read(spark).limit(1).collect(), table.silver.read(spark).schema)))
    assert table.silver.read(spark).count() == 1
    rebuild(spark, table)
    assert rows(table.silver.read(spark).select(sorted(table.silver.read(spark).columns))) == before and len(before) == 120


def test_orders_keep_their_time_of_day(spark, tmp_path):
    table = orders_table(str(tmp_path))
    order = {"user_id": 1, "product_id": 2, "amount": 3, "discount": 1.5, "price": 10.0, "final_price": 9.85}
    micros = 1_706_790_645_123_456
    batch = [message("c", 1, {**order, "date": micros}), message("u", 2, {**order, "date": micros, "amount": 4}),
             message("c", 1, {**order, "date": micros + 1})]
    apply_batch(spark, table, spark.createDataFrame([(m,) for m in batch], "value string"), 0)
    got = rows(table.visible(spark), "amount", F.col("date").cast("string"), "year", "month")
    assert got == [(3, "2024-02-01 12:30:45.123457", 2024, 2), (4, "2024-02-01 12:30:45.123456", 2024, 2)]


def test_publish_gets_the_rows_of_the_batch(spark, tmp_path):
    table, sent = users_table(str(tmp_path)), []
    user = {"id": 1, "name": "a", "phone": "1", "date_of_birth": 0}
    for batch_id, id in ((0, 1), (1, 2)):
        batch = spark.createDataFrame([(message("c", 1, {**user, "id": id}),)], "value string")
        apply_batch(spark, table, batch, batch_id,
                    lambda df, n: sent.append((n, rows(merge.visible(df), "id", "name"))))
    assert sent == [(0, [(1, "a")]), (1, [(2, "a")])]


def test_batch_touches_only_its_partitions(spark, tmp_path):
    table = products_table(str(tmp_path))
    first = [(message("c", 1, product(i, 10.0)),) for i in range(200)]
    apply_batch(spark, table, spark.createDataFrame(first, "value string"), 0)
    files = {f for f in table.silver.read(spark).inputFiles()}
    apply_batch(spark, table, spark.createDataFrame([(message("u", 2, product(5, 20.0)),)], "value string"), 1)
    after = {f for f in table.silver.read(spark).inputFiles()}
    replaced = {f.split("partition_key=")[1].split("/")[0] for f in files - after}
    assert len(replaced) == 1 and len(files & after) >= 19


def test_empty_batch(spark, tmp_path):
    table = products_table(str(tmp_path))
    apply_batch(spark, table, spark.createDataFrame([], "value string"), 0)
    assert not table.silver.exists(spark)
    apply_batch(spark, table, spark.createDataFrame([("junk",)], "value string"), 1)
    apply_batch(spark, table, spark.createDataFrame([(message("c", 1, product(1, 5.0)),)], "value string"), 2)
    assert table.visible(spark).count() == 1 and table.bronze.read(spark).count() == 2


def test_streams_side_by_side(spark, tmp_path):
    lake = str(tmp_path / "lake")
    drop(tmp_path / "u", "1", message("c", 1, {"id": 1, "name": "a", "phone": "1", "date_of_birth": 0}))
    drop(tmp_path / "p", "1", message("c", 1, product(1, 5.0)))
    tables = users_table(lake), products_table(lake)
    run_all([(follow(spark, tmp_path / "u"), tables[0]), (follow(spark, tmp_path / "p"), tables[1])], DRAIN)
    assert [t.visible(spark).count() for t in tables] == [1, 1]


def test_unknown_stream_kind(spark):
    with pytest.raises(ValueError):
        cdc_stream(spark, "carrier pigeon")


def test_new_checkpoint_loses_nothing(spark, tmp_path):
    first, inbox = users_table(str(tmp_path / "lake")), tmp_path / "in"
    user = {"id": 1, "name": "a", "phone": "1", "date_of_birth": 0}
    drop(inbox, "1", message("c", 1, user), message("c", 1, {**user, "id": 2}))
    run_cdc(follow(spark, inbox), first, DRAIN).awaitTermination()
    again = dataclasses.replace(first, checkpoints="others")
    drop(tmp_path / "more", "1", message("c", 1, {**user, "id": 3}))
    run_cdc(follow(spark, tmp_path / "more"), again, DRAIN).awaitTermination()
    rebuild(spark, first)
    assert rows(first.visible(spark), "id") == [(1,), (2,), (3,)]


def test_stream_follows_a_batch_load(spark, tmp_path):
    lake = Lake(str(tmp_path / "lake"))
    users = spark.createDataFrame([(1, "a", "1"), (2, "b", "2")], "id bigint, name string, phone string").withColumn(
        "date_of_birth", F.lit("1970-01-01").cast("timestamp_ntz"))
    products = spark.createDataFrame([(1, "p", 10.0), (2, "q", 20.0)], "id bigint, name string, price double")
    orders = spark.createDataFrame([(1, 1, 2, 0.0, 10.0, 10.0), (2, 2, 1, 0.0, 20.0, 20.0)],
                                   "user_id bigint, product_id bigint, amount int, discount double, price double, final_price double")
    orders = orders.withColumn("date", F.lit("2024-01-05").cast("timestamp_ntz"))
    run_batch(spark, lake, {"users": users, "products": products, "orders": orders}, "2024-02-01")
    later = 1_800_000_000_000
    drop(tmp_path / "p", "1", message("u", later, product(1, 300.0, "p2")), message("d", later, {"id": 2}))
    gone = {"user_id": 2, "product_id": 2, "date": 1_704_412_800_000_000}
    drop(tmp_path / "o", "1", message("d", later, gone))
    tables = products_table(lake.root), orders_table(lake.root)
    run_all([(follow(spark, tmp_path / "p"), tables[0]), (follow(spark, tmp_path / "o"), tables[1])], DRAIN)
    for _ in range(2):
        got = rows(tables[0].visible(spark), "id", "name", "price", F.col("valid_from").cast("date").cast("string"), "is_current")
        assert got == sorted([(1, "p", 10.0, "2024-02-01", False), (1, "p2", 300.0, "2027-01-15", True),
                              (2, "q", 20.0, "2024-02-01", False)], key=repr)
        load_gold(spark, lake)
        assert rows(lake.gold("customer_lifetime_value").read(spark), "user_id", "total_orders") == [(1, 1)]
        rebuild(spark, tables[0])
