import glob

import pytest
from pyspark.sql import functions as F

from lakeloom import schemas
from lakeloom.plans import bronze, gold, silver
from lakeloom.plans.batch import Lake, backfill, load_gold, load_silver, run_batch
from lakeloom.session import fresh_dir, partitions_for, shared_dir
from lakeloom.sinks.serving import sorted_export
from lakeloom.sources import generate
from lakeloom.sources.lake import LakeTable
from tests.conftest import rows


def months(spark, n=240, factor=1):
    return spark.range(n).select(
        (F.col("id") % 2 + 2023).cast("int").alias("year"), (F.col("id") % 12 + 1).cast("int").alias("month"),
        (F.col("id") * factor).alias("v"))


def test_append_overwrite_replace(spark, table_dir):
    table = LakeTable(table_dir, ("year", "month"))
    assert not table.exists(spark)
    table.append(months(spark))
    assert table.exists(spark)
    table.append(months(spark))
    assert table.read(spark).count() == 480
    table.overwrite(months(spark))
    assert table.read(spark).count() == 240
    for _ in range(2):
        table.replace_partitions(months(spark, factor=0).filter("year = 2024"))
    assert rows(table.read(spark).groupBy("year").agg(F.sum("v"), F.count("v")), "year", "sum(v)", "count(v)") == [
        (2023, sum(range(0, 240, 2)), 120), (2024, 0, 120)]


def test_replace_may_read_the_table_it_replaces(spark, table_dir):
    table = LakeTable(table_dir, ("year", "month"))
    table.append(months(spark))
    table.replace_partitions(table.read(spark, "year = 2024").withColumn("v", F.lit(-1).cast("bigint")))
    assert table.read(spark).filter("v = -1").count() == 120 and table.read(spark).count() == 240


def test_replace_needs_partitions(spark, table_dir):
    with pytest.raises(ValueError):
        LakeTable(table_dir).replace_partitions(spark.range(3))


def test_slice_reads_its_partitions_only(spark, table_dir):
    table = LakeTable(table_dir, ("year", "month"))
    table.append(months(spark))
    read = table.read(spark, "year = 2024 AND month = 4")
    plan = read._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "(year" in filters and "(month" in filters and "PushedFilters: []" in plan
    assert read.count() == 20  # every twelfth of 240 rows


def test_few_files_per_partition(spark, table_dir):
    table = LakeTable(table_dir, ("year", "month"))
    table.append(months(spark, 24_000).repartition(40))
    assert len(glob.glob(f"{table_dir}/year=*/month=*/*.parquet")) == 12


def test_large_partition_is_split(spark, table_dir):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        hot = spark.range(400_000).select(
            F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(0).cast("int").alias("p"), F.xxhash64("id").alias("v"))
        LakeTable(table_dir, ("p",)).append(hot.repartition(16))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(glob.glob(f"{table_dir}/p=0/*.parquet")) > 4
    assert spark.read.parquet(table_dir).count() == 400_000


def test_touched_partitions(spark, table_dir):
    table = LakeTable(table_dir, ("year", "month"))
    df = spark.createDataFrame([(2023, 1, 1), (2023, 2, 2), (2024, 1, 3), (None, 5, 4), (2025, None, 5)],
                               "year int, month int, v int")
    some = df.filter("v IN (1, 4, 5)")
    assert rows(df.filter(table.touched(some)), "v") == [(1,), (4,), (5,)]
    many = spark.range(1500).select(F.col("id").alias("year"), F.lit(1).alias("month"))
    assert many.filter(table.touched(many.filter("year < 1200"))).count() == 1200
    assert rows(df.filter(table.touched(df.filter("v > 9")))) == []
    single = LakeTable(table_dir, ("year",))
    assert rows(df.filter(single.touched(df.filter("v IN (1, 4)"))), "v") == [(1,), (2,), (4,)]


def test_read_partition(spark, table_dir):
    table = LakeTable(table_dir, ("year", "month"))
    table.append(months(spark))
    one = table.read_partition(spark, year=2024)
    assert set(one.columns) == {"v", "year", "month"} and one.count() == 120
    assert rows(one.select("year").distinct()) == [(2024,)]


def test_sorted_export(spark, table_dir):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files in spite of few rows
    try:
        sorted_export(spark.range(5000).select((F.xxhash64("id")).alias("k")), table_dir, ["k"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spans = []
    for path in glob.glob(f"{table_dir}/*.parquet"):
        keys = [r.k for r in spark.read.parquet(path).collect()]
        assert keys == sorted(keys)
        spans.append((keys[0], keys[-1]))
    spans.sort()
    assert len(spans) > 1 and all(one[1] < two[0] for one, two in zip(spans, spans[1:]))


def test_shared_dir_is_the_one_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_dir(spark) == named.rstrip("/")
    assert fresh_dir(spark, "x").startswith(shared_dir(spark)) and fresh_dir(spark, "x") != fresh_dir(spark, "x")


def test_partitions_follow_the_shuffle():
    assert partitions_for(1) == 200 and partitions_for(1 << 40) == 8192


def test_project_and_defaults(spark):
    df = spark.createDataFrame([(1, None, "2.5", "extra")], "user_id int, discount double, cost string, other string")
    got = schemas.project(df, {"user_id": "bigint", "discount": "float", "price": "double", "date": "date"},
                          rename={"price": "cost"}, defaults=schemas.SERVING_DEFAULTS)
    assert got.dtypes == [("user_id", "bigint"), ("discount", "float"), ("price", "double"), ("date", "date")]
    assert rows(got) == [(1, 0.0, 2.5, None)]


def test_wide_serving_schema():
    assert schemas.wide(schemas.SERVING_PRODUCTS)["price"] == "double"
    assert schemas.wide(schemas.SERVING_ORDERS)["product_id"] == "bigint"
    assert schemas.wide(schemas.SERVING_ORDERS)["amount"] == "int"


# Layers

def sources(spark, n=400):
    users, products = generate.users(generate.ids(spark, 1, 50), 1), generate.products(generate.ids(spark, 1, 30), 1)
    return {"users": users, "products": products,
            "orders": generate.orders(generate.ids(spark, 1, n), 50, 30, "2024-10-10 00:00:00", 1)}


def test_layer_schemas(spark):
    made = sources(spark)
    for name, fields in (("users", schemas.USERS), ("products", schemas.PRODUCTS), ("orders", schemas.ORDERS)):
        assert dict(made[name].dtypes) == dict(fields)
        layered = getattr(bronze, name)(made[name])
        assert dict(layered.dtypes) == getattr(schemas, f"BRONZE_{name.upper()}")
    assert dict(silver.users(bronze.users(made["users"])).dtypes) == schemas.SILVER_USERS
    assert dict(silver.products(bronze.products(made["products"])).dtypes) == schemas.SILVER_PRODUCTS
    assert dict(silver.orders(bronze.orders(made["orders"])).dtypes) == schemas.SILVER_ORDERS


def test_silver_dedupes_across_partitions(spark):
    products = spark.createDataFrame([(1, "a", 100.0), (1, "a", 300.0), (2, "b", 1.0)], "id bigint, name string, price double")
    got = silver.products(bronze.products(products), "2024-01-01")
    assert rows(got, "id", "price", "price_range", "is_current") == [(1, 100.0, "5-105", True), (2, 1.0, "out_of_range", True)]


def test_domain_filter_splits_everything(spark):
    df = bronze.users(spark.createDataFrame(
        [(1, "1899-12-31"), (2, "1900-01-01"), (3, "2029-12-31"), (4, "2030-01-01"), (5, None)], "id int, d string")
        .select("id", F.col("d").cast("timestamp_ntz").alias("date_of_birth")))
    kept, rejected = silver.domain_filter(df, silver.users_domain())
    assert rows(kept, "id") == [(2,), (3,)] and rows(rejected, "id") == [(1,), (4,), (5,)]


def test_batch_load(spark, tmp_path):
    made = sources(spark)
    lake = Lake(str(tmp_path))
    run_batch(spark, lake, made, "2024-10-10")
    load_silver(spark, lake, "2024-10-10")  # a stage may run again
    load_gold(spark, lake)
    orders = silver.orders(bronze.orders(made["orders"]))
    summary = gold.sales_summary_by_product(orders, made["products"])
    stored = lake.gold("sales_summary_by_product").read(spark).select(*summary.columns)
    assert rows(stored) == rows(summary)
    assert rows(lake.gold("top_products_by_revenue").read(spark)) == rows(gold.top_products_by_revenue(summary))
    clv = lake.gold("customer_lifetime_value").read(spark)
    assert clv.agg(F.sum("total_orders")).first()[0] == orders.count()
    assert summary.agg(F.sum("total_orders")).first()[0] == orders.count()


def test_batch_load_with_domains(spark, tmp_path):
    lake = Lake(str(tmp_path))
    run_batch(spark, lake, sources(spark), "2024-10-10", domains={"orders": silver.orders_domain((2024, 2024))})
    assert rows(lake.silver("orders").read(spark).select("year").distinct()) == [(2024,)]
    assert rows(lake.rejects("orders").read(spark).select("year").distinct()) == [(2023,)]


def test_summary_counts_each_order_once_despite_versions(spark):
    orders = spark.createDataFrame([(2024, 1, 1, 7, 2, 10.0, 9.0, 10.0, "2024-01-05")],
                                   "year int, month int, user_id int, product_id int, amount int, price double, "
                                   "final_price double, discount double, date string")
    products = spark.createDataFrame([(7, "old", False), (7, "new", True)], "id int, name string, is_current boolean")
    got = gold.sales_summary_by_product(orders, products).first()
    assert (got.product_name, got.total_sale, float(got.total_revenue_after_discount), got.total_orders) == ("new", 2, 18.0, 1)


def test_backfill_goes_on_and_reports(spark):
    done = []

    def load(where):
        if where == "bad":
            raise RuntimeError("no such slice")
        done.append(where)
    report = backfill(spark, ["a", "bad", "b"], load)
    assert done == ["a", "b"]
    assert rows(report) == sorted([("a", True, None), ("bad", False, "RuntimeError: no such slice"), ("b", True, None)], key=repr)
