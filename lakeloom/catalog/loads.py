"""Whole loads: the batch layers and the change streams."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.catalog import changing, inputs, sql
from lakeloom.catalog.registry import doubles, query
from lakeloom.plans import bronze, gold, marts
from lakeloom.plans.batch import Lake, Ledger, backfill, export, load_bronze, load_gold, load_silver, resume, run_batch
from lakeloom.session import fresh_dir
from lakeloom.sinks.feed import replay
from lakeloom.sources.changes import cdc_stream
from lakeloom.sources.lake import LakeTable, committed
from lakeloom.streaming.programs import (
    CdcTable, bucket_key, compact, first_seen, orders_table, products_table, rebuild, run_all, run_cdc, users_table)

LOAD_DATE = "2024-10-10"
DRAIN = {"availableNow": True}


def sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"users": inputs.users(spark, sf_dir), "products": inputs.products(spark, sf_dir),
            "orders": inputs.orders_raw(spark, sf_dir).select(*inputs.ORDER_COLUMNS)}


# The batch load keeps, of orders with one business key, the first by amount, discount, price and final price.
BATCH_SALES = f"""{sql.ORDERS_RAW},
sales AS (SELECT * EXCLUDE (rn) FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id, product_id, date
                                         ORDER BY amount, discount, price, final_price) AS rn FROM orders_raw)
          WHERE rn = 1)"""


@query(f"""WITH {BATCH_SALES},
           spend AS (SELECT user_id, c_name AS user_name, sum(amount * final_price) AS spent, count(*) AS total_orders,
                            CAST(sum(amount * final_price * 100) AS BIGINT) AS spent_cents,
                            CAST(min(date) AS DATE) AS first_order_date, CAST(max(date) AS DATE) AS last_order_date
                     FROM sales JOIN customer ON user_id = c_custkey GROUP BY user_id, c_name)
           SELECT user_id, user_name, CAST(spent AS DOUBLE) AS total_spent, total_orders,
                  CAST((2 * spent_cents + total_orders) // (2 * total_orders) AS DOUBLE) / 100 AS average_spent,
                  first_order_date, last_order_date, {sql.segment('spent')} AS segment FROM spend""")
def batch_lifetime_value(spark, sf_dir):
    """Bronze, silver and gold loaded as tables; the customer mart read back."""
    lake = run_batch(spark, Lake(fresh_dir(spark, "lake")), sources(spark, sf_dir), LOAD_DATE)
    return doubles(lake.gold("customer_lifetime_value").read(spark))


@query(f"""WITH {BATCH_SALES},
           summary AS (SELECT year, month, product_id, p_name AS product_name, CAST(sum(amount) AS BIGINT) AS total_sale,
                              CAST(sum(amount * price) AS DOUBLE) AS total_revenue_before_discount,
                              CAST(sum(amount * final_price) AS DOUBLE) AS total_revenue_after_discount,
                              CAST((2 * CAST(sum(discount * 100) AS BIGINT) + count(*)) // (2 * count(*)) AS DOUBLE) / 100
                                AS average_discount, count(*) AS total_orders
                       FROM sales JOIN part ON product_id = p_partkey GROUP BY ALL)
           SELECT * FROM (SELECT *, CAST(rank() OVER (ORDER BY total_revenue_after_discount DESC) AS INTEGER) AS rank
                          FROM summary) WHERE rank <= 10""")
def batch_top_products(spark, sf_dir):
    """The same load twice over the same place: the top products are those of one load."""
    lake = Lake(fresh_dir(spark, "lake"))
    made = sources(spark, sf_dir)
    made["orders"] = committed(made["orders"], "orders")  # the joins run once, both loads read their rows
    for _ in range(2):
        run_batch(spark, lake, made, LOAD_DATE)
    return doubles(lake.gold("top_products_by_revenue").read(spark))


@query(f"""WITH {sql.ORDERS_RAW} SELECT year, month, count(*) AS rows, CAST(sum(amount) AS BIGINT) AS amount
           FROM orders_raw GROUP BY year, month""")
def backfill_years(spark, sf_dir):
    """Bronze orders loaded year by year from a stored table, the first year twice."""
    root = fresh_dir(spark, "backfill")
    # The joins run once, not for each slice. Every task writes its years where they are, as slices are shuffled when they are loaded.
    stored = LakeTable(f"{root}/stored", ("year",))
    stored.overwrite(bronze.orders(inputs.orders_raw(spark, sf_dir)), clustered=True)
    rows = stored.read(spark)
    table = LakeTable(f"{root}/bronze", bronze.PARTITIONS["orders"])
    low, high = rows.agg(F.min("year"), F.max("year")).first()
    slices = [f"year = {year}" for year in range(low, high + 1)] + [f"year = {low}"]
    report = backfill(spark, slices, lambda where: table.replace_partitions(rows.filter(where)))
    if not report.filter("NOT ok").isEmpty():
        raise RuntimeError("a slice failed")
    return table.read(spark).groupBy("year", "month").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("amount").cast("bigint")).alias("amount"))


@query(f"""WITH {sql.ORDERS_RAW} SELECT year, month, count(*) AS rows, CAST(sum(amount) AS BIGINT) AS amount,
                  CASE WHEN year % 2 = 0 THEN 2 ELSE 1 END AS attempts
           FROM orders_raw GROUP BY year, month""")
def backfill_resume(spark, sf_dir):
    """Bronze orders loaded year by year from a stored table; every second year fails at first, and a second start loads only those.
    With how often each year was tried."""
    root = fresh_dir(spark, "backfill")
    stored = LakeTable(f"{root}/stored", ("year",))
    stored.overwrite(bronze.orders(inputs.orders_raw(spark, sf_dir)))
    table, ledger = LakeTable(f"{root}/bronze", bronze.PARTITIONS["orders"]), Ledger(f"{root}/ledger")
    slices = sorted(folder for folder in stored.folders(spark, 1))  # a folder listing: nothing is read to find the slices
    broken = {one for one in slices if int(one.split("=")[1]) % 2 == 0}

    def load(one: str) -> None:
        if one in broken:
            raise OSError("no connection")
        table.replace_partitions(stored.read(spark, one))  # a filter on the partition column: only this slice is read

    first = resume(spark, ledger, "load", slices, load)
    if first.filter("NOT ok").count() != len(broken):
        raise RuntimeError("the slices that fail were not reported")
    broken.clear()
    resume(spark, ledger, "load", slices, load)
    tries = ledger.read(spark).groupBy(F.substring_index("slice", "=", -1).cast("int").alias("year")).agg(
        F.count(F.lit(1)).cast("int").alias("attempts"))
    loaded = table.read(spark).groupBy("year", "month").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("amount").cast("bigint")).alias("amount"))
    return loaded.join(tries, "year")


@query(f"""WITH {sql.ORDERS_RAW}, {sql.USERS},
           bad_users AS (SELECT * REPLACE (CASE WHEN id % 97 = 0 THEN NULL ELSE name END AS name) FROM users),
           bad_orders AS (SELECT * REPLACE (CASE WHEN product_id % 89 = 0 THEN NULL ELSE amount END AS amount) FROM orders_raw),
           counts AS (
             SELECT 'users' AS name, unnest(['id', 'name', 'phone', 'date_of_birth', 'domain', 'unique']) AS rule, count(*) AS rows,
                    unnest([0, count(*) FILTER (name IS NULL), 0, 0, 0, 0]) AS failed FROM bad_users
             UNION ALL
             SELECT 'products', unnest(['id', 'name', 'price', 'domain', 'unique']), 2 * count(*), unnest([0, 0, 0, 0, count(*)])
             FROM part
             UNION ALL
             SELECT 'orders', unnest(['user_id', 'product_id', 'amount', 'price', 'final_price', 'date', 'domain']), count(*),
                    unnest([0, 0, count(*) FILTER (amount IS NULL), 0, 0, 0, count(*) FILTER (year >= 2000)]) FROM bad_orders
             UNION ALL
             SELECT 'orders', 'unique', count(*), count(*) - count(DISTINCT (user_id, product_id, date))
             FROM bad_orders WHERE year < 2000)
           SELECT name, rule, CAST(rows AS BIGINT) AS rows, CAST(failed AS BIGINT) AS failed FROM counts""")
def load_quality(spark, sf_dir):
    """How many rows break each rule, counted by the jobs that load silver: null names and amounts, products sent twice, late orders."""
    made = sources(spark, sf_dir)
    made["users"] = made["users"].withColumn("name", F.when(F.col("id") % 97 != 0, F.col("name")))
    made["products"] = made["products"].unionByName(made["products"])
    made["orders"] = made["orders"].withColumn("amount", F.when(F.col("product_id") % 89 != 0, F.col("amount")))
    lake = Lake(fresh_dir(spark, "lake"))
    load_bronze(lake, made)
    return load_silver(spark, lake, LOAD_DATE, {"orders": F.col("year") < 2000})


@query(f"""WITH {BATCH_SALES}
           SELECT user_id, product_id, date, amount, CAST(discount AS DOUBLE) AS discount, CAST(price AS DOUBLE) AS price,
                  CAST(final_price AS DOUBLE) AS final_price, year, month FROM sales""")
def serving_export_twice(spark, sf_dir):
    """The serving files of the orders after the same export was run twice: one load's rows."""
    lake = run_batch(spark, Lake(fresh_dir(spark, "lake")), sources(spark, sf_dir), LOAD_DATE)
    for _ in range(2):
        export(spark, lake, f"{lake.root}/serving")
    return doubles(spark.read.parquet(f"{lake.root}/serving/orders"))


# Streams. The messages of a table are written as text files, in no particular order, and followed as a stream.

def _follow(spark: SparkSession, rows: DataFrame, root: str, name: str, text: Column | None = None) -> DataFrame:
    """The messages of `rows` in packed files, four for each core of the cluster as they are read whole, followed in two batches.
    `text` makes the messages once the rows are dealt to the files, as rows are much shorter; without it they are the column `value`."""
    path, files = f"{root}/messages/{name}", max(2, 4 * spark.sparkContext.defaultParallelism)
    dealt = rows.repartition(files, F.xxhash64(*rows.columns))
    made = dealt.select((F.col("value") if text is None else text).alias("value"))
    made.write.mode("overwrite").option("compression", "gzip").text(path)
    return cdc_stream(spark, "files", path=path, options={"maxFilesPerTrigger": str(-(-files // 2))})


def _event_table(root: str, mode: str) -> CdcTable:
    return CdcTable("events", root, inputs.CHANGE_FIELDS, ("user_id",), mode=mode,
                    bucket=lambda: {"partition_key": bucket_key("user_id")})


def _event_stream(spark, sf_dir, mode) -> DataFrame:
    root = fresh_dir(spark, f"stream_{mode}")
    table = _event_table(root, mode)
    run_cdc(_follow(spark, inputs.messages(spark, sf_dir), root, "events"), table, DRAIN).awaitTermination()
    return table.visible(spark).drop("partition_key")


ORDER_MESSAGE = inputs.ORDER_COLUMNS, inputs.ORDER_COLUMNS
MESSAGE_FIELDS = ["op", *inputs.ORDER_COLUMNS, "ts_ms", "lsn"]


def _later_changes(spark: SparkSession, lake: Lake) -> DataFrame:
    """Changes after a load: orders of every seventh product deleted, those of the next one set to an amount of 1."""
    held = doubles(lake.live(spark, "orders")).withColumn("date", F.unix_micros(F.col("date").cast("timestamp")))
    turn = F.pmod("product_id", F.lit(7))
    later = held.filter(turn <= 1).withColumns({
        "op": F.when(turn == 0, "d").otherwise("u"), "amount": F.lit(1), "discount": F.col("discount").cast("double"),
        "ts_ms": F.lit(2_000_000_000_000).cast("bigint"), "lsn": F.lit(1).cast("bigint")})
    return later.select(*MESSAGE_FIELDS)


CHANGED_SALES = f"""{BATCH_SALES},
changed AS (SELECT * REPLACE (CASE WHEN product_id % 7 = 1 THEN 1 ELSE amount END AS amount)
            FROM sales WHERE product_id % 7 <> 0)"""


def _load_then_stream(spark: SparkSession, sf_dir: str) -> Lake:
    """The batch load, then a stream of changes into the same silver orders."""
    lake = run_batch(spark, Lake(fresh_dir(spark, "lake")), sources(spark, sf_dir), LOAD_DATE)
    changes = _follow(spark, _later_changes(spark, lake), lake.root, "orders", inputs.message(*ORDER_MESSAGE))
    run_cdc(changes, orders_table(lake.root), DRAIN).awaitTermination()
    return lake


@query(f"""WITH {CHANGED_SALES}
           SELECT user_id, product_id, date, amount, CAST(discount AS DOUBLE) AS discount, CAST(price AS DOUBLE) AS price,
                  CAST(final_price AS DOUBLE) AS final_price FROM changed""")
def batch_then_stream_orders(spark, sf_dir):
    """Silver orders after a load and changes that follow it."""
    return _load_then_stream(spark, sf_dir).live(spark, "orders").select(*inputs.ORDER_COLUMNS)


@query(f"""WITH {CHANGED_SALES}
           SELECT user_id, c_name AS user_name, CAST(sum(amount * final_price) AS DOUBLE) AS total_spent,
                  count(*) AS total_orders FROM changed JOIN customer ON user_id = c_custkey GROUP BY user_id, c_name""")
def gold_after_stream(spark, sf_dir):
    """The customer mart over silver that a stream has changed: deleted orders do not count."""
    lake = _load_then_stream(spark, sf_dir)
    load_gold(spark, lake)
    mart = doubles(lake.gold("customer_lifetime_value").read(spark))
    return mart.select("user_id", "user_name", "total_spent", "total_orders")


# Orders that come are those of every seventh product a hundred years on, so that they are new.
MIXED_SALES = f"""{CHANGED_SALES},
mixed AS (SELECT * FROM changed
          UNION ALL
          SELECT * REPLACE (date + INTERVAL 36500 DAY AS date, CAST(year(date + INTERVAL 36500 DAY) AS INTEGER) AS year,
                            CAST(month(date + INTERVAL 36500 DAY) AS INTEGER) AS month)
          FROM sales WHERE product_id % 7 = 2)"""


def _mixed_changes(spark: SparkSession, lake: Lake) -> DataFrame:
    """Changes after a load: orders deleted, updated and created."""
    held = doubles(lake.live(spark, "orders"))
    created = held.filter(F.pmod("product_id", F.lit(7)) == 2).withColumns({
        "date": F.unix_micros((F.col("date") + F.expr("INTERVAL 36500 DAY")).cast("timestamp")), "op": F.lit("c"),
        "discount": F.col("discount").cast("double"), "ts_ms": F.lit(2_000_000_000_000).cast("bigint"),
        "lsn": F.lit(1).cast("bigint")})
    return _later_changes(spark, lake).unionByName(created.select(*MESSAGE_FIELDS))


def _load_and_follow(spark: SparkSession, sf_dir: str) -> tuple[Lake, CdcTable, list[marts.Mart], DataFrame]:
    """The batch load, marts built from it, and a stream of changes that the marts follow batch by batch; the last batch is
    applied twice. Also the orders as they were loaded."""
    lake = run_batch(spark, Lake(fresh_dir(spark, "lake")), sources(spark, sf_dir), LOAD_DATE)
    orders = orders_table(lake.root)
    before = committed(orders.visible(spark), "orders-before")
    kept = [marts.sales(lake.root), marts.lifetime(lake.root)]
    for mart in kept:
        mart.build(before)
    seen: list[tuple[str, int]] = []

    def after(run: str, batch_id: int) -> None:
        seen.append((run, batch_id))
        marts.follow_orders(spark, kept, orders, run, batch_id)

    changes = _follow(spark, _mixed_changes(spark, lake), lake.root, "orders", inputs.message(*ORDER_MESSAGE))
    run_cdc(changes, orders, DRAIN, feed=True, after=after).awaitTermination()
    marts.follow_orders(spark, kept, orders, *seen[-1])
    return lake, orders, kept, before


@query(f"""WITH {MIXED_SALES},
           spend AS (SELECT user_id, c_name AS user_name, sum(amount * final_price) AS spent, count(*) AS total_orders,
                            CAST(sum(amount * final_price * 100) AS BIGINT) AS spent_cents,
                            CAST(min(date) AS DATE) AS first_order_date, CAST(max(date) AS DATE) AS last_order_date
                     FROM mixed JOIN customer ON user_id = c_custkey GROUP BY user_id, c_name)
           SELECT user_id, user_name, CAST(spent AS DOUBLE) AS total_spent, total_orders,
                  CAST((2 * spent_cents + total_orders) // (2 * total_orders) AS DOUBLE) / 100 AS average_spent,
                  first_order_date, last_order_date, {sql.segment('spent')} AS segment FROM spend""")
def gold_incremental_lifetime(spark, sf_dir):
    """The customer mart kept up to date from signed changes: first and last days are found anew where their order goes."""
    lake, _, (_, lifetime), _ = _load_and_follow(spark, sf_dir)
    return doubles(gold.named_lifetime(lifetime.read(spark), lake.live(spark, "users")))


@query(f"""WITH {MIXED_SALES}
           SELECT year, month, product_id, p_name AS product_name, CAST(sum(amount) AS BIGINT) AS total_sale,
                  CAST(sum(amount * price) AS DOUBLE) AS total_revenue_before_discount,
                  CAST(sum(amount * final_price) AS DOUBLE) AS total_revenue_after_discount,
                  CAST((2 * CAST(sum(discount * 100) AS BIGINT) + count(*)) // (2 * count(*)) AS DOUBLE) / 100
                    AS average_discount, count(*) AS total_orders
           FROM mixed JOIN part ON product_id = p_partkey GROUP BY ALL""")
def gold_incremental_sales(spark, sf_dir):
    """The sales summary kept up to date from signed changes."""
    lake, _, (sales, _), _ = _load_and_follow(spark, sf_dir)
    return doubles(gold.named_sales(sales.read(spark), lake.live(spark, "products")))


@query(f"""WITH {MIXED_SALES}
           SELECT user_id, product_id, date, amount, CAST(discount AS DOUBLE) AS discount, CAST(price AS DOUBLE) AS price,
                  CAST(final_price AS DOUBLE) AS final_price FROM mixed""")
def serving_from_feed(spark, sf_dir):
    """A serving store that holds the loaded orders and takes the signed rows of the stream: what it holds in the end."""
    _, orders, _, before = _load_and_follow(spark, sf_dir)
    loaded = before.withColumn("sign", F.lit(1))
    signed = orders.feed.read(spark).select(*loaded.columns)
    return replay(loaded.unionByName(signed)).select(*inputs.ORDER_COLUMNS)


@query(f"""WITH {BATCH_SALES},
           now AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN p_name || ' II' ELSE p_name END AS name
                   FROM part WHERE p_partkey % 5 <> 1)
           SELECT year, month, product_id, name AS product_name, CAST(sum(amount) AS BIGINT) AS total_sale,
                  CAST(sum(amount * final_price) AS DOUBLE) AS total_revenue_after_discount, count(*) AS total_orders
           FROM sales JOIN now ON product_id = id GROUP BY ALL""")
def gold_after_products_stream(spark, sf_dir):
    """The sales summary over products that a stream has renamed and deleted after the load: one row per current version."""
    lake = run_batch(spark, Lake(fresh_dir(spark, "lake")), sources(spark, sf_dir), LOAD_DATE)
    turn = F.pmod("id", F.lit(5))
    later = inputs.products(spark, sf_dir).filter(turn <= 1).withColumns({
        "op": F.when(turn == 1, "d").otherwise("u"), "name": F.concat("name", F.lit(" II")),
        "ts_ms": F.lit(2_000_000_000_000).cast("bigint"), "lsn": F.lit(1).cast("bigint")})
    messages = later.select(inputs.message(["id", "name", "price"], ["id"]).alias("value"))
    products = products_table(lake.root)
    run_cdc(_follow(spark, messages, lake.root, "products"), products, DRAIN).awaitTermination()
    compact(spark, products, share=0.0)
    load_gold(spark, lake)
    mart = doubles(lake.gold("sales_summary_by_product").read(spark))
    return mart.select("year", "month", "product_id", "product_name", "total_sale", "total_revenue_after_discount", "total_orders")


@query(f"WITH {changing.LAST} SELECT user_id, value, event_type FROM last WHERE NOT deleted")
def stream_upsert(spark, sf_dir):
    return _event_stream(spark, sf_dir, "upsert")


@query(f"WITH {changing.LAST} SELECT user_id, value, event_type FROM last WHERE NOT deleted")
def stream_replayed(spark, sf_dir):
    """The same messages by two streams with a checkpoint each, then silver rebuilt from all changes kept."""
    root = fresh_dir(spark, "stream_replayed")
    table = _event_table(root, "upsert")
    for run in ("first", "second"):
        again = dataclasses.replace(table, checkpoints=run)
        run_cdc(_follow(spark, inputs.messages(spark, sf_dir), root, "events"), again, DRAIN).awaitTermination()
    rebuild(spark, table)
    return table.visible(spark).drop("partition_key")


@query(f"""WITH {changing.ROWS}
           SELECT user_id, ts_ms, lsn, deleted, value, event_type, CAST(1 AS BIGINT) AS copies FROM rows""")
def stream_resent(spark, sf_dir):
    """The change table of a stream whose source sends every message twice: each change once."""
    root = fresh_dir(spark, "stream_resent")
    table = _event_table(root, "upsert")
    twice = inputs.messages(spark, sf_dir).unionByName(inputs.messages(spark, sf_dir, delay_ms=60_000))
    run_cdc(first_seen(_follow(spark, twice, root, "events"), table), table, DRAIN).awaitTermination()
    kept = table.bronze.read(spark)
    return kept.groupBy("user_id", "ts_ms", "lsn", "deleted", "value", "event_type").agg(F.count(F.lit(1)).alias("copies"))


@query(changing.HISTORY_SQL)
def stream_scd2(spark, sf_dir):
    return _event_stream(spark, sf_dir, "scd2")


def _table_messages(spark: SparkSession, sf_dir: str) -> dict[str, tuple[DataFrame, Column]]:
    """Rows and messages for the three source tables: every user and order created; every product created, then repriced."""
    users = inputs.users(spark, sf_dir).select(
        F.lit("c").alias("op"), "id", "name", "phone", F.unix_micros(F.col("date_of_birth").cast("timestamp"))
        .alias("date_of_birth"), F.lit(1000).cast("bigint").alias("ts_ms"), F.col("id").alias("lsn"))
    products = inputs.products(spark, sf_dir)
    created = products.withColumns({"op": F.lit("c"), "ts_ms": F.lit(1000).cast("bigint"), "lsn": F.col("id")})
    repriced = products.withColumns({"op": F.lit("u"), "ts_ms": F.lit(2000).cast("bigint"), "lsn": F.col("id"),
                                     "price": F.col("price") - 100})
    orders = doubles(inputs.orders_raw(spark, sf_dir)).select(
        F.lit("c").alias("op"), "user_id", "product_id", "amount", F.col("discount").cast("double").alias("discount"),
        "price", "final_price", F.unix_micros(F.col("date").cast("timestamp")).alias("date"),
        F.col("l_orderkey").alias("ts_ms"), F.col("l_linenumber").cast("bigint").alias("lsn"))
    row = {"users": ["id", "name", "phone", "date_of_birth"], "products": ["id", "name", "price"],
           "orders": inputs.ORDER_COLUMNS}
    frames = {"users": users, "products": created.unionByName(repriced), "orders": orders}
    return {name: (df, inputs.message(row[name], row[name][:1])) for name, df in frames.items()}


@query(f"""WITH {sql.ORDERS_RAW}, {sql.USERS}
           SELECT 'users' AS name, CAST({sql.decade('date_of_birth')} AS VARCHAR) AS part, count(*) AS rows,
                  CAST(sum(id) AS BIGINT) AS ids FROM users GROUP BY ALL
           UNION ALL
           SELECT 'products', CASE WHEN is_current THEN 'current' ELSE 'closed' END, count(*), CAST(sum(p_partkey) AS BIGINT)
           FROM part, (SELECT unnest([true, false]) AS is_current) GROUP BY ALL
           UNION ALL
           SELECT 'orders', year || '-' || month, count(*), CAST(sum(product_id) AS BIGINT)
           FROM (SELECT DISTINCT user_id, product_id, date, year, month FROM orders_raw) GROUP BY ALL""")
def stream_all(spark, sf_dir):
    """The three tables streamed side by side: rows per decade, version state and month."""
    root = fresh_dir(spark, "stream_all")
    tables = {"users": users_table(root), "products": products_table(root), "orders": orders_table(root)}
    messages = _table_messages(spark, sf_dir)
    run_all([(_follow(spark, rows, root, name, text), tables[name]) for name, (rows, text) in messages.items()], DRAIN)
    users, products, orders = (tables[name].visible(spark) for name in ("users", "products", "orders"))
    parts = [
        (users, "users", F.col("birth_decade").cast("string"), "id"),
        (products, "products", F.when(F.col("is_current"), "current").otherwise("closed"), "id"),
        (orders, "orders", F.concat_ws("-", F.col("year"), F.col("month")), "product_id"),
    ]
    counted = [df.groupBy(F.lit(name).alias("name"), part.alias("part")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(key).alias("ids")) for df, name, part, key in parts]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])
