"""Bronze and silver columns, table layout, serving projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.catalog import inputs, sql
from lakeloom.catalog.marts import silver_orders, summary
from lakeloom.catalog.registry import doubles, query
from lakeloom.functions.bands import BUCKETS, bucket_key, decade, price_range
from lakeloom.operators.slices import slice_counts
from lakeloom.plans import bronze, silver
from lakeloom.schemas import SERVING_DEFAULTS, SERVING_KEYS, SERVING_ORDERS, SERVING_PRODUCTS, SERVING_USERS
from lakeloom.schemas import project, wide
from lakeloom.session import fresh_dir
from lakeloom.sinks.serving import sorted_export
from lakeloom.sources.jdbc import month_predicates, range_predicates
from lakeloom.sources.lake import LakeTable, committed, compact_by

LOAD_DATE = "2024-10-10"
TOTAL_EDGES = [1000, 101000, 201000, 301000, 401000, 500000]
LINE_EDGES = [0, 20000, 40000, 60000, 80000, 100000]

ORDER_ROW = """user_id, product_id, amount, discount, CAST(price AS DOUBLE) AS price,
               CAST(final_price AS DOUBLE) AS final_price, date, year, month"""
ORDER_ROW_COLUMNS = [*inputs.ORDER_COLUMNS, "year", "month"]


# Derived columns.

@query(f"""WITH prices AS (
             SELECT 'part' AS source, {sql.band('p_retailprice', sql.PRICE_EDGES)} AS price_range, p_retailprice AS price
             FROM part
             UNION ALL SELECT 'order', {sql.band('o_totalprice', TOTAL_EDGES)}, o_totalprice FROM orders
             UNION ALL SELECT 'line', {sql.band('l_extendedprice', LINE_EDGES)}, l_extendedprice FROM lineitem)
           SELECT source, price_range, count(*) AS rows, min(price) AS lowest, max(price) AS highest
           FROM prices GROUP BY source, price_range""")
def price_bands(spark, sf_dir):
    """Price bands of three price columns, two of them with other edges, since part prices fall in few default bands."""
    sources = [("part", "part", "p_retailprice", sql.PRICE_EDGES), ("order", "orders", "o_totalprice", TOTAL_EDGES),
               ("line", "lineitem", "l_extendedprice", LINE_EDGES)]
    parts = []
    for source, name, column, edges in sources:
        rows = inputs.table(spark, sf_dir, name)
        parts.append(rows.groupBy(F.lit(source).alias("source"), price_range(column, edges).alias("price_range")).agg(
            F.count(F.lit(1)).alias("rows"), F.min(column).alias("lowest"), F.max(column).alias("highest")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH {sql.USERS}
           SELECT 'order' AS source, o_orderkey AS id, {sql.decade('o_orderdate')} AS decade FROM orders
           UNION ALL SELECT 'user', id, {sql.decade('date_of_birth')} FROM users""")
def decades(spark, sf_dir):
    orders = inputs.table(spark, sf_dir, "orders").select(
        F.lit("order").alias("source"), F.col("o_orderkey").alias("id"), decade("o_orderdate").alias("decade"))
    users = inputs.users(spark, sf_dir).select(
        F.lit("user").alias("source"), "id", decade("date_of_birth").alias("decade"))
    return orders.unionByName(users)


@query(f"""WITH ids AS (SELECT 'user' AS source, c_custkey AS id FROM customer
                        UNION ALL SELECT 'product', p_partkey FROM part
                        UNION ALL SELECT 'line', l_partkey FROM lineitem)
           SELECT source, count(*) AS rows, count(DISTINCT id) AS ids, count(DISTINCT id) AS id_buckets,
                  count(*) AS rows_in_range FROM ids GROUP BY source""")
def bucket_key_audit(spark, sf_dir):
    """Bucket keys are in 0..19, and one id has one bucket. (The hash has no SQL twin, so values are not compared.)"""
    parts = []
    for source, name, column in [("user", "customer", "c_custkey"), ("product", "part", "p_partkey"),
                                 ("line", "lineitem", "l_partkey")]:
        rows = inputs.table(spark, sf_dir, name).select(F.col(column).alias("id"), bucket_key(column).alias("bucket"))
        pairs = rows.groupBy("id", "bucket").agg(F.count(F.lit(1)).alias("n"))
        ids = pairs.groupBy("id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("buckets"),
                                      F.sum(F.when(F.col("bucket").between(0, BUCKETS - 1), F.col("n"))).alias("good"))
        parts.append(ids.groupBy(F.lit(source).alias("source")).agg(
            F.sum("n").alias("rows"), F.count(F.lit(1)).alias("ids"), F.sum("buckets").alias("id_buckets"),
            F.sum("good").alias("rows_in_range")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Bronze.

@query(f"WITH {sql.ORDERS_RAW} SELECT {ORDER_ROW} FROM orders_raw")
def bronze_orders(spark, sf_dir):
    return doubles(bronze.orders(inputs.orders_raw(spark, sf_dir).drop(*inputs.EXTRA)))


@query(f"""SELECT p_partkey AS id, p_name AS name, p_retailprice AS price,
                  {sql.band('p_retailprice', sql.PRICE_EDGES)} AS price_range FROM part""")
def bronze_products(spark, sf_dir):
    return bronze.products(inputs.products(spark, sf_dir))


@query(f"WITH {sql.USERS} SELECT *, {sql.decade('date_of_birth')} AS birth_decade FROM users")
def bronze_users(spark, sf_dir):
    return bronze.users(inputs.users(spark, sf_dir))


# Silver.

@query(f"""WITH {sql.USERS} SELECT *, {sql.decade('date_of_birth')} AS birth_decade, DATE '{LOAD_DATE}' AS created_at
           FROM users""")
def dedupe_users(spark, sf_dir):
    """Users loaded twice, the second time with a birth date ten years later and so from another bronze partition: one
    row per id survives, the earlier date."""
    users = inputs.users(spark, sf_dir)
    again = users.withColumn("date_of_birth", F.col("date_of_birth") + F.expr("INTERVAL '10' YEAR"))
    rows = silver.users(bronze.users(users.unionByName(again)), LOAD_DATE, order=["date_of_birth"])
    return rows.drop("partition_key")


@query(f"""SELECT p_partkey AS id, p_name AS name, p_retailprice - 100 AS price,
                  {sql.band('p_retailprice - 100', sql.PRICE_EDGES)} AS price_range, DATE '{LOAD_DATE}' AS valid_from,
                  CAST(NULL AS DATE) AS valid_to, true AS is_current FROM part""")
def silver_products(spark, sf_dir):
    """Products loaded from two price bands: one current row per id, the lower price."""
    products = inputs.products(spark, sf_dir)
    cheaper = products.withColumn("price", F.col("price") - 100)
    rows = silver.products(bronze.products(products.unionByName(cheaper)), LOAD_DATE, order=["price"])
    return rows.drop("partition_key")


@query(f"""WITH {sql.ORDERS_RAW}, {sql.USERS},
             parts AS (SELECT {sql.band('p_retailprice', sql.PRICE_EDGES)} AS label FROM part)
           SELECT 'orders' AS source, count(*) FILTER (year BETWEEN 1996 AND 2000) AS kept,
                  count(*) FILTER (year NOT BETWEEN 1996 AND 2000) AS rejected FROM orders_raw
           UNION ALL
           SELECT 'users', count(*) FILTER ({sql.decade('date_of_birth')} BETWEEN 1920 AND 1990),
                  count(*) FILTER ({sql.decade('date_of_birth')} NOT BETWEEN 1920 AND 1990) FROM users
           UNION ALL
           SELECT 'products', count(*) FILTER (label = '905-1000'), count(*) FILTER (label <> '905-1000') FROM parts""")
def silver_rejects(spark, sf_dir):
    """How many rows of the bronze tables each domain keeps and rejects; both sides read only their own partitions."""
    cases = [
        ("orders", bronze.orders(inputs.orders_raw(spark, sf_dir)), silver.orders_domain((1996, 2000))),
        ("users", bronze.users(inputs.users(spark, sf_dir)), silver.users_domain((1920, 1990))),
        ("products", bronze.products(inputs.products(spark, sf_dir)), silver.products_domain(["905-1000"])),
    ]
    parts = []
    for source, rows, domain in cases:
        table = LakeTable(fresh_dir(spark, f"bronze_{source}"), bronze.PARTITIONS[source])
        table.overwrite(rows)
        kept, rejected = silver.domain_filter(table.read(spark), domain)
        both = kept.select(F.lit(1).alias("ok")).unionByName(rejected.select(F.lit(0).alias("ok")))
        parts.append(both.groupBy(F.lit(source).alias("source")).agg(
            F.sum("ok").alias("kept"), F.sum(1 - F.col("ok")).alias("rejected")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Tables.

def _orders_table(spark, label) -> LakeTable:
    return LakeTable(fresh_dir(spark, label), bronze.PARTITIONS["orders"])


def _order_rows(df: DataFrame) -> DataFrame:
    return doubles(df.select(*ORDER_ROW_COLUMNS))


@query(f"""WITH {sql.ORDERS_RAW}
           SELECT CASE WHEN year <= 1997 THEN 'early' ELSE 'late' END AS slice, year, month, count(*) AS rows,
                  CAST(sum(amount) AS BIGINT) AS amount FROM orders_raw GROUP BY ALL""")
def scan_pruned(spark, sf_dir):
    """The bronze table read in two slices; each scan lists and reads only its own partitions."""
    table = _orders_table(spark, "scan_pruned")
    table.append(bronze.orders(inputs.orders_raw(spark, sf_dir).select(*inputs.ORDER_COLUMNS)))
    slices = [table.read(spark, where).groupBy(F.lit(name).alias("slice"), "year", "month").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("amount").cast("bigint")).alias("amount"))
        for name, where in (("early", "year <= 1997"), ("late", "year > 1997"))]
    return slices[0].unionByName(slices[1])


@query(f"WITH {sql.ORDERS_RAW} SELECT {ORDER_ROW} FROM orders_raw")
def bronze_orders_roundtrip(spark, sf_dir):
    """Two appends, by slices of years, then a read of the whole table."""
    table = _orders_table(spark, "bronze_orders")
    rows = bronze.orders(inputs.orders_raw(spark, sf_dir).select(*inputs.ORDER_COLUMNS))
    table.append(rows.filter("year <= 1997"))
    table.append(rows.filter("year > 1997"))
    return _order_rows(table.read(spark))


@query(f"WITH {sql.SUMMARY} SELECT * FROM summary")
def gold_roundtrip(spark, sf_dir):
    """The summary mart overwritten twice: the second write replaces the first."""
    table = LakeTable(fresh_dir(spark, "gold"), ("year", "month"))
    # Brought together by month once; both writes leave the rows where they are.
    mart = committed(compact_by(summary(spark, sf_dir), table.partition_by), "summary")
    table.overwrite(mart, clustered=True)
    table.overwrite(mart, clustered=True)
    return doubles(table.read(spark))


@query(f"""WITH {sql.ORDERS}
           SELECT user_id, product_id, CASE WHEN year = 1998 THEN 2 * amount ELSE amount END AS amount, discount,
                  CAST(price AS DOUBLE) AS price, CAST(final_price AS DOUBLE) AS final_price, date, year, month
           FROM sales""")
def replace_partitions(spark, sf_dir):
    """The months of one year loaded again with other amounts, twice: replaced once, and all other months untouched."""
    table = _orders_table(spark, "silver_orders")
    table.replace_partitions(silver_orders(spark, sf_dir))
    fix = committed(table.read(spark, "year = 1998").withColumn("amount", F.col("amount") * 2), "fix")
    for _ in range(2):
        table.replace_partitions(fix)
    return _order_rows(table.read(spark))


# Serving.

@query(f"""WITH {sql.ORDERS_RAW}
           SELECT user_id, product_id, amount, CASE WHEN discount > 0 THEN CAST(discount AS DOUBLE) ELSE 0 END AS discount,
                  CAST(price AS DOUBLE) AS price, CAST(final_price AS DOUBLE) AS final_price, date, year, month
           FROM orders_raw""")
def serving_orders(spark, sf_dir):
    """Orders on the serving schema; a missing discount (here: zero ones are removed first) becomes its default."""
    rows = bronze.orders(inputs.orders_raw(spark, sf_dir))
    rows = rows.withColumn("discount", F.when(F.col("discount") > 0, F.col("discount")))
    return project(rows, wide(SERVING_ORDERS), defaults=SERVING_DEFAULTS)


@query(f"""SELECT CAST(p_partkey AS INTEGER) AS id, p_name AS name, CAST(p_retailprice AS FLOAT) AS price,
                  {sql.band('p_retailprice', sql.PRICE_EDGES)} AS price_range, DATE '{LOAD_DATE}' AS valid_from,
                  CAST(NULL AS DATE) AS valid_to, true AS is_current FROM part""")
def serving_products(spark, sf_dir):
    """Products on the narrow serving schema: 32-bit ids and prices."""
    rows = silver.products(bronze.products(inputs.products(spark, sf_dir)), LOAD_DATE)
    return project(rows, SERVING_PRODUCTS)


@query(f"""WITH {sql.USERS} SELECT *, {sql.decade('date_of_birth')} AS birth_decade, DATE '{LOAD_DATE}' AS created_at
           FROM users""")
def serving_users(spark, sf_dir):
    return project(silver.users(bronze.users(inputs.users(spark, sf_dir)), LOAD_DATE), wide(SERVING_USERS))


@query(f"WITH {sql.ORDERS} SELECT {ORDER_ROW} FROM sales")
def serving_sorted(spark, sf_dir):
    """Silver orders exported in key order and read back."""
    path = fresh_dir(spark, "serving_orders")
    # Spark first samples what it sorts by range, so the rows come from a table.
    sorted_export(committed(silver_orders(spark, sf_dir), "silver_orders"), path, SERVING_KEYS["orders"])
    return _order_rows(spark.read.parquet(path))


# The slices of parallel database reads, checked against the tables.

@query("""WITH edges AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) - min(o_orderkey) + 1 AS span FROM orders),
               slices AS (SELECT i, lo + span * i // 10 AS a, lo + span * (i + 1) // 10 AS b FROM edges, range(10) t(i)),
               placed AS (SELECT o_orderkey, count(*) AS hits, min(i) AS i
                          FROM orders JOIN slices ON o_orderkey >= a AND o_orderkey < b GROUP BY o_orderkey)
          SELECT CAST(hits AS INTEGER) AS hits, CAST(i AS INTEGER) AS slice, count(*) AS rows FROM placed GROUP BY ALL""")
def src_range_slices(spark, sf_dir):
    """The ten id ranges a parallel read of orders would use: each row is in exactly one."""
    orders = inputs.table(spark, sf_dir, "orders").select("o_orderkey")
    low, high = orders.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    return slice_counts(orders, range_predicates("o_orderkey", low, high, 10))


@query("""WITH edges AS (SELECT date_trunc('month', min(o_orderdate)) AS lo FROM orders)
          SELECT 1 AS hits, CAST(date_diff('month', lo, o_orderdate) AS INTEGER) AS slice, count(*) AS rows
          FROM orders, edges GROUP BY ALL""")
def src_month_slices(spark, sf_dir):
    """The monthly ranges a parallel read of orders would use: each row is in exactly one."""
    orders = inputs.table(spark, sf_dir, "orders").select("o_orderdate")
    first, last = orders.agg(F.min("o_orderdate"), F.max("o_orderdate") + F.expr("INTERVAL '1' DAY")).first()
    return slice_counts(orders, month_predicates("o_orderdate", first.replace(day=1), last))
