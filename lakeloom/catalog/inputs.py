"""The retail source tables and the change log, derived from the given tables.

users from customer, products from part, orders from lineitem with orders and part, changes from events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions.money import cents, discounted_cents
from lakeloom.session import tune
from lakeloom.sources import generate

# Total order among order lines with the same business key.
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate"]
EXTRA = ["l_returnflag", *LINE_ORDER]
ORDER_COLUMNS = ["user_id", "product_id", "amount", "discount", "price", "final_price", "date"]
CHANGE_FIELDS = {"user_id": "bigint", "value": "double", "event_type": "string"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, with generated phone and date of birth, which the table lacks."""
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return generate.contact(ids)


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))


def orders_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines, business-key duplicates included, with l_returnflag and the columns of `LINE_ORDER`."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", *LINE_ORDER)
    heads = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey"), F.col("o_orderdate"))
    prices = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice"))
    joined = lines.join(heads, "l_orderkey").join(prices, "l_partkey")
    percent = cents("l_discount")
    return joined.select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("int").alias("amount"),
        percent.cast("int").alias("discount"),
        F.col("p_retailprice").alias("price"),
        (discounted_cents(cents("p_retailprice"), percent * 100) / 100.0).alias("final_price"),
        F.col("o_orderdate").alias("date"),
        "l_returnflag",
        *LINE_ORDER,
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes of a row per user: op, key and values, and the sequence (ts_ms, lsn)."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    first = events.groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("_first"))
    marked = events.join(first, "user_id")
    is_first = F.struct("ts", "event_id") == F.col("_first")
    op = F.when(F.col("event_type") == "error", "d").when(is_first, "c").otherwise("u")
    return marked.select(op.alias("op"), "user_id", "value", "event_type",
                         F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("event_id").alias("lsn"))


def message(row: list[str], before: list[str], delay_ms: int = 0):
    """JSON text of a change: upserts carry the new row in `after`, deletes the old key in `before`. The connector sends it
    `delay_ms` after the change."""
    is_delete = F.col("op") == "d"
    return F.to_json(F.struct(
        F.when(is_delete, F.struct(*before)).alias("before"),
        F.when(~is_delete, F.struct(*row)).alias("after"),
        F.struct("ts_ms", "lsn").alias("source"), "op", (F.col("ts_ms") + delay_ms).alias("ts_ms")))


def messages(spark: SparkSession, sf_dir: str, delay_ms: int = 0) -> DataFrame:
    """The changes as message text."""
    return changes(spark, sf_dir).select(message(list(CHANGE_FIELDS), ["user_id"], delay_ms).alias("value"))
