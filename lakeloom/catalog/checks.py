"""Data quality and generated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.catalog import inputs, sql
from lakeloom.catalog.registry import query
from lakeloom.operators import quality
from lakeloom.schemas import REQUIRED, SOURCE_KEYS, apply_defaults
from lakeloom.sources import generate

SEED = 1
UNTIL = "2024-10-10 00:00:00"

# Orders with damage: missing amounts and discounts, unknown products, discounts out of range, rows loaded twice.
DAMAGED = f"""{sql.ORDERS_RAW},
hurt AS (
  SELECT user_id, CASE WHEN discount = 10 THEN -1 - product_id ELSE product_id END AS product_id,
         CASE WHEN l_returnflag = 'R' AND discount = 0 THEN NULL ELSE amount END AS amount,
         CASE WHEN l_returnflag = 'A' AND discount = 5 THEN 60 WHEN discount = 1 THEN NULL ELSE discount END AS discount,
         price, final_price, date, l_orderkey, l_linenumber, l_suppkey
  FROM orders_raw),
damaged AS (SELECT * FROM hurt UNION ALL SELECT * FROM hurt WHERE discount = 3)"""


def damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.orders_raw(spark, sf_dir)
    discount, flag = F.col("discount"), F.col("l_returnflag")
    hurt = rows.select(
        "user_id",
        F.when(discount == 10, -1 - F.col("product_id")).otherwise(F.col("product_id")).alias("product_id"),
        F.when((flag == "R") & (discount == 0), None).otherwise(F.col("amount")).alias("amount"),
        F.when((flag == "A") & (discount == 5), 60).when(discount == 1, None).otherwise(discount).alias("discount"),
        *[F.col(name).cast("decimal(12,2)").alias(name) for name in ("price", "final_price")],
        "date", "l_orderkey", "l_linenumber", "l_suppkey")
    copies = F.when(F.col("discount") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return hurt.withColumn("_copy", F.explode(copies)).drop("_copy")


NULL_COUNTS = " UNION ALL ".join(
    f"SELECT '{name}' AS rule, count(*) AS rows, count(*) FILTER ({name} IS NULL) AS failed FROM damaged"
    for name in [*REQUIRED["orders"], "discount"])


@query(f"WITH {DAMAGED} {NULL_COUNTS}")
def dq_not_null(spark, sf_dir):
    return quality.not_null(damaged(spark, sf_dir), [*REQUIRED["orders"], "discount"])


@query(f"""WITH {DAMAGED}, groups AS (SELECT count(*) AS n FROM damaged GROUP BY user_id, product_id, date)
           SELECT count(*) AS duplicated_keys, CAST(sum(n - 1) AS BIGINT) AS extra_rows FROM groups WHERE n > 1""")
def dq_unique(spark, sf_dir):
    return quality.unique(damaged(spark, sf_dir), SOURCE_KEYS["orders"])


@query(f"""WITH {DAMAGED} SELECT product_id, count(*) AS rows FROM damaged
           WHERE product_id NOT IN (SELECT p_partkey FROM part) GROUP BY product_id""")
def dq_fk(spark, sf_dir):
    return quality.orphans(damaged(spark, sf_dir), "product_id", inputs.products(spark, sf_dir), "id")


@query(f"""WITH {DAMAGED} SELECT l_orderkey, l_linenumber, l_suppkey, amount, coalesce(discount, 0) AS discount
           FROM damaged""")
def dq_defaults(spark, sf_dir):
    rows = apply_defaults(damaged(spark, sf_dir), {"discount": 0})
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", "amount", "discount")


# The domains of the source columns.
ORDER_RULES = {
    "amount": "amount BETWEEN 1 AND 20",
    "discount": "discount BETWEEN 0 AND 50",
    "price": "price BETWEEN 5 AND 1000",
    "final_price": "abs(100 * final_price - price * (100 - discount)) <= 0.5",
}


@query(f"WITH {DAMAGED} " + " UNION ALL ".join(
    f"SELECT '{name}' AS rule, count(*) AS rows, count(*) FILTER (NOT coalesce({rule}, false)) AS failed FROM damaged"
    for name, rule in ORDER_RULES.items()))
def dq_domain(spark, sf_dir):
    return quality.expect(damaged(spark, sf_dir), ORDER_RULES)


# Generated rows. Their number follows the given tables.

def _pick(words: tuple[str, ...], draw: str) -> str:
    return f"[{', '.join(repr(word) for word in words)}][{draw} % {len(words)} + 1]"


@query(f"""SELECT c_custkey AS id,
             concat_ws(' ', {_pick(generate.FIRST_NAMES, sql.draw('c_custkey', 'user', 0, SEED))},
                            {_pick(generate.LAST_NAMES, sql.draw('c_custkey', 'user', 1, SEED))}) AS name,
             '+' || CAST(10000000000 + {sql.draw('c_custkey', 'contact', 0, SEED)} AS VARCHAR) AS phone,
             CAST(DATE '1915-01-01' + CAST({sql.draw('c_custkey', 'contact', 1, SEED)} % 36525 AS INTEGER) AS TIMESTAMP)
               AS date_of_birth FROM customer""")
def gen_users(spark, sf_dir):
    ids = inputs.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return generate.users(ids, SEED)


@query(f"""WITH edges AS (SELECT min(p_partkey) AS lo, max(p_partkey) AS hi FROM part),
           ids AS (SELECT unnest(range(lo, hi + 1)) AS id FROM edges)
           SELECT id, concat_ws(' ', {_pick(generate.ADJECTIVES, sql.draw('id', 'product', 0, SEED))},
                                     {_pick(generate.MATERIALS, sql.draw('id', 'product', 1, SEED))},
                                     {_pick(generate.THINGS, sql.draw('id', 'product', 2, SEED))}) AS name,
                  CAST(500 + {sql.draw('id', 'product', 3, SEED)} % 99501 AS DOUBLE) / 100 AS price FROM ids""")
def gen_products(spark, sf_dir):
    """A product for each id in the range of part ids."""
    low, high = inputs.table(spark, sf_dir, "part").agg(F.min("p_partkey"), F.max("p_partkey")).first()
    return generate.products(generate.ids(spark, low, high), SEED)


@query(f"""WITH sizes AS (SELECT (SELECT count(*) FROM customer) AS users, (SELECT count(*) FROM part) AS products),
           drawn AS (
             SELECT 1 + {sql.draw('o_orderkey', 'order', 0, SEED)} % users AS user_id,
                    1 + {sql.draw('o_orderkey', 'order', 1, SEED)} % products AS product_id,
                    CAST(1 + {sql.draw('o_orderkey', 'line', 0, SEED)} % 20 AS INTEGER) AS amount,
                    {sql.draw('o_orderkey', 'line', 1, SEED)} % 5001 AS percent,
                    500 + {sql.draw('o_orderkey', 'line', 2, SEED)} % 99501 AS cents,
                    1 + {sql.draw('o_orderkey', 'order', 2, SEED)} % 31536000 AS age
             FROM orders, sizes)
           SELECT user_id, product_id, amount, CAST(percent AS DOUBLE) / 100 AS discount,
                  CAST(cents AS DOUBLE) / 100 AS price,
                  CAST((cents * (10000 - percent) + 5000) // 10000 AS DOUBLE) / 100 AS final_price,
                  TIMESTAMP '{UNTIL}' - to_seconds(age) AS date FROM drawn""")
def gen_orders(spark, sf_dir):
    """As many orders as the orders table has."""
    users = inputs.table(spark, sf_dir, "customer").count()
    products = inputs.table(spark, sf_dir, "part").count()
    ids = inputs.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return generate.orders(ids, users, products, UNTIL, SEED)


@query("""SELECT rule, count(*) AS rows, CAST(0 AS BIGINT) AS failed FROM orders,
          (SELECT unnest(['amount', 'discount', 'price', 'final_price']) AS rule) GROUP BY rule""")
def gen_orders_audit(spark, sf_dir):
    """Generated orders satisfy the domain rules without exception."""
    rows = gen_orders(spark, sf_dir)
    exact = rows.withColumns({name: F.col(name).cast("decimal(12,2)") for name in ("discount", "price", "final_price")})
    return quality.expect(exact, ORDER_RULES)
