"""Silver orders and the gold marts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.catalog import inputs, sql
from lakeloom.catalog.registry import doubles, query
from lakeloom.functions.bands import SPEND_SEGMENTS, segment
from lakeloom.functions.money import discounted
from lakeloom.plans import bronze, gold, silver
from lakeloom.sources.lake import committed


def silver_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deduplicated orders, with the business columns and year, month."""
    rows = silver.orders(bronze.orders(inputs.orders_raw(spark, sf_dir)), order=inputs.LINE_ORDER)
    return rows.drop(*inputs.EXTRA)


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.sales_summary_by_product(silver_orders(spark, sf_dir), inputs.products(spark, sf_dir))


def lifetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.customer_lifetime_value(silver_orders(spark, sf_dir), inputs.users(spark, sf_dir))


@query(f"WITH {sql.SUMMARY} SELECT * FROM summary")
def sales_summary(spark, sf_dir):
    return doubles(summary(spark, sf_dir))


@query(f"""WITH {sql.SUMMARY} SELECT * FROM summary
           ORDER BY total_revenue_after_discount DESC, total_orders DESC, product_id, year, month""")
def sales_summary_sorted(spark, sf_dir):
    return gold.sales_summary_sorted(doubles(summary(spark, sf_dir)))


@query(f"""WITH {sql.ORDERS} SELECT user_id, product_id, amount, discount, CAST(price AS DOUBLE) AS price,
           CAST(final_price AS DOUBLE) AS final_price, date, year, month FROM sales""")
def dedupe_orders(spark, sf_dir):
    return doubles(silver_orders(spark, sf_dir))


@query(f"""WITH {sql.ORDERS_RAW} SELECT l_orderkey, l_linenumber, l_suppkey, user_id, product_id, date,
           CAST(amount * price AS DOUBLE) AS total_revenue_before_discount,
           CAST(amount * final_price AS DOUBLE) AS total_revenue_after_discount,
           CAST(ROUND(CAST(l_extendedprice AS DECIMAL(12,2)) * (100 - discount) * CAST(0.01 AS DECIMAL(3,2)), 2) AS DOUBLE) AS discounted_total
           FROM orders_raw""")
def line_revenue(spark, sf_dir):
    lines = gold.line_revenue(inputs.orders_raw(spark, sf_dir))
    return doubles(lines.select(
        "l_orderkey", "l_linenumber", "l_suppkey", "user_id", "product_id", "date", "total_revenue_before_discount",
        "total_revenue_after_discount", discounted("l_extendedprice", "discount").alias("discounted_total")))


@query(f"""WITH {sql.LIFETIME} SELECT user_id, user_name, CAST(spent AS DOUBLE) AS total_spent, total_orders,
           CAST((2 * spent_cents + total_orders) // (2 * total_orders) AS DOUBLE) / 100 AS average_spent,
           first_order_date, last_order_date, {sql.segment('spent')} AS segment FROM spend""")
def clv(spark, sf_dir):
    return doubles(lifetime(spark, sf_dir))


@query(f"""WITH {sql.LIFETIME},
           rated AS (SELECT 1 AS scale, spent, {sql.segment('spent')} AS segment FROM spend
                     UNION ALL SELECT 20 AS scale, spent, {sql.segment('spent', 20)} AS segment FROM spend)
           SELECT scale, segment, count(*) AS users, CAST(sum(spent) AS DOUBLE) AS spent
           FROM rated GROUP BY scale, segment""")
def segment_counts(spark, sf_dir):
    """Segments with the default thresholds and with thresholds twenty times as high, which spread these users."""
    ratings = []
    for scale in (1, 20):
        name = segment("total_spent", [(limit * scale, label) for limit, label in SPEND_SEGMENTS])
        ratings.append(F.struct(F.lit(scale).alias("scale"), name.alias("segment")))
    spend = lifetime(spark, sf_dir).select("total_spent", F.inline(F.array(*ratings)))
    return doubles(gold.segment_counts(spend, ["scale"]))


@query(f"""WITH {sql.SUMMARY}
           SELECT * FROM (SELECT *, CAST(rank() OVER (ORDER BY total_revenue_after_discount DESC) AS INTEGER) AS rank
                          FROM summary) WHERE rank <= 10""")
def top_products(spark, sf_dir):
    return doubles(gold.top_products_by_revenue(committed(summary(spark, sf_dir), "summary")))


@query(f"""WITH {sql.SUMMARY}
           SELECT * FROM (SELECT *, CAST(rank() OVER (PARTITION BY year, month
                                                     ORDER BY total_revenue_after_discount DESC) AS INTEGER) AS rank
                          FROM summary) WHERE rank <= 10""")
def top_products_monthly(spark, sf_dir):
    mart = committed(summary(spark, sf_dir), "summary")
    return doubles(gold.top_products_by_revenue(mart, by=["year", "month"]))


@query(f"""WITH {sql.SUMMARY}
           SELECT * FROM (SELECT *, CAST(rank() OVER (ORDER BY total_revenue_after_discount DESC) AS INTEGER) AS rank
                          FROM summary) WHERE rank <= 5000""")
def top_products_many(spark, sf_dir):
    """More top rows than one task should rank, in one group of all rows."""
    return doubles(gold.top_products_by_revenue(committed(summary(spark, sf_dir), "summary"), 5000))


@query(f"""WITH {sql.SUMMARY}
           SELECT * FROM (SELECT *, CAST(rank() OVER (PARTITION BY year ORDER BY total_revenue_after_discount DESC) AS INTEGER)
                            AS rank FROM summary) WHERE rank <= 1500""")
def top_products_yearly(spark, sf_dir):
    """The 1500 best rows of each year, ranked by ranges that cut the years."""
    return doubles(gold.top_products_by_revenue(committed(summary(spark, sf_dir), "summary"), 1500, by=["year"]))
