"""Gold: the three marts.

Sales are summed per key before the dimension is joined. Names depend on the id alone, so the result is that of joining
first, but only one row per group meets the dimension: the join moves little data, and a product or user with a third of
all orders is no larger there than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.bands import LOWEST_SEGMENT, SPEND_SEGMENTS, segment
from lakeloom.functions.money import cents, from_cents, mean_half_up, revenue, revenue_cents
from lakeloom.operators.maintain import Measures, totals
from lakeloom.operators.ranking import top_by_rank
from lakeloom.operators.timeline import as_of
from lakeloom.sources.lake import compact_by

REVENUE = "total_revenue_after_discount"
MART_ORDER = [REVENUE, "total_orders"]


def line_revenue(orders: DataFrame) -> DataFrame:
    """Orders with the revenue of each line, before and after discount."""
    return orders.withColumns({
        "total_revenue_before_discount": revenue("amount", "price"),
        "total_revenue_after_discount": revenue("amount", "final_price"),
    })


def current_names(dimension: DataFrame) -> DataFrame:
    """id and name of the rows in force. A table with versions has one per id; without this filter each order would count
    once per version."""
    rows = dimension.filter("is_current") if "is_current" in dimension.columns else dimension
    return rows.select("id", "name")


def sales_measures() -> Measures:
    """What the sales summary sums up, per product and month."""
    return Measures(("year", "month", "product_id"),
                    sums={"total_sale": "amount", "_before": revenue_cents("amount", "price"),
                          "_after": revenue_cents("amount", "final_price"), "_discount": cents("discount")},
                    counts={"_discounts": "discount", "total_orders": "user_id"})


def lifetime_measures() -> Measures:
    """What customer lifetime value sums up, per user."""
    spent = revenue_cents("amount", "final_price")
    return Measures(("user_id",), sums={"_spent": spent}, counts={"_lines": spent, "total_orders": "user_id"},
                    edges={"_first": ("min", "date"), "_last": ("max", "date")})


def sales_summary_by_product(orders: DataFrame, products: DataFrame, together: Sequence[str] = ()) -> DataFrame:
    """Sales per product and month. Orders of unknown products are left out; ids of current products are unique."""
    return named_sales(totals(orders, sales_measures()), products, together)


def named_sales(sums: DataFrame, products: DataFrame, together: Sequence[str] = ()) -> DataFrame:
    """The sales summary from its sums, brought `together` by these columns for a clustered write: as whole cents, which are half
    as wide as the decimals they become."""
    names = current_names(products).select(F.col("id").alias("product_id"), F.col("name").alias("product_name"))
    named = sums.join(names, "product_id")
    return (compact_by(named, together) if together else named).select(
        "year", "month", "product_id", "product_name", "total_sale",
        from_cents("_before").alias("total_revenue_before_discount"),
        from_cents("_after").alias(REVENUE),
        from_cents(mean_half_up(F.col("_discount"), F.col("_discounts"))).alias("average_discount"),
        "total_orders",
    )


def sales_summary_sorted(summary: DataFrame) -> DataFrame:
    """The summary from best to worst. The ids behind the two sort keys make the order total and let Spark cut the range of
    rows with equal revenue into several tasks."""
    return summary.orderBy(*[F.col(name).desc() for name in MART_ORDER], "product_id", "year", "month")


def customer_lifetime_value(orders: DataFrame, users: DataFrame,
                            thresholds: Sequence[tuple[float, str]] = SPEND_SEGMENTS,
                            lowest: str = LOWEST_SEGMENT) -> DataFrame:
    """Spend, order count, mean spend, first and last day, and spend segment per user."""
    return named_lifetime(totals(orders, lifetime_measures()), users, thresholds, lowest)


def named_lifetime(sums: DataFrame, users: DataFrame, thresholds: Sequence[tuple[float, str]] = SPEND_SEGMENTS,
                   lowest: str = LOWEST_SEGMENT) -> DataFrame:
    """Customer lifetime value from its sums."""
    names = current_names(users).select(F.col("id").alias("user_id"), F.col("name").alias("user_name"))
    spend = sums.join(names, "user_id").select(
        "user_id", "user_name", from_cents("_spent").alias("total_spent"), "total_orders",
        from_cents(mean_half_up(F.col("_spent"), F.col("_lines"))).alias("average_spent"),
        F.to_date("_first").alias("first_order_date"), F.to_date("_last").alias("last_order_date"),
    )
    return spend.withColumn("segment", segment("total_spent", thresholds, lowest))


def segment_counts(lifetime_value: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return lifetime_value.groupBy(*by, "segment").agg(
        F.count(F.lit(1)).alias("users"), F.sum("total_spent").cast("decimal(20,2)").alias("spent"))


def top_products_by_revenue(summary: DataFrame, n: int = 10, by: list[str] | None = None) -> DataFrame:
    """Rows of the sales summary (product and month) of rank at most n by revenue, ties kept; `by` ranks within groups,
    such as ['year', 'month']."""
    return top_by_rank(summary, REVENUE, n, by)


def enrich_orders(orders: DataFrame, products: DataFrame, version: str = "current",
                  columns: Sequence[str] = ("name", "price_range"), **skew) -> DataFrame:
    """Orders with product columns, prefixed `product_`: from the product's current version, or with `version='as_of'`
    from the version in force at the time of the order."""
    renamed = products.select(F.col("id").alias("product_id"),
                              *[F.col(name).alias(f"product_{name}") for name in columns],
                              *[F.col(name) for name in ("valid_from", "valid_to", "is_current")
                                if name in products.columns])
    wanted = [f"product_{name}" for name in columns]
    if version == "current":
        if "is_current" in renamed.columns:
            renamed = renamed.filter("is_current")
        return orders.join(renamed.select("product_id", *wanted), "product_id")
    if version == "as_of":
        return as_of(orders, renamed, ["product_id"], "date", "valid_from", "valid_to", wanted, **skew)
    raise ValueError(f"unknown version {version!r}")
