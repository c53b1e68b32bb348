"""Bronze: source rows plus the columns the tables are partitioned by."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lakeloom.functions.bands import decade, price_range, year_month

PARTITIONS = {"users": ("birth_decade",), "products": ("price_range",), "orders": ("year", "month")}


def users(raw: DataFrame) -> DataFrame:
    return raw.withColumn("birth_decade", decade("date_of_birth"))


def products(raw: DataFrame) -> DataFrame:
    return raw.withColumn("price_range", price_range("price"))


def orders(raw: DataFrame) -> DataFrame:
    return raw.withColumns(year_month("date"))
