"""Silver: deduplicated rows with lineage columns and a hash partition.

Deduplication is over the whole table, not per partition slice: the same user can sit in two birth decades, and the same
product in two price bands, of bronze. The survivor is determined by a total order over the columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.bands import BIRTH_DECADES, BUCKETS, ORDER_YEARS, band_labels, bucket_key
from lakeloom.operators.dedupe import keep_first

PARTITIONS = {"users": ("partition_key",), "products": ("partition_key",), "orders": ("year", "month")}


def _as_of(as_of: str | Column | None) -> Column:
    """The load date: an argument, so that a re-run of a load gives the same table."""
    if as_of is None:
        return F.current_date()
    return F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of


def _rest(df: DataFrame, keys: list[str]) -> list[str]:
    return [name for name in df.columns if name not in keys]


def users(bronze: DataFrame, as_of: str | Column | None = None, order: list[str] | None = None,
          buckets: int = BUCKETS) -> DataFrame:
    kept = keep_first(bronze, ["id"], order or _rest(bronze, ["id"]))
    return kept.withColumns({"created_at": _as_of(as_of), "partition_key": bucket_key("id", buckets=buckets)})


def products(bronze: DataFrame, as_of: str | Column | None = None, order: list[str] | None = None,
             buckets: int = BUCKETS) -> DataFrame:
    """Each product as its first, current version."""
    kept = keep_first(bronze, ["id"], order or _rest(bronze, ["id"]))
    return kept.withColumns({
        "valid_from": _as_of(as_of), "valid_to": F.lit(None).cast("date"), "is_current": F.lit(True),
        "partition_key": bucket_key("id", buckets=buckets),
    })


def orders(bronze: DataFrame, order: list[str] | None = None) -> DataFrame:
    keys = ["user_id", "product_id", "date"]
    return keep_first(bronze, keys, order or _rest(bronze, keys))


# Which bronze rows silver accepts.


def users_domain(decades: tuple[int, int] = BIRTH_DECADES) -> Column:
    return F.col("birth_decade").between(*decades)


def products_domain(labels: list[str] | None = None) -> Column:
    return F.col("price_range").isin(labels or band_labels())


def orders_domain(years: tuple[int, int] = ORDER_YEARS) -> Column:
    return F.col("year").between(*years)


def domain_filter(df: DataFrame, domain: Column) -> tuple[DataFrame, DataFrame]:
    """Rows inside the domain, and the rejected rest (also rows where the test is null). On a partition column both
    read only the partitions they need."""
    inside = F.coalesce(domain, F.lit(False))
    return df.filter(inside), df.filter(~inside)
