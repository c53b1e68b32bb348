"""Derived partition and band columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Price band edges and the label outside them, spend segments, bucket count, birth decades.
PRICE_EDGES = (5, 105, 205, 305, 405, 505, 605, 705, 805, 905, 1000)
OUT_OF_RANGE = "out_of_range"
SPEND_SEGMENTS = (
    (50000, "Excellent buyer"),
    (25000, "Good buyer"),
    (10000, "Average buyer"),
    (5000, "Occasional buyer"),
)
LOWEST_SEGMENT = "Passing buyer"
BUCKETS = 20
BIRTH_DECADES = (1900, 2020)
ORDER_YEARS = (2023, 2024)


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def band_labels(edges: Sequence[float] = PRICE_EDGES) -> list[str]:
    return [f"{low}-{high}" for low, high in zip(edges, edges[1:])]


def price_range(price: Column | str, edges: Sequence[float] = PRICE_EDGES) -> Column:
    """Label of the band holding `price`. Bands are half-open, but the last one includes its upper edge;
    a null price or one outside all bands is `out_of_range`."""
    price = _col(price)
    label = F.lit(OUT_OF_RANGE)
    for low, high, name in zip(edges, edges[1:], band_labels(edges)):
        below = price <= high if high == edges[-1] else price < high
        label = F.when((price >= low) & below, name).otherwise(label)
    return label


def decade(day: Column | str) -> Column:
    """First year of the decade `day` falls in; null stays null."""
    year = F.year(_col(day))
    return (year - F.pmod(year, F.lit(10))).cast("int")


def year_month(day: Column | str) -> dict[str, Column]:
    day = _col(day)
    return {"year": F.year(day), "month": F.month(day)}


def bucket_key(*keys: Column | str, buckets: int = BUCKETS) -> Column:
    """Non-negative hash bucket of the key (Murmur3, the hash Spark itself partitions by).

    The hash of an int and of a bigint of the same value differ, so cast keys to the table's type first.
    A null key hashes to a bucket as well; callers reject null keys before this point.
    """
    return F.pmod(F.hash(*[_col(key) for key in keys]), F.lit(buckets))


def segment(spend: Column | str, thresholds: Sequence[tuple[float, str]] = SPEND_SEGMENTS,
            lowest: str = LOWEST_SEGMENT) -> Column:
    """Spend segment: the name of the highest threshold strictly exceeded, else (or null) the lowest one."""
    spend = _col(spend)
    name = F.lit(lowest)
    for threshold, label in sorted(thresholds):
        name = F.when(spend > threshold, label).otherwise(name)
    return name
