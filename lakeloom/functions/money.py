"""Exact money arithmetic.

Money and percentages have two decimals throughout. They are computed with as whole hundredths (bigint), so sums and
products run in generated code on longs, do not depend on the order of the rows, and overflow raises an error instead of
turning into null. Only results become decimals again. Binary doubles are never summed or rounded: two engines, or two
orders of the rows, could then differ in the last cent.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeloom.functions.bands import _col

MART_MONEY = "decimal(20,2)"


def cents(col: Column | str) -> Column:
    """Hundredths of a value with two decimals. The product with 100 is within 1e-3 of a whole number for all values up
    to 10^13, so taking the nearest one is exact."""
    return F.floor(_col(col).cast("double") * 100 + 0.5).cast("bigint")


def from_cents(col: Column | str) -> Column:
    return (_col(col).cast("decimal(20,0)") * F.lit("0.01").cast("decimal(2,2)")).cast(MART_MONEY)


def revenue_cents(amount: Column | str, price: Column | str) -> Column:
    """Revenue of a line, `amount * price`, in cents, rounded half away from zero.

    A whole amount times whole cents is computed on longs. Other values are multiplied as decimals of six places, and the
    product is rounded, never the factors.
    """
    amount, price = _col(amount), _col(price)
    scaled = price.cast("double") * 100
    whole = (amount.cast("double") == F.floor(amount.cast("double"))) & (F.abs(scaled - F.round(scaled)) < 1e-6)
    product = F.round(amount.cast("decimal(19,6)") * price.cast("decimal(19,6)"), 2)
    return F.when(whole, amount.cast("bigint") * cents(price)).otherwise((product * 100).cast("bigint"))


def revenue(amount: Column | str, price: Column | str) -> Column:
    return from_cents(revenue_cents(amount, price))


def discounted_cents(price_cents: Column, percent_hundredths: Column) -> Column:
    """Price less a discount, rounded half away from zero to cents."""
    left = price_cents * (10_000 - percent_hundredths)
    size = F.call_function("div", F.abs(left) + 5_000, F.lit(10_000))
    return F.when(left < 0, -size).otherwise(size)


def discounted(price: Column | str, percent: Column | str) -> Column:
    return from_cents(discounted_cents(cents(price), cents(percent)))


def mean_half_up(total: Column, count: Column) -> Column:
    """Mean of whole numbers given their sum and count, rounded half away from zero, without leaving integers."""
    size = F.call_function("div", F.abs(total) * 2 + count, count * 2)
    return F.when(count > 0, F.when(total < 0, -size).otherwise(size))
