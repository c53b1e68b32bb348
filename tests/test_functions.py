from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lakeloom.functions import bands, money
from lakeloom.functions.draws import choice, digest, draw, uniform_int


def values(spark, items, kind, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, x {kind}")
    return [row[0] for row in df.orderBy("i").select(column).collect()]


def test_price_range_edges(spark):
    prices = [None, 4.99, 5.0, 104.99, 105.0, 904.99, 905.0, 1000.0, 1000.01]
    assert values(spark, prices, "double", bands.price_range("x")) == [
        "out_of_range", "out_of_range", "5-105", "5-105", "105-205", "805-905", "905-1000", "905-1000", "out_of_range"]


def test_band_labels_are_those_of_price_range(spark):
    labels = bands.band_labels()
    assert len(labels) == 10 and labels[0] == "5-105" and labels[-1] == "905-1000"
    assert values(spark, [float(e) for e in bands.PRICE_EDGES[:-1]], "double", bands.price_range("x")) == labels


def test_decade(spark):
    days = [None, "1899-12-31", "1900-01-01", "1999-12-31", "2020-06-01", "2030-01-01"]
    got = values(spark, days, "string", bands.decade(F.col("x").cast("date")))
    assert got == [None, 1890, 1900, 1990, 2020, 2030]


def test_segment_thresholds_are_strict(spark):
    spend = [None, 0, 5000, 5000.01, 10000, 10000.01, 25000, 25000.01, 50000, 50000.01]
    got = values(spark, [None if s is None else Decimal(str(s)) for s in spend], "decimal(12,2)", bands.segment("x"))
    assert got == ["Passing buyer", "Passing buyer", "Passing buyer", "Occasional buyer", "Occasional buyer",
                   "Average buyer", "Average buyer", "Good buyer", "Good buyer", "Excellent buyer"]


def test_bucket_key_is_the_non_negative_hash_modulo(spark):
    ids = spark.range(-5000, 5000)
    bad = ids.filter((bands.bucket_key("id") != (F.hash("id") % 20 + 20) % 20) | ~bands.bucket_key("id").between(0, 19))
    assert bad.count() == 0


def test_revenue_and_discount_are_exact(spark):
    assert values(spark, [0.1, 1000.0, 19.99], "double", money.revenue(F.lit(3), "x")) == [
        Decimal("0.30"), Decimal("3000.00"), Decimal("59.97")]
    assert values(spark, [0.05, 10.01, 99.99], "double", money.discounted("x", F.lit(50))) == [
        Decimal("0.03"), Decimal("5.01"), Decimal("50.00")]


@pytest.mark.parametrize("numbers, mean", [([1, 2], 2), ([1, 1, 2], 1), ([-1, -2], -2), ([-1, 2], 1), ([7], 7)])
def test_mean_half_up(spark, numbers, mean):
    df = spark.createDataFrame([(n,) for n in numbers], "x bigint")
    assert df.agg(money.mean_half_up(F.sum("x"), F.count("x"))).first()[0] == mean


def test_mean_of_nothing_is_null(spark):
    df = spark.createDataFrame([], "x bigint")
    assert df.agg(money.mean_half_up(F.sum("x"), F.count("x"))).first()[0] is None


def test_sum_of_cents_fails_rather_than_wrapping(spark):
    df = spark.createDataFrame([(2 ** 62,), (2 ** 62,)], "x bigint")
    with pytest.raises(Exception, match="(?i)overflow"):
        df.agg(F.sum("x")).collect()


def test_draws_depend_on_row_and_seed_only(spark):
    def made(partitions, seed):
        df = spark.range(1000).repartition(partitions)
        return sorted(tuple(r) for r in df.select("id", uniform_int(digest("id", "s", seed), 1, 3, 9)).collect())
    assert made(1, 0) == made(7, 0) != made(1, 1)
    assert {value for _, value in made(3, 0)} == set(range(3, 10))


def test_draw_parts_are_spread_evenly(spark):
    bits = digest("id", "s", 0)
    halves = spark.range(4000).select(*[F.avg((draw(bits, part) >= 1 << 31).cast("int")) for part in range(4)]).first()
    assert all(0.45 < half < 0.55 for half in halves)
    picked = {r[0] for r in spark.range(200).select(choice(bits, 3, ("a", "b", "c"))).collect()}
    assert picked == {"a", "b", "c"}


def test_revenue_rounds_the_product(spark):
    lines = [(10.0, 2.5, 2500), (1000.0, 1.005, 100500), (3.0, 0.333, 100), (-1.0, 2.345, -235), (2.0, 19.99, 3998), (2.5, 10.0, 2500)]
    df = spark.createDataFrame([(a, p) for a, p, _ in lines], "amount double, price double")
    assert [r[0] for r in df.select(money.revenue_cents("amount", "price")).collect()] == [c for _, _, c in lines]


def test_discounts_round_away_from_zero(spark):
    df = spark.createDataFrame([(-10.05, 50.0), (10.05, 50.0)], "price double, percent double")
    assert [float(r[0]) for r in df.select(money.discounted("price", "percent")).collect()] == [-5.03, 5.03]
