import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lakeloom.operators.skew import cut_hot, hot_keys
from lakeloom.operators.timeline import as_of, with_neighbour
from tests.conftest import rows

SMALL = {"task_rows": 50}
START = datetime(2024, 1, 1)


def events(spark, n=2000, seed=3):
    pick = random.Random(seed)
    data = [(1 if pick.random() < 0.4 else pick.randint(2, 60), START + timedelta(minutes=pick.randint(0, 50_000)), i)
            for i in range(n)]
    return spark.createDataFrame(data, "k bigint, t timestamp_ntz, i bigint")


def test_hot_keys_are_found_and_cold_ones_are_not(spark):
    """One key holds a third of all rows."""
    facts = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 400).alias("k"))
    assert rows(hot_keys(facts, ["k"], **SMALL), "k") == [(7,)]


def test_no_hot_key_no_slices(spark):
    assert cut_hot(events(spark, 300), ["k"], ["t", "i"], task_rows=10_000) is None
    assert cut_hot(events(spark, 1).limit(0), ["k"], ["t", "i"], task_rows=0) is None


def test_all_of_many_hot_keys_are_cut_evenly(spark):
    df = spark.range(150_000).select((F.col("id") % 1500).alias("k"), F.col("id").alias("t"))
    cold, hot = cut_hot(df, ["k"], ["t"], task_rows=99)
    assert cold.isEmpty() and hot.select("k").distinct().count() == 1500
    sizes = [r["count"] for r in hot.groupBy("_slice").count().collect()]
    assert sum(sizes) == 150_000 and max(sizes) <= 4 * 99


def test_bursty_key_is_cut_evenly(spark):
    """All but a hundredth of the key's rows are of one day in three years."""
    second = F.when(F.col("id") % 100 == 0, F.col("id") * 900).otherwise(40_000_000 + F.col("id") % 86_400)
    df = spark.range(100_000).select(F.lit(1).alias("k"), F.timestamp_seconds(second).alias("t"), F.col("id").alias("i"))
    cold, hot = cut_hot(df, ["k"], ["t", "i"], task_rows=2000)
    sizes = [r["count"] for r in hot.groupBy("_slice").count().collect()]
    assert cold.isEmpty() and sum(sizes) == 100_000 and max(sizes) <= 2 * 2000


def test_slices_are_ordered_and_only_cut_hot_keys(spark):
    df = events(spark)
    cold, hot = cut_hot(df, ["k"], ["t", "i"], **SMALL)
    assert rows(hot.select("k").distinct()) == [(1,)] and cold.filter("k = 1").isEmpty()
    assert rows(cold.unionByName(hot.drop("_slice"))) == rows(df)
    at = F.struct("t", "i")
    spans = hot.groupBy("_slice").agg(F.min(at).alias("a"), F.max(at).alias("b")).orderBy("_slice").collect()
    assert len(spans) > 10
    assert all(one.b < two.a for one, two in zip(spans, spans[1:]))


def test_rows_without_a_key_are_kept(spark):
    df = spark.createDataFrame([(None, i) for i in range(200)] + [(1, i) for i in range(200)], "k bigint, i bigint")
    plain, sliced = (with_neighbour(df, ["k"], ["i"], {"next": "i"}, **options) for options in ({}, SMALL))
    assert rows(plain) == rows(sliced) and sliced.count() == 400


@pytest.mark.parametrize("forward", [True, False])
def test_sliced_neighbour_equals_plain_window(spark, forward):
    df = events(spark)
    plain, sliced = (with_neighbour(df, ["k"], ["t", "i"], {"other": "i", "when": "t"}, forward, **options)
                     for options in ({}, SMALL))
    assert "_slice" in sliced._jdf.queryExecution().optimizedPlan().toString()
    assert rows(plain) == rows(sliced)


def test_neighbour_by_brute_force(spark):
    df = events(spark, 300)
    data = sorted((r.k, r.t, r.i) for r in df.collect())
    follow = {one[2]: two[2] for one, two in zip(data, data[1:]) if one[0] == two[0]}
    got = with_neighbour(df, ["k"], ["t", "i"], {"other": "i"}, **SMALL)
    assert {r.i: r.other for r in got.collect() if r.other is not None} == follow


@pytest.mark.parametrize("options", [{}, SMALL])
def test_as_of_by_brute_force(spark, options):
    pick = random.Random(5)
    history = []
    for k in range(0, 61):
        edges = sorted(START + timedelta(minutes=pick.randint(0, 50_000)) for _ in range(pick.randint(0, 9)))
        for n, (since, until) in enumerate(zip(edges, edges[1:] + [None])):
            if pick.random() < 0.8:  # gaps, as after a delete
                history.append((k, since, until, n))
    facts = events(spark)
    # A version that starts and ends at the start of another has no extent.
    history += [(k, since, since, -1) for k, since, _, _ in history[::7]]
    versions = spark.createDataFrame(history, "k bigint, since timestamp_ntz, until timestamp_ntz, n int")
    expected = sorted((f.k, f.t, f.i, n) for f in facts.collect() for k, since, until, n in history
                      if k == f.k and since <= f.t and (until is None or f.t < until))
    got = as_of(facts, versions, ["k"], "t", "since", "until", ["n"], **options)
    assert got.columns == ["k", "t", "i", "n"]
    assert sorted(tuple(r) for r in got.collect()) == expected
