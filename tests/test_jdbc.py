"""Reads and writes over JDBC, as far as they can be checked without a database: what is handed to Spark's reader and
writer, and that the slices cover a table exactly."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lakeloom.operators.slices import slice_counts
from lakeloom.plans import batch
from lakeloom.sinks import serving
from lakeloom.sources import jdbc
from tests.conftest import rows

CONN = jdbc.JdbcConnection("jdbc:x://host/db", driver="x.Driver", user="u", password="secret")


class FakeReader:
    """Records what a job asks of `spark.read`; `first` answers the query for the bounds."""

    def __init__(self, bounds):
        self.bounds, self.asked, self.called = bounds, {}, None
        self.read = self

    def format(self, name):
        self.asked["format"] = name
        return self

    def options(self, **values):
        self.asked.update(values)
        return self

    def option(self, key, value):
        self.asked[key] = value
        return self

    def load(self):
        return self

    def first(self):
        return self.bounds

    def jdbc(self, url, table, predicates=None, properties=None):
        self.called = (url, table, predicates, properties)
        return self


def test_range_predicates_cover_once(spark):
    for low, high, parts in ((1, 1000, 10), (5, 7, 10), (-50, 49, 7), (3, 3, 4)):
        ids = spark.range(low, high + 1)
        predicates = jdbc.range_predicates("id", low, high, parts)
        counts = slice_counts(ids, predicates).collect()
        assert {row.hits for row in counts} == {1} and sum(row.rows for row in counts) == high - low + 1
        sizes = [row.rows for row in counts]
        assert len(sizes) == len(predicates) <= parts and max(sizes) - min(sizes) <= 1
    assert jdbc.range_predicates("id", 2, 1, 3) == []


def test_month_predicates_cover_once(spark):
    start, end = datetime(2023, 10, 9), datetime(2024, 10, 10)
    stamps = spark.range(0, 367 * 48).select(
        (F.lit(start).cast("timestamp_ntz") + F.expr("make_dt_interval(0, 0, 30 * id, 0.999999)")).alias("date"))
    stamps = stamps.filter(F.col("date") < F.lit(end).cast("timestamp_ntz"))
    predicates = jdbc.month_predicates("date", start, end)
    assert len(predicates) == 13
    counts = slice_counts(stamps, predicates).collect()
    assert {row.hits for row in counts} == {1} and len(counts) == 13
    counts = slice_counts(stamps, jdbc.month_predicates("date", start, end, pieces=7)).collect()
    assert {row.hits for row in counts} == {1} and len(counts) == 91


def test_month_predicates_text():
    assert jdbc.month_predicates("date", datetime(2023, 12, 9), datetime(2024, 1, 10)) == [
        "\"date\" >= TIMESTAMP '2023-12-09 00:00:00.000000' AND \"date\" < TIMESTAMP '2024-01-01 00:00:00.000000'",
        "\"date\" >= TIMESTAMP '2024-01-01 00:00:00.000000' AND \"date\" < TIMESTAMP '2024-01-10 00:00:00.000000'"]
    assert jdbc.month_predicates("date", datetime(2024, 1, 1), datetime(2024, 1, 1)) == []


def test_range_read_is_whole_by_default():
    reader = FakeReader((1, 100))
    jdbc.jdbc_range(reader, CONN, "users", "id", parts=4)
    url, table, predicates, properties = reader.called
    assert (url, table, len(predicates)) == ("jdbc:x://host/db", "users", 4)
    assert predicates[0] == '"id" >= 1 AND "id" < 26' and predicates[-1] == '"id" >= 76 AND "id" < 101'
    assert properties == {"driver": "x.Driver", "user": "u", "password": "secret", "fetchsize": "10000", "batchsize": "10000"}
    assert reader.asked["query"] == 'SELECT MIN("id") AS lo, MAX("id") AS hi FROM users'


def test_range_read_with_bounds_reads_only_those():
    reader = FakeReader(None)
    jdbc.jdbc_range(reader, CONN, "users", "id", parts=2, low=11, high=20)
    assert reader.called[2] == ['"id" >= 11 AND "id" < 16', '"id" >= 16 AND "id" < 21']
    jdbc.jdbc_range(reader, CONN, "users", "id", low=5, high=4)
    assert reader.called[2] == ["1 = 0"]


def test_range_read_of_an_empty_table():
    reader = FakeReader((None, None))
    jdbc.jdbc_range(reader, CONN, "users", "id")
    assert reader.called[2] is None


def test_month_read():
    reader = FakeReader(None)
    jdbc.jdbc_months(reader, CONN, "orders", "date", datetime(2023, 10, 9), datetime(2024, 10, 10))
    assert len(reader.called[2]) == 13


def test_connection_from_env():
    env = {"SRC_URL": "jdbc:x", "SRC_USER": "me", "SRC_FETCHSIZE": "5"}
    conn = jdbc.JdbcConnection.from_env("SRC", env)
    assert (conn.url, conn.user, conn.password, conn.fetchsize, conn.batchsize) == ("jdbc:x", "me", None, 5, 10_000)
    with pytest.raises(KeyError):
        jdbc.JdbcConnection.from_env("OTHER", env)
    assert "secret" not in repr(CONN)


class FakeFrame:
    def __init__(self):
        self.write, self.asked = self, {}

    def repartition(self, tasks):
        return self.option("tasks", tasks)

    def format(self, name):
        return self.option("format", name)

    def mode(self, name):
        return self.option("mode", name)

    def options(self, **values):
        self.asked.update(values)
        return self

    def option(self, key, value):
        self.asked[key] = value
        return self

    def save(self):
        self.asked["saved"] = True


def test_jdbc_append_options():
    frame = FakeFrame()
    serving.jdbc_append(frame, CONN, "products", connections=3)
    assert frame.asked == {
        "format": "jdbc", "mode": "append", "driver": "x.Driver", "user": "u", "password": "secret", "fetchsize": "10000",
        "batchsize": "10000", "url": "jdbc:x://host/db", "dbtable": "products", "tasks": 3, "numPartitions": 3,
        "saved": True}


def test_publish_sends_each_table_to_its_own(spark, tmp_path, monkeypatch):
    from tests.test_tables import sources
    lake = batch.Lake(str(tmp_path))
    batch.load_bronze(lake, sources(spark))
    batch.load_silver(spark, lake, "2024-10-10")
    sent = {}
    monkeypatch.setattr(batch, "jdbc_append", lambda df, conn, table, fields: sent.update({table: (rows(df), fields)}))
    batch.publish(spark, lake, CONN)
    assert set(sent) == {"users", "products", "orders"}
    assert len(sent["users"][0]) == 50 and "partition_key" not in sent["users"][1]
