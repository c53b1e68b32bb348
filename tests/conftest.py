import pytest

from lakeloom.session import build


@pytest.fixture(scope="session")
def spark():
    session = build("tests", "local[8]", conf={
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def table_dir(tmp_path):
    return str(tmp_path / "table")


@pytest.fixture
def no_broadcast(spark):
    """Joins behave as with large inputs on both sides."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def rows(df, *columns):
    """Rows as a sorted list of tuples."""
    return sorted((tuple(row) for row in (df.select(*columns) if columns else df).collect()), key=repr)
