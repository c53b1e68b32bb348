"""Change messages, merges and dimension history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.catalog import inputs, sql
from lakeloom.catalog.marts import silver_orders
from lakeloom.catalog.registry import doubles, query
from lakeloom.functions.bands import price_range
from lakeloom.operators import cdc, merge, scd2
from lakeloom.plans import gold
from lakeloom.sources.lake import committed

KEY = ["user_id"]
LATE = ("view", "signup")  # event types whose changes arrive in a second batch


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.parse(inputs.messages(spark, sf_dir), inputs.CHANGE_FIELDS, KEY)


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accepted changes as a table, as bronze would hold them: messages are parsed once, whatever follows."""
    return committed(cdc.accepted(parsed(spark, sf_dir)), "changes")


def batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The changes in two batches that interleave in time, so that the second holds many late changes."""
    rows = changes(spark, sf_dir)
    late = F.coalesce(F.col("event_type").isin(*LATE), F.lit(False))  # a delete has no event type
    return rows.filter(~late), rows.filter(late)


# SQL: state after all changes, versions of all changes.
ROWS = f"""{sql.CHANGES},
rows AS (SELECT user_id, ts_ms, lsn, op = 'd' AS deleted, CASE WHEN op <> 'd' THEN value END AS value,
                CASE WHEN op <> 'd' THEN event_type END AS event_type FROM changes)"""
LAST = f"""{ROWS},
last AS (SELECT * EXCLUDE (rn) FROM (
           SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms DESC, lsn DESC) AS rn FROM rows)
         WHERE rn = 1)"""
VERSIONS = f"""{ROWS},
versions AS (SELECT user_id, value, event_type, deleted, epoch_ms(ts_ms) AS valid_from,
                    epoch_ms(lead(ts_ms) OVER w) AS valid_to, lead(ts_ms) OVER w IS NULL AS is_current
             FROM rows WINDOW w AS (PARTITION BY user_id ORDER BY ts_ms, lsn))"""
HISTORY_SQL = f"WITH {VERSIONS} SELECT * EXCLUDE (deleted) FROM versions WHERE NOT deleted"


@query(f"""WITH {sql.CHANGES}
           SELECT CASE WHEN op = 'd' THEN 'delete' ELSE 'upsert' END AS kind, op, ts_ms, lsn, op = 'd' AS deleted, user_id,
                  CASE WHEN op <> 'd' THEN value END AS value, CASE WHEN op <> 'd' THEN event_type END AS event_type,
                  CAST(NULL AS VARCHAR) AS raw FROM changes""")
def cdc_parse(spark, sf_dir):
    return parsed(spark, sf_dir)


@query(f"""WITH {sql.CHANGES}
           SELECT 'as_sent' AS variant, CASE WHEN op = 'd' THEN 'delete' ELSE 'upsert' END AS kind, count(*) AS messages
           FROM changes GROUP BY ALL
           UNION ALL SELECT 'absent', 'empty', count(*) FROM changes
           UNION ALL SELECT 'cut', 'malformed', count(*) FROM changes
           UNION ALL SELECT 'other_op', 'unknown', count(*) FROM changes
           UNION ALL SELECT 'typed', 'malformed', count(*) FROM changes
           UNION ALL SELECT 'bare', 'incomplete', count(*) FROM changes
           UNION ALL SELECT 'untimed', 'incomplete', count(*) FROM changes""")
def cdc_ops(spark, sf_dir):
    """Every message as sent and damaged in six ways, classified."""
    text = F.col("value")
    variants = {
        "as_sent": text,
        "absent": F.lit(None).cast("string"),
        "cut": F.expr("left(value, length(value) - 1)"),
        "other_op": F.regexp_replace(text, '"op":"[a-z]"', '"op":"x"'),
        "typed": F.regexp_replace(text, '"user_id":', '"user_id":"a","was":'),
        "bare": F.regexp_replace(text, '"(before|after)":', '"other":'),
        "untimed": F.regexp_replace(text, '"ts_ms":', '"sent":'),
    }
    sent = inputs.messages(spark, sf_dir).select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("variant"), changed.alias("value")) for name, changed in variants.items()])))
    kinds = cdc.parse(sent, inputs.CHANGE_FIELDS, KEY, keep=["variant"])
    return kinds.groupBy("variant", "kind").agg(F.count(F.lit(1)).alias("messages"))


@query(f"WITH {LAST} SELECT * FROM last")
def cdc_latest(spark, sf_dir):
    return cdc.latest(cdc.accepted(parsed(spark, sf_dir)), KEY)


@query(f"WITH {sql.CHANGES} SELECT DISTINCT user_id FROM changes")
def batch_keys(spark, sf_dir):
    return merge.batch_keys(cdc.accepted(parsed(spark, sf_dir)), KEY)


def _customers(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Customers, and a batch of urgent orders with their customer as `c_custkey`."""
    urgent = inputs.table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    return (inputs.table(spark, sf_dir, "customer"),
            urgent.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice"))


@query("""SELECT * FROM customer WHERE c_acctbal < 0
          AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def lookup_existing(spark, sf_dir):
    """Customers in debt that occur in a batch of urgent orders."""
    customers, batch = _customers(spark, sf_dir)
    return merge.lookup_existing(customers, batch, ["c_custkey"], "c_acctbal < 0")


@query("""SELECT o_custkey AS c_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'
          AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)""")
def new_rows_anti(spark, sf_dir):
    """Urgent orders whose customer is not among those in credit."""
    customers, batch = _customers(spark, sf_dir)
    return merge.new_rows(batch, customers.filter("c_acctbal >= 0"), ["c_custkey"])


# For the conditional merge: the table lacks one type of part and has a closed version of each, the source lacks another type.
TODAY = "2024-10-10"
MERGE_SOURCE_SQL = f"""source AS (SELECT p_partkey AS id, p_name AS name, p_retailprice + 10 AS price,
         CASE WHEN p_size <= 15 THEN 'u' ELSE 'c' END AS operation FROM part WHERE p_type <> 'PROMO')"""


@query(f"""WITH target AS (
             SELECT p_partkey AS id, p_name AS name, p_retailprice AS price, DATE '2024-01-01' AS valid_from,
                    CAST(NULL AS DATE) AS valid_to, true AS is_current FROM part WHERE p_type <> 'ECONOMY'
             UNION ALL SELECT p_partkey, p_name, p_retailprice - 100, DATE '2023-01-01', DATE '2024-01-01', false
             FROM part),
           {MERGE_SOURCE_SQL}
           SELECT t.id, t.name, t.price, {sql.band('t.price', sql.PRICE_EDGES)} AS price_range, t.valid_from,
                  CASE WHEN t.is_current AND s.operation = 'u' THEN DATE '{TODAY}' ELSE t.valid_to END AS valid_to,
                  t.is_current AND coalesce(s.operation <> 'u', true) AS is_current
           FROM target t LEFT JOIN source s ON s.id = t.id AND t.is_current
           UNION ALL
           SELECT id, name, price, {sql.band('price', sql.PRICE_EDGES)}, DATE '{TODAY}', NULL, true
           FROM source WHERE id NOT IN (SELECT id FROM target WHERE is_current)""")
def merge_conditional(spark, sf_dir):
    """MERGE on id and current flag: an update closes the current row, an unknown id is inserted, all else stays."""
    parts = inputs.table(spark, sf_dir, "part")
    day = lambda text: F.lit(text).cast("date")

    def rows(df, price, since, until, is_current):
        return df.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), price.alias("price"),
                         price_range(price).alias("price_range"), day(since).alias("valid_from"),
                         day(until).alias("valid_to"), F.lit(is_current).alias("is_current"))

    price = F.col("p_retailprice")
    target = rows(parts.filter("p_type <> 'ECONOMY'"), price, "2024-01-01", None, True).unionByName(
        rows(parts, price - 100, "2023-01-01", "2024-01-01", False))
    source = parts.filter("p_type <> 'PROMO'").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (price + 10).alias("price"),
        F.when(F.col("p_size") <= 15, "u").otherwise("c").alias("operation"))
    source = source.withColumns({"price_range": price_range("price"), "valid_from": day(TODAY), "valid_to": day(None),
                                 "is_current": F.lit(True)})
    return merge.merge_into(
        target, source, ["id"], target_filter="is_current",
        matched=[merge.Update({"valid_to": day(TODAY), "is_current": F.lit(False)}, "src.operation = 'u'")],
        not_matched=[merge.Insert()])


@query(f"""WITH {sql.CHANGES},
           source AS (SELECT user_id, max(value) AS value, count(*) AS n FROM changes GROUP BY user_id)
           SELECT s.user_id, CASE WHEN n > 60 THEN s.value ELSE -1.0 END AS value FROM source s
           WHERE NOT (n <= 60 AND s.value < 150)""")
def merge_delete(spark, sf_dir):
    """MERGE with an update and a delete clause: the first clause whose condition holds is taken."""
    rows = cdc.accepted(parsed(spark, sf_dir))
    target = rows.select("user_id").distinct().withColumn("value", F.lit(-1.0))
    everything = inputs.changes(spark, sf_dir)
    source = everything.groupBy("user_id").agg(F.max("value").alias("value"), F.count(F.lit(1)).alias("n"))
    return merge.merge_into(target, source, KEY, matched=[
        merge.Update({"value": "src.value"}, "src.n > 60"), merge.Delete("src.value < 150")])


@query(f"WITH {LAST} SELECT user_id, value, event_type FROM last WHERE NOT deleted")
def upsert_latest(spark, sf_dir):
    """Two batches upserted one after the other, the second with late changes: the state is that of the whole log."""
    first, second = batches(spark, sf_dir)
    return merge.visible(merge.upsert(merge.upsert(None, first, KEY), second, KEY))


@query(f"""WITH {sql.ORDERS_RAW},
           ranked AS (SELECT *, row_number() OVER (
                        PARTITION BY user_id, product_id, date
                        ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, amount DESC, l_extendedprice DESC,
                                 discount DESC, l_shipdate DESC) AS rn FROM orders_raw)
           SELECT user_id, product_id, date, amount, discount, CAST(final_price AS DOUBLE) AS final_price, l_shipdate
           FROM ranked WHERE rn = 1""")
def upsert_composite(spark, sf_dir):
    """Order lines upserted by (user_id, product_id, date): the last line wins."""
    raw = inputs.orders_raw(spark, sf_dir)
    rows = raw.select("user_id", "product_id", "date", F.col("l_orderkey").alias("ts_ms"),
                      F.col("l_linenumber").cast("bigint").alias("lsn"), F.lit(False).alias("deleted"),
                      "l_suppkey", "amount", "l_extendedprice", "discount", "l_shipdate", "final_price")
    early = F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    keys = ["user_id", "product_id", "date"]
    state = merge.upsert(merge.upsert(None, rows.filter(early), keys), rows.filter(~early), keys)
    return doubles(merge.visible(state).drop("l_suppkey", "l_extendedprice"))


@query(HISTORY_SQL)
def scd2_history(spark, sf_dir):
    """Versions of the whole change log."""
    return scd2.visible(scd2.versions(changes(spark, sf_dir), KEY))


@query(HISTORY_SQL)
def scd2_late(spark, sf_dir):
    """The same history from two batches, the second with late changes, and the first then replayed."""
    first, second = batches(spark, sf_dir)
    history = None
    for batch in (first, second, first):
        history = committed(scd2.scd2(history, batch, KEY), "history")
    return scd2.visible(history)


@query(HISTORY_SQL)
def scd2_resent(spark, sf_dir):
    """The same history when the connector sends the whole log again a day later."""
    log = inputs.messages(spark, sf_dir).unionByName(inputs.messages(spark, sf_dir, delay_ms=86_400_000))
    resent = committed(cdc.accepted(cdc.parse(log, inputs.CHANGE_FIELDS, KEY)), "resent")
    return scd2.visible(scd2.versions(resent, KEY))


@query(f"""WITH {ROWS},
           steps AS (SELECT *, lag(deleted) OVER w AS was_deleted, lag(event_type) OVER w AS was FROM rows
                     WINDOW w AS (PARTITION BY user_id ORDER BY ts_ms, lsn)),
           kept AS (SELECT * FROM steps WHERE was_deleted IS NULL OR was_deleted <> deleted
                    OR was IS DISTINCT FROM event_type),
           versions AS (SELECT user_id, value, event_type, deleted, epoch_ms(ts_ms) AS valid_from,
                               epoch_ms(lead(ts_ms) OVER w) AS valid_to, lead(ts_ms) OVER w IS NULL AS is_current
                        FROM kept WINDOW w AS (PARTITION BY user_id ORDER BY ts_ms, lsn))
           SELECT * EXCLUDE (deleted) FROM versions WHERE NOT deleted""")
def scd2_tracked(spark, sf_dir):
    """Versions that differ in the event type; changes of the value alone open none."""
    return scd2.visible(scd2.versions(changes(spark, sf_dir), KEY, tracked=["event_type"]))


# Product history: per part and ship year one change, a delete where the year has a single line.
PRODUCT_CHANGES_SQL = """product_changes AS (
  SELECT l_partkey AS product_id, min(l_shipdate) AS valid_from, max(l_extendedprice) AS price, count(*) = 1 AS deleted
  FROM lineitem GROUP BY l_partkey, year(l_shipdate)),
product_history AS (
  SELECT *, lead(valid_from) OVER (PARTITION BY product_id ORDER BY valid_from) AS valid_to FROM product_changes)"""


def product_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = inputs.table(spark, sf_dir, "lineitem")
    rows = lines.groupBy(F.col("l_partkey").alias("id"), F.year("l_shipdate").alias("year")).agg(
        F.unix_millis(F.min("l_shipdate").cast("timestamp")).alias("ts_ms"), F.max("l_extendedprice").alias("price"),
        (F.count(F.lit(1)) == 1).alias("deleted"))
    rows = rows.drop("year").withColumn("lsn", F.lit(0).cast("bigint"))
    return scd2.visible(scd2.versions(rows, ["id"])).withColumn("price_range", price_range("price"))


@query(f"""WITH {sql.ORDERS}, {PRODUCT_CHANGES_SQL}
           SELECT s.user_id, s.product_id, s.date, s.amount, h.price AS product_price
           FROM sales s JOIN product_history h ON s.product_id = h.product_id AND NOT h.deleted
                AND s.date >= h.valid_from AND (h.valid_to IS NULL OR s.date < h.valid_to)""")
def orders_asof_product(spark, sf_dir):
    """Orders with the product version in force on their date."""
    orders = committed(silver_orders(spark, sf_dir).select("user_id", "product_id", "date", "amount"), "silver_orders")
    history = committed(product_history(spark, sf_dir), "product_history")  # read for its keys, too
    return gold.enrich_orders(orders, history, version="as_of", columns=["price"])


@query(f"""WITH {sql.ORDERS}, {PRODUCT_CHANGES_SQL}
           SELECT s.user_id, s.product_id, s.date, s.amount, h.price AS product_price
           FROM sales s JOIN product_history h ON s.product_id = h.product_id
           WHERE NOT h.deleted AND h.valid_to IS NULL""")
def orders_current_product(spark, sf_dir):
    """Orders with the current product version: one row per order, however many versions there are."""
    orders = committed(silver_orders(spark, sf_dir).select("user_id", "product_id", "date", "amount"), "silver_orders")
    return gold.enrich_orders(orders, product_history(spark, sf_dir), columns=["price"])


@query(f"""WITH {ROWS},
           a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms DESC, lsn DESC) AS rn
                 FROM rows WHERE coalesce(event_type NOT IN ('view', 'signup'), true)) WHERE rn = 1 AND NOT deleted),
           b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms DESC, lsn DESC) AS rn
                 FROM rows) WHERE rn = 1 AND NOT deleted)
           SELECT CASE WHEN a.user_id IS NULL THEN 'insert' WHEN b.user_id IS NULL THEN 'delete' ELSE 'update' END
                    AS change, coalesce(b.user_id, a.user_id) AS user_id,
                  CASE WHEN b.user_id IS NULL THEN a.value ELSE b.value END AS value,
                  CASE WHEN b.user_id IS NULL THEN a.event_type ELSE b.event_type END AS event_type
           FROM a FULL JOIN b ON a.user_id = b.user_id
           WHERE a.user_id IS NULL OR b.user_id IS NULL OR a.value IS DISTINCT FROM b.value
                 OR a.event_type IS DISTINCT FROM b.event_type""")
def serving_changes(spark, sf_dir):
    """What a second batch changes for readers of the state table."""
    first, second = batches(spark, sf_dir)
    before = merge.upsert(None, first, KEY)
    after = merge.upsert(before, second, KEY)
    return merge.changed_rows(merge.visible(before), merge.visible(after), KEY)
