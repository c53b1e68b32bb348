"""SQL fragments shared by the checks: the source tables of `inputs`, written a second time in plain SQL."""

SHARE = "CAST(l_discount AS DECIMAL(4,2))"
PRICE = "CAST(p_retailprice AS DECIMAL(12,2))"
LINE_ORDER = "l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_shipdate"

ORDERS_RAW = f"""orders_raw AS (
  SELECT o_custkey AS user_id, l_partkey AS product_id, CAST(l_quantity AS INTEGER) AS amount,
         CAST({SHARE} * 100 AS INTEGER) AS discount, {PRICE} AS price,
         CAST(ROUND({PRICE} * (1 - {SHARE}), 2) AS DECIMAL(12,2)) AS final_price, o_orderdate AS date,
         CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, l_returnflag, {LINE_ORDER}
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

ORDERS = f"""{ORDERS_RAW},
sales AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, product_id, date ORDER BY {LINE_ORDER}) AS rn FROM orders_raw)
  WHERE rn = 1)"""

SUMMARY = f"""{ORDERS},
summary AS (
  SELECT year, month, product_id, p_name AS product_name, CAST(sum(amount) AS BIGINT) AS total_sale,
         CAST(sum(amount * price) AS DOUBLE) AS total_revenue_before_discount,
         CAST(sum(amount * final_price) AS DOUBLE) AS total_revenue_after_discount,
         CAST((2 * CAST(sum(discount * 100) AS BIGINT) + count(*)) // (2 * count(*)) AS DOUBLE) / 100
           AS average_discount,
         count(user_id) AS total_orders
  FROM sales JOIN part ON product_id = p_partkey
  GROUP BY year, month, product_id, p_name)"""

LIFETIME = f"""{ORDERS},
spend AS (
  SELECT user_id, c_name AS user_name, sum(amount * final_price) AS spent, count(user_id) AS total_orders,
         CAST(sum(amount * final_price * 100) AS BIGINT) AS spent_cents,
         CAST(min(date) AS DATE) AS first_order_date, CAST(max(date) AS DATE) AS last_order_date
  FROM sales JOIN customer ON user_id = c_custkey
  GROUP BY user_id, c_name)"""


def segment(column: str, scale: int = 1) -> str:
    return (f"CASE WHEN {column} > {50000 * scale} THEN 'Excellent buyer' WHEN {column} > {25000 * scale} THEN 'Good buyer' "
            f"WHEN {column} > {10000 * scale} THEN 'Average buyer' WHEN {column} > {5000 * scale} THEN 'Occasional buyer' "
            "ELSE 'Passing buyer' END")


def band(column: str, edges: list[int]) -> str:
    cases = " ".join(
        f"WHEN {column} >= {low} AND {column} {'<=' if high == edges[-1] else '<'} {high} THEN '{low}-{high}'"
        for low, high in zip(edges, edges[1:]))
    return f"CASE {cases} ELSE 'out_of_range' END"


PRICE_EDGES = [5, 105, 205, 305, 405, 505, 605, 705, 805, 905, 1000]


def decade(column: str) -> str:
    return f"CAST(floor(year({column}) / 10) * 10 AS INTEGER)"


def draw(key: str, stream: str, part: int, seed: int = 0) -> str:
    """The generator's draw: 32 bits of an MD5 digest."""
    return f"CAST('0x' || substr(md5(concat_ws(':', {key}, '{stream}', '{seed}')), {1 + 8 * part}, 8) AS BIGINT)"


USERS = f"""users AS (
  SELECT c_custkey AS id, c_name AS name, '+' || CAST(10000000000 + {draw('c_custkey', 'contact', 0)} AS VARCHAR) AS phone,
         CAST(DATE '1915-01-01' + CAST({draw('c_custkey', 'contact', 1)} % 36525 AS INTEGER) AS TIMESTAMP)
           AS date_of_birth
  FROM customer)"""

CHANGES = """changes AS (
  SELECT CASE WHEN event_type = 'error' THEN 'd'
              WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 THEN 'c' ELSE 'u' END AS op,
         user_id, value, event_type, epoch_us(ts) // 1000 AS ts_ms, event_id AS lsn
  FROM events)"""
