"""Synthetic source rows, one per given id, reproducible from (id, seed) alone.

The generators map over a frame of ids, so Spark spreads them like any projection; `ids` makes such a frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions.bands import _col
from lakeloom.functions.draws import choice, digest, draw, uniform_int
from lakeloom.functions.money import discounted_cents

# Domains of the generated columns. Prices and discounts are in hundredths.
AMOUNT = (1, 20)
DISCOUNT_HUNDREDTHS = (0, 5000)
PRICE_CENTS = (500, 100000)
YEAR_SECONDS = 365 * 24 * 60 * 60
BIRTH_DAYS = (0, 36524)
FIRST_BIRTH = "1915-01-01"
PHONE_BASE = 10_000_000_000

FIRST_NAMES = ("Ada", "Ben", "Cleo", "Dan", "Eva", "Finn", "Gia", "Hugo", "Ines", "Jon", "Kim", "Lea", "Max", "Nora",
               "Omar", "Pia")
LAST_NAMES = ("Adler", "Berg", "Costa", "Dunn", "Ekman", "Fox", "Grant", "Hale", "Ivers", "Jones", "Klein", "Lund",
              "Moss", "North", "Owen", "Park")
ADJECTIVES = ("Compact", "Elegant", "Handmade", "Light", "Modern", "Rustic", "Smart", "Sturdy")
MATERIALS = ("Bamboo", "Cotton", "Glass", "Granite", "Leather", "Steel", "Wool", "Wooden")
THINGS = ("Bag", "Bench", "Chair", "Clock", "Lamp", "Mug", "Shelf", "Table")


def ids(spark: SparkSession, low: int, high: int) -> DataFrame:
    """Dense unique ids low..high."""
    return spark.range(low, high + 1)


def contact(rows: DataFrame, seed: int = 0) -> DataFrame:
    """Add phone and date_of_birth to rows that have an `id`."""
    bits = digest("id", "contact", seed)
    born = F.date_add(F.lit(FIRST_BIRTH).cast("date"), uniform_int(bits, 1, *BIRTH_DAYS).cast("int"))
    return rows.withColumns({
        "phone": F.concat(F.lit("+"), (F.lit(PHONE_BASE) + draw(bits, 0)).cast("string")),
        "date_of_birth": born.cast("timestamp_ntz"),
    })


def users(ids: DataFrame, seed: int = 0) -> DataFrame:
    bits = digest("id", "user", seed)
    named = ids.select(F.col("id").cast("bigint").alias("id"),
                       F.concat_ws(" ", choice(bits, 0, FIRST_NAMES), choice(bits, 1, LAST_NAMES)).alias("name"))
    return contact(named, seed)


def products(ids: DataFrame, seed: int = 0) -> DataFrame:
    bits = digest("id", "product", seed)
    return ids.select(
        F.col("id").cast("bigint").alias("id"),
        F.concat_ws(" ", choice(bits, 0, ADJECTIVES), choice(bits, 1, MATERIALS), choice(bits, 2, THINGS))
        .alias("name"),
        (uniform_int(bits, 3, *PRICE_CENTS) / 100.0).alias("price"),
    )


def orders(ids: DataFrame, users: int, products: int, until: str, seed: int = 0) -> DataFrame:
    """Orders of users 1..`users` for products 1..`products`, dated within the 365 days before `until`."""
    who = digest("id", "order", seed)
    what = digest("id", "line", seed)
    drawn = ids.select(
        uniform_int(who, 0, 1, users).alias("user_id"),
        uniform_int(who, 1, 1, products).alias("product_id"),
        uniform_int(what, 0, *AMOUNT).cast("int").alias("amount"),
        uniform_int(what, 1, *DISCOUNT_HUNDREDTHS).alias("percent"),
        uniform_int(what, 2, *PRICE_CENTS).alias("price_cents"),
        uniform_int(who, 2, 1, YEAR_SECONDS).alias("age"),
    )
    final_cents = discounted_cents(_col("price_cents"), _col("percent"))
    return drawn.select(
        "user_id", "product_id", "amount",
        (_col("percent") / 100.0).alias("discount"),
        (_col("price_cents") / 100.0).alias("price"),
        (final_cents / 100.0).alias("final_price"),
        (F.lit(until).cast("timestamp_ntz") - F.make_dt_interval(secs=_col("age").cast("decimal(18,6)"))).alias("date"),
    )
