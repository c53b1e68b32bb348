"""Change messages: parsing, classification, ordering.

A message is the JSON object {before, after, source: {ts_ms, lsn}, op, ts_ms}. A change is ordered by (ts_ms, lsn) of its
source, never by arrival: a stream gives no order across batches. The outer ts_ms, when the connector wrote the message,
counts only where the source states no time, so a change that is sent again later is the same change.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.dedupe import keep_last

# Operation codes of the messages (create, update, snapshot read; delete).
UPSERT_OPS = ("c", "u", "r")
DELETE_OP = "d"

SEQUENCE = ["ts_ms", "lsn"]
ACCEPTED = ("upsert", "delete")

# How a temporal field is written in a message, and the JSON type it arrives as.
WIRE_TYPES = {"iso": "string", "micros": "bigint", "millis": "bigint", "days": "int"}


def _decode(field: Column, encoding: str | None, kind: str) -> Column:
    if encoding is None:
        return field.cast(kind)
    if encoding == "iso":
        return field.try_cast(kind)
    if encoding == "micros":
        return F.timestamp_micros(field).cast(kind)
    if encoding == "millis":
        return F.timestamp_millis(field).cast(kind)
    return F.date_add(F.lit("1970-01-01").cast("date"), field).cast(kind)


def parse(df: DataFrame, fields: Mapping[str, str], keys: list[str],
          encodings: Mapping[str, str] | None = None, value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Message text or bytes in column `value` to: kind, op, ts_ms, lsn, deleted, the row's fields, and raw.

    kind is 'upsert' or 'delete' for a usable change, else the reason it is not one: 'empty' (no message), 'malformed'
    (not JSON, or a field of a wrong type), 'unknown' (other op), 'incomplete' (no row image, null key or no time).
    The fields come from `after`, or from `before` for a delete. raw keeps the text of unusable messages.
    `keep` carries other columns of `df` along. `encodings` says how temporal fields are written (see `WIRE_TYPES`); without one they would be misread silently.
    """
    encodings = encodings or {}
    wire = ", ".join(f"`{name}`: {WIRE_TYPES[encodings[name]] if name in encodings else kind}"
                     for name, kind in fields.items())
    message = (f"before struct<{wire}>, after struct<{wire}>, source struct<ts_ms: string, lsn: bigint>, op string, "
               "ts_ms string, _damaged string")
    sent = F.coalesce(*[F.col(f"_m.{name}").try_cast("bigint") for name in ("source.ts_ms", "ts_ms")])
    text = F.col(value).cast("string")
    # Exploding a one-element array keeps the optimizer from moving filters on the fields below the parser, where each
    # field they use would parse the message once more.
    parsed = df.select(*keep, text.alias("_text"), F.explode(F.array(
        F.from_json(text, message, {"columnNameOfCorruptRecord": "_damaged"}))).alias("_m"))
    image = F.when(F.col("_m.op") == DELETE_OP, F.col("_m.before")).otherwise(F.col("_m.after"))
    flat = parsed.select(
        *keep, "_text", F.col("_m.op").alias("op"), sent.alias("ts_ms"),
        F.coalesce(F.col("_m.source.lsn"), F.lit(0)).alias("lsn"),
        (F.col("_m").isNull() | F.col("_m._damaged").isNotNull()).alias("_bad"), image.alias("_row"))
    flat = flat.select(*keep, "_text", "op", "ts_ms", "lsn", "_bad", *[
        _decode(F.col(f"_row.{name}"), encodings.get(name), kind).alias(name) for name, kind in fields.items()])
    kind = classify(keys)
    usable = kind.isin(*ACCEPTED)
    return flat.select(*keep, kind.alias("kind"), "op", "ts_ms", "lsn", (F.col("op") == DELETE_OP).alias("deleted"), *fields,
                       F.when(~usable, F.col("_text")).alias("raw"))


def classify(keys: list[str]) -> Column:
    known = F.col("op").isin(*UPSERT_OPS, DELETE_OP)
    whole = F.col("ts_ms").isNotNull()
    for key in keys:
        whole = whole & F.col(key).isNotNull()
    return (F.when(F.col("_text").isNull(), "empty")
            .when(F.col("_bad"), "malformed")
            .when(F.coalesce(~known, F.lit(True)), "unknown")
            .when(~whole, "incomplete")
            .when(F.col("op") == DELETE_OP, "delete")
            .otherwise("upsert"))


def accepted(parsed: DataFrame) -> DataFrame:
    """Usable changes only, as state rows: fields, ts_ms, lsn, deleted."""
    return parsed.filter(F.col("kind").isin(*ACCEPTED)).drop("kind", "op", "raw")


def latest(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The last change of each key. Changes with the same sequence are told apart by content, so that the result never
    depends on arrival; a delete wins over an upsert of the same sequence."""
    rest = [name for name in changes.columns if name not in (*keys, *SEQUENCE, "deleted")]
    return keep_last(changes, keys, [*SEQUENCE, "deleted", *rest])
