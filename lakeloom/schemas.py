"""Schemas of the layers and of the serving tables, projection onto them, and column defaults."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Ids are 64-bit in the lake: a table of 100 TB has more rows than 32 bits can number.
USERS = {"id": "bigint", "name": "string", "phone": "string", "date_of_birth": "timestamp_ntz"}
PRODUCTS = {"id": "bigint", "name": "string", "price": "double"}
ORDERS = {
    "user_id": "bigint", "product_id": "bigint", "amount": "int", "discount": "double",
    "price": "double", "final_price": "double", "date": "timestamp_ntz",
}

BRONZE_USERS = {**USERS, "birth_decade": "int"}
BRONZE_PRODUCTS = {**PRODUCTS, "price_range": "string"}
BRONZE_ORDERS = {**ORDERS, "year": "int", "month": "int"}

SILVER_USERS = {**BRONZE_USERS, "created_at": "date", "partition_key": "int"}
SILVER_PRODUCTS = {
    **BRONZE_PRODUCTS, "valid_from": "date", "valid_to": "date", "is_current": "boolean", "partition_key": "int",
}
SILVER_ORDERS = BRONZE_ORDERS

# Column types and defaults of the serving tables, and the keys they are sorted by. Narrow floats and ids
# are those of the serving store; `wide` keeps doubles and 64-bit ids instead.
SERVING_USERS = {
    "id": "int", "name": "string", "phone": "string", "date_of_birth": "timestamp_ntz", "birth_decade": "int",
    "created_at": "date",
}
SERVING_PRODUCTS = {
    "id": "int", "name": "string", "price": "float", "price_range": "string", "valid_from": "date",
    "valid_to": "date", "is_current": "boolean",
}
SERVING_ORDERS = {
    "user_id": "int", "product_id": "int", "amount": "int", "discount": "float", "price": "float",
    "final_price": "float", "date": "timestamp_ntz", "year": "int", "month": "int",
}
SERVING_DEFAULTS = {"discount": 0}
SERVING_KEYS = {"users": ["id"], "products": ["id"], "orders": ["user_id", "product_id", "date"]}

# Keys and required columns of the source tables.
SOURCE_KEYS = SERVING_KEYS
REQUIRED = {
    "users": ["id", "name", "phone", "date_of_birth"],
    "products": ["id", "name", "price"],
    "orders": ["user_id", "product_id", "amount", "price", "final_price", "date"],
}


def ddl(fields: Mapping[str, str]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in fields.items())


def wide(fields: Mapping[str, str]) -> dict[str, str]:
    """The same fields with floats widened to doubles, so that money keeps its digits, and ids to 64 bits."""
    widened = {"float": "double"}
    return {name: "bigint" if name == "id" or name.endswith("_id") else widened.get(kind, kind)
            for name, kind in fields.items()}


def apply_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Replace nulls of the named columns by their default, keeping the column type."""
    kinds = {field.name: field.dataType for field in df.schema.fields}
    return df.withColumns({
        name: F.coalesce(F.col(name), F.lit(value).cast(kinds[name])) for name, value in defaults.items()
    })


def project(df: DataFrame, fields: Mapping[str, str], rename: Mapping[str, str] | None = None,
            defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Exactly the columns of `fields`, in order and cast to their types.

    `rename` maps a target column to its source column; a source column that is absent becomes a typed null.
    """
    rename = rename or {}
    present = set(df.columns)
    columns = []
    for name, kind in fields.items():
        source = rename.get(name, name)
        column = F.col(source) if source in present else F.lit(None)
        columns.append(column.cast(kind).alias(name))
    projected = df.select(*columns)
    return apply_defaults(projected, {k: v for k, v in (defaults or {}).items() if k in fields})
