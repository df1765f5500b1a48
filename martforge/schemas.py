"""Table schemas of the shop: staging (as delivered by change capture), and
the enumerations the shop uses.

Staging rows are the OLTP columns with booleans as small ints and times as
epoch milliseconds, plus the change-capture metadata columns.
"""

from __future__ import annotations

from pyspark.sql import types as T

from .fixed import (NAMESPACES, ORDER_STATUSES, PAYMENT_METHODS, PAYMENT_STATUSES,  # noqa: F401
                    SOURCE_DATABASE, STAGING_TABLES, TOPIC_PREFIX, VAT_RATES)

META_FIELDS = [
    T.StructField("__op", T.StringType()),
    T.StructField("__ts_ms", T.LongType()),
    T.StructField("__source_ts_ms", T.LongType()),
    T.StructField("__deleted", T.StringType()),
]


def _f(name, dtype, nullable=True):
    return T.StructField(name, dtype, nullable)


L, I, S, D, SH = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType(), T.ShortType()

ROW_FIELDS = {
    "admins": [_f("id", L), _f("email", S), _f("first_name", S), _f("last_name", S),
               _f("hashed_password", S), _f("is_active", SH), _f("created_at", L), _f("updated_at", L)],
    "customers": [_f("id", L), _f("email", S), _f("first_name", S), _f("last_name", S),
                  _f("hashed_password", S), _f("phone", S), _f("address", S), _f("is_active", SH),
                  _f("created_at", L), _f("updated_at", L)],
    "items": [_f("id", L), _f("title", S), _f("description", S), _f("image_url", S), _f("price_ht", D),
              _f("tva_rate", D), _f("price_ttc", D), _f("quantity", I), _f("created_at", L), _f("updated_at", L)],
    "orders": [_f("id", L), _f("customer_id", L), _f("status", S), _f("total_ht", D), _f("total_ttc", D),
               _f("created_at", L), _f("updated_at", L)],
    "order_items": [_f("id", L), _f("order_id", L), _f("item_id", L), _f("quantity", I),
                    _f("unit_price_ht", D), _f("unit_price_ttc", D)],
    "payments": [_f("id", L), _f("order_id", L), _f("amount", D), _f("status", S), _f("payment_method", S),
                 _f("transaction_id", S), _f("created_at", L), _f("updated_at", L)],
    "invoices": [_f("id", L), _f("order_id", L), _f("invoice_number", S), _f("issued_at", L),
                 _f("due_date", L), _f("total_ht", D), _f("total_tva", D), _f("total_ttc", D)],
}


def row_schema(table: str) -> T.StructType:
    """Schema of one OLTP row image (what ``before``/``after`` carry)."""
    return T.StructType(list(ROW_FIELDS[table]))


def staging_schema(table: str) -> T.StructType:
    """Schema of a staging table: row image + change metadata."""
    return T.StructType(list(ROW_FIELDS[table]) + list(META_FIELDS))


def envelope_schema(row: T.StructType) -> T.StructType:
    """Change event envelope: before/after images, op code and times."""
    return T.StructType([
        _f("before", row), _f("after", row), _f("op", S), _f("ts_ms", L),
        _f("source", T.StructType([_f("ts_ms", L), _f("db", S), _f("table", S)])),
    ])


def wire_schema(row: T.StructType) -> T.StructType:
    """JSON value with schema envelope: ``{"schema": ..., "payload": ...}``."""
    return T.StructType([_f("schema", S), _f("payload", envelope_schema(row))])
