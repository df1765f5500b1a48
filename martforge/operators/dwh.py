"""Cleaned layer: one projection + live-row filter + casts per staging table.

Every load is narrow (no shuffle): filter and projection are pushed into the
Parquet scan, so a load reads only the columns it keeps. ``hashed_password``,
``created_at`` and ``updated_at`` are dropped on purpose: the cleaned layer is
also a column-level privacy boundary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import MONEY, RATE, epoch_ms_to_ts, live_row, small_int_bool


def _live(staging: DataFrame) -> DataFrame:
    return staging.filter(live_row())


def load_admins(staging: DataFrame) -> DataFrame:
    return _live(staging).select(
        F.col("id").alias("admin_id"), "email", "first_name", "last_name",
        small_int_bool("is_active").alias("is_active"),
        epoch_ms_to_ts("__source_ts_ms").alias("source_updated_at"))


def load_customers(staging: DataFrame) -> DataFrame:
    return _live(staging).select(
        F.col("id").alias("customer_id"), "email", "first_name", "last_name", "phone", "address",
        small_int_bool("is_active").alias("is_active"),
        epoch_ms_to_ts("__source_ts_ms").alias("source_updated_at"))


def load_items(staging: DataFrame) -> DataFrame:
    return _live(staging).select(
        F.col("id").alias("item_id"), "title", "description", "image_url",
        F.col("price_ht").cast(MONEY).alias("price_ht"),
        F.col("tva_rate").cast(RATE).alias("tva_rate"),
        F.col("price_ttc").cast(MONEY).alias("price_ttc"),
        F.col("quantity").cast("int").alias("quantity"),
        epoch_ms_to_ts("__source_ts_ms").alias("source_updated_at"))


def load_orders(staging: DataFrame, *also: str) -> DataFrame:
    return _live(staging).select(
        F.col("id").alias("order_id"), "customer_id",
        F.lower("status").alias("status"),
        F.col("total_ht").cast(MONEY).alias("total_ht"),
        F.col("total_ttc").cast(MONEY).alias("total_ttc"),
        epoch_ms_to_ts("__source_ts_ms").alias("source_updated_at"), *also)


def load_order_items(staging: DataFrame, *also: str) -> DataFrame:
    """Line totals multiply the raw columns first, then cast (no source time kept)."""
    return _live(staging).select(
        F.col("id").alias("order_item_id"), "order_id", "item_id",
        F.col("quantity").cast("int").alias("quantity"),
        F.col("unit_price_ht").cast(MONEY).alias("unit_price_ht"),
        F.col("unit_price_ttc").cast(MONEY).alias("unit_price_ttc"),
        (F.col("quantity") * F.col("unit_price_ht")).cast(MONEY).alias("line_total_ht"),
        (F.col("quantity") * F.col("unit_price_ttc")).cast(MONEY).alias("line_total_ttc"), *also)


def load_payments(staging: DataFrame) -> DataFrame:
    """Status is renamed but not lowercased (it reaches the marts in capitals)."""
    return _live(staging).select(
        F.col("id").alias("payment_id"), "order_id",
        F.col("amount").cast(MONEY).alias("amount"),
        F.col("status").alias("payment_status"), "payment_method", "transaction_id",
        epoch_ms_to_ts("__source_ts_ms").alias("source_updated_at"))


def load_invoices(staging: DataFrame) -> DataFrame:
    return _live(staging).select(
        F.col("id").alias("invoice_id"), "order_id", "invoice_number",
        epoch_ms_to_ts("issued_at").alias("issued_at"),
        epoch_ms_to_ts("due_date").alias("due_date"),
        F.col("total_ht").cast(MONEY).alias("total_ht"),
        F.col("total_tva").cast(MONEY).alias("total_tva"),
        F.col("total_ttc").cast(MONEY).alias("total_ttc"),
        epoch_ms_to_ts("__source_ts_ms").alias("source_updated_at"))


LOADS = {
    "admins": load_admins, "customers": load_customers, "items": load_items, "orders": load_orders,
    "order_items": load_order_items, "payments": load_payments, "invoices": load_invoices,
}
