"""Shop reads, re-aimed as set-based operators over all customers / carts.

The shop answers one customer or cart per request with several round trips
(and N+1 item look-ups); here each read is one plan for everybody. Where a
read is ordered ("newest first"), the order is a global ``orderBy`` on
(customer, time): a range-partitioned sort whose bounds split even a hot
customer over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixed import CONFIRMED, DELETED_ITEM_LABEL, REORDER_TOP_K
from ..functions import cart as cartf
from ..functions.columns import dmy, eur, order_status_label, short_title, ttc_from_ht_exact

TOTAL = "decimal(20,2)"  # money of a line or a cart


def _confirmed(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("status") == CONFIRMED)


def with_lines(head: DataFrame, lines: DataFrame, key: str = "order_id") -> DataFrame:
    """``head LEFT JOIN lines``, as the inner join plus the heads without any
    line: AQE splits a hot order's lines in an inner join of two shuffles (an
    outer join can't be split on its outer side's partner), and the anti
    join's distinct keys collapse map-side."""
    bare = head.join(lines.select(key).distinct(), key, "left_anti")
    return lines.join(head, key).unionByName(bare, allowMissingColumns=True)


def catalog_in_stock(items: DataFrame) -> DataFrame:
    """Items with stock > 0, newest id first."""
    return items.filter(F.col("quantity") > 0).orderBy(F.desc("item_id"))


def items_by_newest(items: DataFrame) -> DataFrame:
    """All items, newest id first (admin list)."""
    return items.orderBy(F.desc("item_id"))


def purchased_pairs(order_items: DataFrame, orders: DataFrame) -> DataFrame:
    """Distinct (customer_id, item_id) of confirmed orders. Lines are reduced
    to distinct (order, item) first, so a hot order collapses map-side."""
    return (order_items.select("order_id", "item_id").distinct()
            .join(_confirmed(orders).select("order_id", "customer_id"), "order_id")
            .select("customer_id", "item_id").distinct())


def reorder_suggestions(order_items: DataFrame, orders: DataFrame, items: DataFrame,
                        k: int = REORDER_TOP_K) -> DataFrame:
    """Per customer: items bought in confirmed orders, still in stock, top k by id desc.

    ``row_number() <= k`` is planned with a partial WindowGroupLimit before the
    shuffle, so each map task forwards at most k rows per customer.
    """
    in_stock = items.filter(F.col("quantity") > 0).select("item_id", "title", "price_ttc", "quantity")
    cand = purchased_pairs(order_items, orders).join(in_stock, "item_id")
    rank = F.row_number().over(Window.partitionBy("customer_id").orderBy(F.desc("item_id")))
    return cand.withColumn("rank", rank).filter(F.col("rank") <= k)


def purchased_in_stock(items: DataFrame, order_items: DataFrame, orders: DataFrame) -> DataFrame:
    """In-stock catalog items bought at least once in a confirmed order (semi join).
    Items are made distinct before that join, map side first: a hot item is one row there."""
    bought = (order_items.select("order_id", "item_id").distinct()
              .join(_confirmed(orders).select("order_id"), "order_id").select("item_id").distinct())
    return items.filter(F.col("quantity") > 0).join(bought, "item_id", "left_semi")


def order_history(orders: DataFrame, order_items: DataFrame, items: DataFrame) -> DataFrame:
    """Every order with its lines (flat: one row per line; orders without
    lines keep one row with empty line fields), item title or the deleted-item
    label, line total = unit TTC x quantity, newest first per customer.

    Flat rather than nested: one order's lines are never gathered into one
    value, so an order with millions of lines cannot overflow a row."""
    lines = order_items.select("order_id", "order_item_id", "item_id", "quantity", "unit_price_ttc")
    head = orders.select("order_id", "customer_id", "status", "total_ttc", "source_updated_at")
    return (with_lines(head, lines).join(items.select("item_id", "title"), "item_id", "left")
            .select("customer_id", "order_id", order_status_label("status").alias("status_label"),
                    "total_ttc", F.col("source_updated_at").alias("ordered_at"), "order_item_id", "item_id",
                    F.when(F.col("order_item_id").isNotNull(),
                           F.coalesce("title", F.lit(DELETED_ITEM_LABEL))).alias("title"),
                    "quantity", "unit_price_ttc",
                    (F.col("unit_price_ttc") * F.col("quantity")).cast(TOTAL).alias("line_total_ttc"))
            .orderBy("customer_id", F.desc("ordered_at"), F.desc("order_id"), "order_item_id"))


def customer_payments(payments: DataFrame, orders: DataFrame) -> DataFrame:
    """Payments with the owning customer, newest first per customer."""
    return (payments.join(orders.select("order_id", "customer_id"), "order_id")
            .orderBy("customer_id", F.desc("source_updated_at"), F.desc("payment_id")))


def customer_invoices(invoices: DataFrame, orders: DataFrame) -> DataFrame:
    """Invoices with the owning customer, newest issue first per customer."""
    return (invoices.join(orders.select("order_id", "customer_id"), "order_id")
            .orderBy("customer_id", F.desc("issued_at"), F.desc("invoice_id")))


def invoice_lines(invoices: DataFrame, orders: DataFrame, order_items: DataFrame, items: DataFrame) -> DataFrame:
    """Document rows of every invoice: short title, quantity, unit prices and
    line TTC as 'x.xx EUR', issue and due dates as dd/MM/yyyy ('-' if none).
    Invoices without lines keep one header row."""
    head = invoices.join(orders.select("order_id", "customer_id"), "order_id").select(
        "invoice_id", "invoice_number", "order_id", "customer_id",
        dmy("issued_at").alias("issued_on"), dmy("due_date").alias("due_on"),
        eur("total_ht").alias("total_ht_text"), eur("total_tva").alias("total_tva_text"),
        eur("total_ttc").alias("total_ttc_text"))
    lines = order_items.select("order_id", "order_item_id", "item_id", "quantity", "unit_price_ht",
                               "unit_price_ttc")
    line_ttc = F.round(F.col("unit_price_ttc") * F.col("quantity"), 2).cast(TOTAL)
    return (with_lines(head, lines).join(items.select("item_id", "title"), "item_id", "left")
            .select("invoice_id", "invoice_number", "customer_id", "issued_on", "due_on", "total_ht_text",
                    "total_tva_text", "total_ttc_text", "order_item_id",
                    F.when(F.col("order_item_id").isNotNull(), short_title("title")).alias("title"),
                    "quantity", eur("unit_price_ht").alias("unit_ht_text"),
                    eur("unit_price_ttc").alias("unit_ttc_text"), line_ttc.alias("line_ttc"),
                    eur(line_ttc).alias("line_ttc_text")))


def order_confirmation(requests: DataFrame, orders: DataFrame, order_items: DataFrame,
                       items: DataFrame) -> DataFrame:
    """Confirmation pages for (order_id, customer_id) requests: only the
    owner's requests match; lines carry round(unit TTC x quantity, 2)."""
    owned = requests.select("order_id", "customer_id").join(
        orders.select("order_id", "customer_id", "status", "total_ht", "total_ttc"),
        ["order_id", "customer_id"])
    lines = order_items.select("order_id", "order_item_id", "item_id", "quantity", "unit_price_ttc")
    return (with_lines(owned, lines).join(items.select("item_id", "title"), "item_id", "left")
            .select("order_id", "customer_id", "status", "total_ht", "total_ttc", "order_item_id", "item_id",
                    "title", "quantity",
                    F.round(F.col("unit_price_ttc") * F.col("quantity"), 2).cast(TOTAL).alias("subtotal_ttc")))


def item_pricing(items: DataFrame) -> DataFrame:
    """Price incl. VAT recomputed from HT and rate, in exact decimals."""
    return items.select("id", "price_ht", "tva_rate",
                        ttc_from_ht_exact("price_ht", "tva_rate").cast("decimal(10,2)").alias("price_ttc"))


# --- carts -----------------------------------------------------------------

def cart_parse(carts: DataFrame, raw: str = "raw") -> DataFrame:
    """(cart_id, item_key, item_id, quantity) per entry of each well-formed cart."""
    return carts.select("cart_id", F.explode(cartf.cart_entries(F.col(raw))).alias("e")).select(
        "cart_id", "e.item_key", "e.item_id", "e.quantity")


def cart_count(carts: DataFrame, raw: str = "raw") -> DataFrame:
    """(cart_id, cart_count): total quantity, 0 when malformed."""
    return carts.select("cart_id", cartf.cart_count(F.col(raw)).alias("cart_count"))


def cart_count_raw(carts: DataFrame, raw: str = "raw") -> DataFrame:
    """(cart_id, cart_count): the catalogue badge, summing raw JSON values."""
    return carts.select("cart_id", cartf.cart_count_raw(F.col(raw)).alias("cart_count"))


def priced_cart_lines(carts: DataFrame, items: DataFrame, raw: str = "raw") -> DataFrame:
    """Entries with a known item and quantity > 0, with HT/TTC subtotals."""
    return (cart_parse(carts, raw).filter(F.col("quantity") > 0)
            .join(items.select("item_id", "price_ht", "price_ttc"), "item_id")
            .select("cart_id", "item_id", "quantity",
                    F.round(F.col("price_ht") * F.col("quantity"), 2).cast(TOTAL).alias("subtotal_ht"),
                    F.round(F.col("price_ttc") * F.col("quantity"), 2).cast(TOTAL).alias("subtotal_ttc")))


def cart_pricing(carts: DataFrame, items: DataFrame, raw: str = "raw") -> DataFrame:
    """Per cart: priced lines and the TTC total (0 for an empty cart)."""
    totals = priced_cart_lines(carts, items, raw).groupBy("cart_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("subtotal_ttc").alias("s_ttc"))
    return carts.select("cart_id").join(totals, "cart_id", "left").select(
        "cart_id", F.coalesce("n_lines", F.lit(0).cast("bigint")).alias("n_lines"),
        F.round(F.coalesce("s_ttc", F.lit(0)), 2).cast(TOTAL).alias("total_ttc"))


def checkout_summary(carts: DataFrame, items: DataFrame, raw: str = "raw") -> DataFrame:
    """Per cart: HT and TTC totals of the priced lines, rounded once more."""
    totals = priced_cart_lines(carts, items, raw).groupBy("cart_id").agg(
        F.sum("subtotal_ht").alias("s_ht"), F.sum("subtotal_ttc").alias("s_ttc"))
    return carts.select("cart_id").join(totals, "cart_id", "left").select(
        "cart_id", F.round(F.coalesce("s_ht", F.lit(0)), 2).cast(TOTAL).alias("total_ht"),
        F.round(F.coalesce("s_ttc", F.lit(0)), 2).cast(TOTAL).alias("total_ttc"))
