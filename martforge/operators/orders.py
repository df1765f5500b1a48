"""Order processing as batch jobs: stock allocation, totals, payments, invoices.

``allocate_orders`` replaces the shop's per-request loop (read stock, allot
min(requested, left), decrement) by one set-based plan. For non-negative
stock the loop's cumulative allotment after n valid lines of an item equals
min(stock, demand of those lines), so each line's allotment is
``greatest(0, least(qty, stock - demand before it))`` -- a prefix sum per
item in arrival order, computed skew-safe by ``sequences.prior_sum``.
(The shop lets stock go negative; the loop would then allot negative
quantities, this plan allots 0.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sequences

from ..fixed import (INVOICE_DATE_FORMAT, INVOICE_DUE_DAYS, INVOICE_PREFIX, INVOICE_SUFFIX_HEX,
                     PAYMENT_COMPLETED_STORED, PAYMENT_METHODS_STORED, TXN_HEX, TXN_PREFIX)

TOTAL = "decimal(20,2)"  # order-level money (sums of lines)


def allocate_orders(requests: DataFrame, items: DataFrame, width: int = sequences.DEFAULT_WIDTH) -> DataFrame:
    """Order lines for requests (request_id, customer_id, item_id, quantity,
    arrival[, line_no]) served in (arrival, request_id, line_no) order.

    Unknown items and quantities <= 0 are skipped; every other line is
    written, with ``quantity`` = allotted units (possibly 0) and subtotals
    round(unit price x allotted, 2)."""
    if "line_no" not in requests.columns:
        requests = requests.withColumn("line_no", F.lit(0))
    # demand before each line, per item; lines of unknown items only ever
    # count towards their own (unknown) item, so the join can come after
    demand = sequences.prior_sum(requests.filter(F.col("quantity") > 0), ["item_id"],
                                 ["arrival", "request_id", "line_no"], "quantity", out="prior", width=width)
    with_prior = demand.join(items.select("item_id", F.col("quantity").alias("stock"), "price_ht", "price_ttc"),
                             "item_id")
    allotted = F.greatest(F.lit(0), F.least(F.col("quantity"), F.col("stock") - F.col("prior"))).cast("int")
    return with_prior.select(
        "request_id", "customer_id", "item_id", "line_no", F.col("quantity").alias("requested"),
        allotted.alias("quantity"), F.col("price_ht").alias("unit_price_ht"),
        F.col("price_ttc").alias("unit_price_ttc"),
        F.round(F.col("price_ht") * allotted, 2).cast(TOTAL).alias("subtotal_ht"),
        F.round(F.col("price_ttc") * allotted, 2).cast(TOTAL).alias("subtotal_ttc"))


def order_totals(requests: DataFrame, lines: DataFrame) -> DataFrame:
    """One order per request: totals = round(sum of line subtotals, 2);
    a request without a valid line still makes an order with zero totals."""
    heads = requests.groupBy("request_id").agg(F.min("customer_id").alias("customer_id"))
    sums = lines.groupBy("request_id").agg(F.sum("subtotal_ht").alias("s_ht"), F.sum("subtotal_ttc").alias("s_ttc"))
    return heads.join(sums, "request_id", "left").select(
        F.col("request_id").alias("order_id"), "customer_id",
        F.round(F.coalesce("s_ht", F.lit(0)), 2).cast(TOTAL).alias("total_ht"),
        F.round(F.coalesce("s_ttc", F.lit(0)), 2).cast(TOTAL).alias("total_ttc"))


def stock_after_orders(items: DataFrame, lines: DataFrame) -> DataFrame:
    """Remaining stock per item after the allotments (items without lines unchanged)."""
    taken = lines.groupBy("item_id").agg(F.sum("quantity").alias("taken"))
    return items.select("item_id", "quantity").join(taken, "item_id", "left").select(
        "item_id", F.col("quantity").alias("stock_before"),
        F.coalesce("taken", F.lit(0).cast("bigint")).alias("taken"),
        (F.col("quantity") - F.coalesce("taken", F.lit(0))).alias("stock_after"))


def _hex_of(key: Column) -> Column:
    return F.upper(F.sha2(key.cast("string"), 256))


def derive_payments(orders: DataFrame) -> DataFrame:
    """One completed payment per order for its TTC total. The shop picks the
    method and transaction id at random; here both derive from a hash of the
    order id, so reruns agree."""
    h = _hex_of(F.col("order_id"))
    pick = F.conv(F.substring(h, TXN_HEX + 1, 8), 16, 10).cast("bigint") % 3
    method = F.element_at(F.array(*[F.lit(m) for m in PAYMENT_METHODS_STORED]), (pick + 1).cast("int"))
    return orders.select(
        "order_id", F.col("total_ttc").alias("amount"), F.lit(PAYMENT_COMPLETED_STORED).alias("status"),
        method.alias("payment_method"),
        F.concat(F.lit(TXN_PREFIX), F.substring(h, 1, TXN_HEX)).alias("transaction_id"))


def derive_invoices(orders: DataFrame, issued_at=None) -> DataFrame:
    """One invoice per order: number INV-yyyyMMdd-<hex>, issued now (or
    ``issued_at``), due 30 days later, VAT = round(TTC - HT, 2).

    The suffix is the order id itself in hex, at least INVOICE_SUFFIX_HEX
    digits (the shop's format draws that many at random): different orders
    never share a number."""
    issued = F.current_timestamp() if issued_at is None else F.lit(str(issued_at)).cast("timestamp")
    digits = F.hex(F.col("order_id").cast("long"))
    suffix = F.when(F.length(digits) < INVOICE_SUFFIX_HEX, F.lpad(digits, INVOICE_SUFFIX_HEX, "0")).otherwise(digits)
    return orders.select(
        "order_id",
        F.concat(F.lit(INVOICE_PREFIX), F.date_format(issued, INVOICE_DATE_FORMAT), F.lit("-"),
                 suffix).alias("invoice_number"),
        issued.alias("issued_at"),
        (issued + F.expr(f"INTERVAL {INVOICE_DUE_DAYS} DAYS")).alias("due_date"),
        "total_ht", F.round(F.col("total_ttc") - F.col("total_ht"), 2).cast(TOTAL).alias("total_tva"), "total_ttc")
