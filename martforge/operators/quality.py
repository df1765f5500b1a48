"""Data-quality checks over the cleaned tables and display labels.

Every check returns violations as rows (check name + the offending key), so
results union into one report; all are single-pass aggregates or joins.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed import ORDER_STATUSES, PAYMENT_METHODS, PAYMENT_STATUSES, VAT_RATES
from ..functions import columns as col

# Our own simple e-mail shape check (local@domain.tld, no blanks).
EMAIL_SHAPE = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _checks(df: DataFrame, id_col: str | None, checks: list[tuple[str, object]]) -> DataFrame:
    """One pass over ``df``: every row emits one (check, id, value) entry per
    check, so a table is scanned once however many checks it has."""
    entries = F.array(*[F.struct(F.lit(name).alias("check"), F.col(c).cast("string").alias("value"),
                                 (F.coalesce(bad, F.lit(False)) if bad is not None else F.lit(True)).alias("bad"))
                        for name, (c, bad) in checks])
    ident = [F.col(id_col).alias("id")] if id_col else []
    keep = ["id"] if id_col else []
    return df.select(*ident, F.explode(entries).alias("e")).select(*keep, "e.check", "e.value", "e.bad")


UNIQUE = {  # table -> [(check name, column)]
    "customers": [("customers.email", "email")],
    "admins": [("admins.email", "email")],
    "invoices": [("invoices.invoice_number", "invoice_number"), ("invoices.order_id", "order_id")],
    "payments": [("payments.order_id", "order_id")],
    "order_items": [("order_items.order_item_id", "order_item_id")],
}


def dq_unique(tables: dict[str, DataFrame]) -> DataFrame:
    """Values that must be unique but repeat: (check, key, n). A unique column
    may hold several NULLs, so those aren't reported. One aggregation per
    column on its own type, combined map-side; only repeats become text."""
    return _union([
        tables[t].filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
        .select(F.lit(name).alias("check"), F.col(c).cast("string").alias("key"), "n")
        for t, specs in UNIQUE.items() for name, c in specs])


def dq_foreign_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows whose parent is missing: (check, id, parent_id)."""
    t = tables
    specs = [("orders.customer_id", t["orders"], "order_id", "customer_id", t["customers"], "customer_id"),
             ("order_items.order_id", t["order_items"], "order_item_id", "order_id", t["orders"], "order_id"),
             ("order_items.item_id", t["order_items"], "order_item_id", "item_id", t["items"], "item_id"),
             ("payments.order_id", t["payments"], "payment_id", "order_id", t["orders"], "order_id"),
             ("invoices.order_id", t["invoices"], "invoice_id", "order_id", t["orders"], "order_id")]
    return _union([
        child.select(F.col(cid).alias("id"), F.col(fk).alias("parent_id"))
        .join(parent.select(F.col(pk).alias("parent_id")), "parent_id", "left_anti")
        .select(F.lit(name).alias("check"), "id", "parent_id")
        for name, child, cid, fk, parent, pk in specs])


REQUIRED = {
    "admins": ("admin_id", "email", "first_name", "last_name"),
    "items": ("item_id", "title", "price_ht", "tva_rate", "price_ttc"),
    "orders": ("order_id", "customer_id", "status", "total_ht", "total_ttc"),
    "order_items": ("order_item_id", "order_id", "item_id", "quantity", "unit_price_ht", "unit_price_ttc"),
    "customers": ("customer_id", "email", "first_name", "last_name"),
    "payments": ("payment_id", "order_id", "amount"),
    "invoices": ("invoice_id", "order_id", "invoice_number", "total_ht", "total_tva", "total_ttc"),
}


def dq_not_null(tables: dict[str, DataFrame]) -> DataFrame:
    """NULL counts of required columns: (table, column, n_null), one scan per table."""
    parts = []
    for t, cols in REQUIRED.items():
        counts = tables[t].agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
        stacked = ", ".join(f"'{c}', `{c}`" for c in cols)
        parts.append(counts.select(F.lit(t).alias("table"),
                                   F.expr(f"stack({len(cols)}, {stacked}) AS (column, n_null)")))
    return _union(parts)


def dq_domains(tables: dict[str, DataFrame]) -> DataFrame:
    """Non-NULL values outside their domain: (check, id, value). (NULLs are
    reported by ``dq_not_null``.) One scan per table."""
    vat = [F.lit(v).cast("decimal(5,2)") for v in VAT_RATES]
    specs = {
        "orders": ("order_id", [("orders.status", ("status", ~F.lower("status").isin(*ORDER_STATUSES)))]),
        "payments": ("payment_id", [
            ("payments.payment_status", ("payment_status", ~F.lower("payment_status").isin(*PAYMENT_STATUSES))),
            ("payments.payment_method", ("payment_method", ~F.lower("payment_method").isin(*PAYMENT_METHODS)))]),
        "items": ("item_id", [("items.tva_rate", ("tva_rate", ~F.col("tva_rate").isin(*vat)))]),
        "customers": ("customer_id", [("customers.email", ("email", ~F.col("email").rlike(EMAIL_SHAPE)))]),
        "admins": ("admin_id", [("admins.email", ("email", ~F.col("email").rlike(EMAIL_SHAPE)))]),
    }
    return _union([_checks(tables[t], key, checks) for t, (key, checks) in specs.items()]).filter("bad").drop("bad")


def dq_reconcile(tables: dict[str, DataFrame]) -> DataFrame:
    """Totals that disagree: (check, order_id, expected, actual).

    payment amount vs order TTC; invoice HT/TTC vs order; invoice VAT vs
    TTC - HT; order TTC vs sum of line totals, within 0.01 per line (lines
    are cast after multiplying, order totals sum rounded lines; an order
    without lines should total 0). One join of each child table with the
    orders."""
    money = "decimal(22,2)"
    t = tables
    o = t["orders"].select("order_id", F.col("total_ht").alias("o_ht"), F.col("total_ttc").alias("o_ttc"))

    def pairs(df, checks):
        arr = F.array(*[F.struct(F.lit(n).alias("check"), e.cast(money).alias("expected"), a.cast(money).alias("actual"))
                        for n, e, a in checks])
        return (df.select("order_id", F.explode(arr).alias("p")).select("p.check", "order_id", "p.expected", "p.actual")
                .filter(~F.col("expected").eqNullSafe(F.col("actual"))))

    pay = pairs(t["payments"].join(o, "order_id"), [("payment.amount", F.col("o_ttc"), F.col("amount"))])
    inv = pairs(t["invoices"].join(o, "order_id"), [
        ("invoice.total_ht", F.col("o_ht"), F.col("total_ht")),
        ("invoice.total_ttc", F.col("o_ttc"), F.col("total_ttc")),
        ("invoice.total_tva", F.col("total_ttc") - F.col("total_ht"), F.col("total_tva"))])
    lines = t["order_items"].groupBy("order_id").agg(F.sum("line_total_ttc").alias("s"),
                                                     F.count(F.lit(1)).alias("n"))
    s, n = F.coalesce("s", F.lit(Decimal("0.00"))), F.coalesce("n", F.lit(0))
    tol = n.cast("decimal(20,0)") * F.lit(Decimal("0.01"))
    ln = o.join(lines, "order_id", "left").filter(F.abs(s - F.col("o_ttc")) > tol).select(
        F.lit("order.lines_ttc").alias("check"), "order_id", s.cast(money).alias("expected"),
        F.col("o_ttc").cast(money).alias("actual"))
    return _union([pay, inv, ln])


# --- labels -------------------------------------------------------------------

def payment_labels(payments: DataFrame) -> DataFrame:
    return payments.select(
        "payment_id", col.payment_method_label("payment_method").alias("method_label"),
        col.payment_status_label("payment_status").alias("status_label"),
        F.coalesce("transaction_id", F.lit(col.NO_TRANSACTION_LABEL)).alias("transaction_label"))


def order_status_labels(orders: DataFrame) -> DataFrame:
    return orders.select("order_id", "status", col.order_status_label("status").alias("status_label"))


def stock_levels(items: DataFrame) -> DataFrame:
    return items.select("item_id", "quantity", col.stock_level("quantity").alias("stock_level"),
                        F.col("tva_rate").cast("int").alias("tva_rate_shown"))
