"""Analytic marts, rebuilt in full from the cleaned layer.

Scale notes (per mart):

* Aggregations are written so that Spark can combine map-side: lines are
  summed per order (or per item / customer) *before* the join that widens
  them, so a hot key (one order, item or customer holding a third of all
  rows) collapses to one row per map task instead of one huge join group.
* ``count_distinct`` is planned by Spark as a two-level aggregate keyed on
  (group, order_id); the second key spreads a hot group over many tasks.
* No ORDER BY on stored marts: a table has no order, and a global sort of a
  100 TB mart is a range shuffle with nothing to show for it.
* The only un-partitioned step is the running revenue total, which runs on
  one row per day (bounded by the calendar, not the data).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixed import CONFIRMED, DUE_ON_TIME, DUE_OVERDUE, SEGMENTS


def _confirmed(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("status") == F.lit(CONFIRMED))


def sales_daily(orders: DataFrame, order_items: DataFrame) -> DataFrame:
    """Per day of the order's last change: distinct confirmed orders, units,
    revenue HT/TTC, and the running TTC total over days."""
    per_order = order_items.groupBy("order_id").agg(
        F.sum("quantity").alias("units"),
        F.sum("line_total_ht").alias("ht"),
        F.sum("line_total_ttc").alias("ttc"))
    days = _confirmed(orders).select("order_id", F.to_date("source_updated_at").alias("order_date"))
    daily = days.join(per_order, "order_id").groupBy("order_date").agg(
        F.count(F.lit(1)).alias("nb_orders"),  # one row per order
        F.sum("units").alias("units_sold"),
        F.sum("ht").cast("decimal(20,2)").alias("revenue_ht"),
        F.sum("ttc").cast("decimal(20,2)").alias("revenue_ttc"))
    running = Window.orderBy(F.col("order_date").asc_nulls_last())
    return daily.withColumn("cumulative_revenue_ttc", F.sum("revenue_ttc").over(running))


def revenue_by_item(items: DataFrame, order_items: DataFrame, orders: DataFrame) -> DataFrame:
    """Every item with its confirmed sales; unsold items get zeros."""
    per_pair = order_items.groupBy("order_id", "item_id").agg(
        F.sum("quantity").alias("q"), F.sum("line_total_ht").alias("ht"), F.sum("line_total_ttc").alias("ttc"))
    sales = (per_pair.join(_confirmed(orders).select("order_id"), "order_id")
             .groupBy("item_id").agg(
                 F.count(F.lit(1)).alias("nb_orders"),  # (order, item) pairs are distinct
                 F.sum("q").alias("total_units_sold"),
                 F.sum("ht").cast("decimal(20,2)").alias("total_revenue_ht"),
                 F.sum("ttc").cast("decimal(20,2)").alias("total_revenue_ttc")))
    zero = F.lit(0)
    return items.join(sales, "item_id", "left").select(
        "item_id", "title", "price_ht", "price_ttc", "tva_rate", F.col("quantity").alias("current_stock"),
        F.coalesce("nb_orders", zero).alias("nb_orders"),
        F.coalesce("total_units_sold", zero).alias("total_units_sold"),
        F.coalesce("total_revenue_ht", zero).alias("total_revenue_ht"),
        F.coalesce("total_revenue_ttc", zero).alias("total_revenue_ttc"))


def customer_segment(n_orders) -> F.Column:
    """Segment by confirmed-order count (ranges in ``fixed.SEGMENTS``)."""
    n = F.col(n_orders) if isinstance(n_orders, str) else n_orders
    out = None
    for name, lo, hi in SEGMENTS:
        if hi is None:
            return out.otherwise(name)
        cond = n.between(lo, hi)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def customer_lifetime(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Every customer (also those without orders): confirmed-order count,
    lifetime and average basket TTC, first/last order time, segment.

    The status test belongs to the outer join's condition; it is applied to
    the orders side before the join so customers without a confirmed order
    stay in with zeros."""
    stats = _confirmed(orders).groupBy("customer_id").agg(
        F.count("order_id").alias("n"),
        F.sum("total_ttc").alias("s"),
        F.avg("total_ttc").alias("a"),
        F.min("source_updated_at").alias("first_order_at"),
        F.max("source_updated_at").alias("last_order_at"))
    nb = F.coalesce(F.col("n"), F.lit(0).cast("bigint"))
    return customers.select("customer_id", "first_name", "last_name", "email").join(
        stats, "customer_id", "left").select(
        "customer_id", "first_name", "last_name", "email",
        nb.alias("nb_orders"),
        F.coalesce("s", F.lit(0)).alias("lifetime_value_ttc"),
        F.coalesce("a", F.lit(0)).alias("avg_basket_ttc"),
        "first_order_at", "last_order_at",
        customer_segment(nb).alias("customer_segment"))


def customer_reorders(order_items: DataFrame, orders: DataFrame, items: DataFrame) -> DataFrame:
    """Per customer x item bought in confirmed orders: quantity, orders, last
    purchase, current stock and price. Lines of deleted items drop out."""
    per_pair = order_items.groupBy("order_id", "item_id").agg(F.sum("quantity").alias("q"))
    bought = (per_pair.join(_confirmed(orders).select("order_id", "customer_id", "source_updated_at"), "order_id")
              .groupBy("customer_id", "item_id").agg(
                  F.sum("q").alias("total_qty_purchased"),
                  F.count(F.lit(1)).alias("nb_orders_with_item"),
                  F.max("source_updated_at").alias("last_purchased_at")))
    return bought.join(items.select("item_id", "title", "price_ttc", "quantity"), "item_id").select(
        "customer_id", "item_id", "title", "price_ttc", "total_qty_purchased", "nb_orders_with_item",
        "last_purchased_at", F.col("quantity").alias("current_stock"))


def payments(payments_df: DataFrame, orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Payments with the paying customer; ``paid_at`` is the payment's last change."""
    paid = payments_df.join(orders.select("order_id", "customer_id"), "order_id")
    return (paid.join(customers.select("customer_id", "first_name", "last_name", "email"), "customer_id")
            .select("payment_id", "order_id", "customer_id", "first_name", "last_name", "email", "amount",
                    "payment_status", "payment_method", "transaction_id",
                    F.col("source_updated_at").alias("paid_at")))


def due_status(due_date, as_of) -> F.Column:
    """'overdue' when the due date is before midnight of ``as_of``; NULL -> on_time."""
    return F.when(F.col(due_date) < as_of, DUE_OVERDUE).otherwise(DUE_ON_TIME)


def invoices(invoices_df: DataFrame, orders: DataFrame, customers: DataFrame,
             as_of: str | _dt.date | None = None) -> DataFrame:
    """Invoices with the customer and a due status as of a date (default today)."""
    as_of_col = F.current_date() if as_of is None else F.lit(str(as_of)).cast("date")
    billed = invoices_df.join(orders.select("order_id", "customer_id"), "order_id")
    return (billed.join(customers.select("customer_id", "first_name", "last_name", "email"), "customer_id")
            .select("invoice_id", "invoice_number", "order_id", "customer_id", "first_name", "last_name",
                    "email", "total_ht", "total_tva", "total_ttc", "issued_at", "due_date",
                    due_status("due_date", as_of_col).alias("due_status")))


# name -> (function, dwh sources in argument order)
MARTS = {
    "mart_sales_daily": (sales_daily, ("orders", "order_items")),
    "mart_revenue_by_item": (revenue_by_item, ("items", "order_items", "orders")),
    "mart_customer_lifetime": (customer_lifetime, ("customers", "orders")),
    "mart_customer_reorders": (customer_reorders, ("order_items", "orders", "items")),
    "mart_payments": (payments, ("payments", "orders", "customers")),
    "mart_invoices": (invoices, ("invoices", "orders", "customers")),
}
