"""Labels and data-quality checks on hand-made cleaned rows."""

from __future__ import annotations

from pyspark.sql import functions as F

import datetime as dt

from martforge.operators import customers as custops
from martforge.operators import quality

T0 = dt.datetime(2024, 1, 1)


def test_payment_labels_any_case(spark):
    df = spark.createDataFrame(
        [(1, "CARD", "COMPLETED", "TXN-1"), (2, "paypal", "pending", None), (3, "BANK_TRANSFER", "FAILED", "x"),
         (4, None, "REFUNDED", "y")], "payment_id long, payment_method string, payment_status string, transaction_id string")
    got = {r["payment_id"]: (r["method_label"], r["status_label"], r["transaction_label"])
           for r in quality.payment_labels(df).collect()}
    assert got == {1: ("Carte", "Payé", "TXN-1"), 2: ("PayPal", "En attente", "—"),
                   3: ("Virement", "Échoué", "x"), 4: ("—", "Remboursé", "y")}


def test_status_and_stock_labels(spark):
    o = spark.createDataFrame([(1, "confirmed"), (2, "shipped")], "order_id long, status string")
    assert {r["status_label"] for r in quality.order_status_labels(o).collect()} == {"Confirmed", "Shipped"}
    it = spark.createDataFrame([(1, 0, 5.5), (2, 4, 20.0), (3, 5, 10.0), (4, -2, 0.0)],
                               "item_id long, quantity int, tva_rate double")
    got = {r["item_id"]: (r["stock_level"], r["tva_rate_shown"]) for r in quality.stock_levels(it).collect()}
    assert got == {1: ("out", 5), 2: ("low", 20), 3: ("ok", 10), 4: ("out", 0)}


def _tables(spark):
    dec = "decimal(10,2)"
    customers = spark.createDataFrame([(1, "a@x.io", "A", "B"), (2, "a@x.io", "C", None), (3, "bad mail", "D", "E")],
                                      "customer_id long, email string, first_name string, last_name string")
    admins = spark.createDataFrame([(1, "adm@x.io", "A", None), (2, "no mail", "B", "C")], "admin_id long, email string, first_name string, last_name string")
    items = spark.createDataFrame([(1, "t", 10.0, 20.0, 12.0), (2, "u", 10.0, 7.0, 10.7)],
                                  "item_id long, title string, price_ht double, tva_rate double, price_ttc double")
    items = items.selectExpr("item_id", "title", f"cast(price_ht as {dec}) price_ht",
                             "cast(tva_rate as decimal(5,2)) tva_rate", f"cast(price_ttc as {dec}) price_ttc")
    orders = spark.createDataFrame([(10, 1, "confirmed", 10.0, 12.0), (11, 99, "lost", 10.0, 12.0)],
                                   "order_id long, customer_id long, status string, total_ht double, total_ttc double")
    orders = orders.selectExpr("order_id", "customer_id", "status", f"cast(total_ht as {dec}) total_ht",
                               f"cast(total_ttc as {dec}) total_ttc")
    lines = spark.createDataFrame([(100, 10, 1, 1, 10.0, 12.0, 12.0), (100, 12, 5, 1, 1.0, 1.2, 1.2)],
                                  "order_item_id long, order_id long, item_id long, quantity int, unit_price_ht double, "
                                  "unit_price_ttc double, line_total_ttc double")
    lines = lines.selectExpr("order_item_id", "order_id", "item_id", "quantity", f"cast(unit_price_ht as {dec}) unit_price_ht",
                             f"cast(unit_price_ttc as {dec}) unit_price_ttc", f"cast(line_total_ttc as {dec}) line_total_ttc")
    payments = spark.createDataFrame([(1, 10, 12.0, "COMPLETED", "CARD"), (2, 10, 11.0, "PAID", "CASH")],
                                     "payment_id long, order_id long, amount double, payment_status string, payment_method string")
    payments = payments.selectExpr("payment_id", "order_id", f"cast(amount as {dec}) amount", "payment_status",
                                   "payment_method")
    invoices = spark.createDataFrame([(1, 10, "INV-1", 10.0, 2.0, 12.0), (2, 77, "INV-1", 1.0, 0.5, 1.2)],
                                     "invoice_id long, order_id long, invoice_number string, total_ht double, "
                                     "total_tva double, total_ttc double")
    invoices = invoices.selectExpr("invoice_id", "order_id", "invoice_number", f"cast(total_ht as {dec}) total_ht",
                                   f"cast(total_tva as {dec}) total_tva", f"cast(total_ttc as {dec}) total_ttc")
    return dict(customers=customers, admins=admins, items=items, orders=orders, order_items=lines,
                payments=payments, invoices=invoices)


def test_quality_checks(spark):
    t = _tables(spark)
    uniq = {(r["check"], r["key"]) for r in quality.dq_unique(t).collect()}
    assert uniq == {("customers.email", "a@x.io"), ("invoices.invoice_number", "INV-1"),
                    ("payments.order_id", "10"), ("order_items.order_item_id", "100")}
    fk = {(r["check"], r["id"]) for r in quality.dq_foreign_keys(t).collect()}
    assert fk == {("orders.customer_id", 11), ("order_items.order_id", 100), ("order_items.item_id", 100),
                  ("invoices.order_id", 2)}
    nn = {(r["table"], r["column"]): r["n_null"] for r in quality.dq_not_null(t).collect()}
    assert nn[("admins", "last_name")] == 1 and nn[("admins", "email")] == 0
    assert nn[("customers", "last_name")] == 1 and nn[("orders", "status")] == 0
    dom = {(r["check"], r["id"]) for r in quality.dq_domains(t).collect()}
    assert dom == {("orders.status", 11), ("payments.payment_status", 2), ("payments.payment_method", 2),
                   ("items.tva_rate", 2), ("customers.email", 3), ("admins.email", 2)}
    rec = {(r["check"], r["order_id"]) for r in quality.dq_reconcile(t).collect()}
    assert rec == {("payment.amount", 10), ("order.lines_ttc", 11)}  # 11 has no lines


def test_registration_and_profile(spark):
    existing = spark.createDataFrame([("taken@x.io",)], "email string")
    cands = spark.createDataFrame([(3, "new@x.io", " A ", "B", "", None), (1, "new@x.io", "first", "B", " ", "addr"),
                                   (2, "taken@x.io", "C", "D", "1", None)],
                                  "arrival long, email string, first_name string, last_name string, phone string, "
                                  "address string")
    got = custops.register_new_customers(existing, cands).collect()
    assert [(r["email"], r["first_name"], r["phone"], r["arrival"]) for r in got] == [("new@x.io", "first", " ", 1)]
    prof = custops.profile_normalise(cands).collect()
    by = {r["arrival"]: r for r in prof}
    assert by[3]["first_name"] == "A" and by[3]["phone"] is None and by[1]["phone"] is None


def test_strip_takes_unicode_white_space(spark):
    from martforge.operators.customers import profile_normalise
    rows = [("\tAnn\n", "\u00a0Bo\u2003 x ", "\n\t", "a\u00a0b"), (None, "", " \u3000", "\x1cZ\x85")]
    df = spark.createDataFrame(rows, "first_name string, last_name string, phone string, address string")
    want = [tuple(None if v is None or (c > 1 and not v.strip()) else v.strip() for c, v in enumerate(r)) for r in rows]
    assert [tuple(r) for r in profile_normalise(df).collect()] == want


def test_invoice_numbers_are_unique_and_checks_ignore_nulls(spark):
    from martforge.operators.orders import derive_invoices
    from martforge.operators import quality
    orders = spark.range(0, 30_000_000, 997).select(F.col("id").alias("order_id"), F.lit(1).cast("decimal(20,2)").alias("total_ht"),
                                                    F.lit(2).cast("decimal(20,2)").alias("total_ttc"))
    made = derive_invoices(orders, "2024-01-01 00:00:00")
    assert made.select("invoice_number").distinct().count() == orders.count()
    empty = spark.createDataFrame([(None, None), (None, None)], "email string, order_id long")
    tables = {t: empty.selectExpr("email", "email as invoice_number", "order_id", "order_id as order_item_id") for t in quality.UNIQUE}
    assert quality.dq_unique(tables).count() == 0


def test_shuffles_of_larger_tables_start_with_more_partitions(spark, tmpdir_, monkeypatch):
    from martforge import session
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    spark.range(1000).write.parquet(f"{tmpdir_}/t.parquet")
    before = spark.conf.get(key, None)
    try:
        session.spread(spark, [f"{tmpdir_}/t.parquet"])
        assert spark.conf.get(key, None) == before  # small: the session's
        monkeypatch.setattr(session, "PARTITION_INPUT_BYTES", 100)
        session.spread(spark, [f"{tmpdir_}/t.parquet"])
        assert int(spark.conf.get(key)) >= 40
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
