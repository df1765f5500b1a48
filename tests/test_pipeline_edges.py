"""Hand-made staging rows for each trap of the cleaning loads and marts."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from martforge.operators import dwh, marts
from martforge.schemas import staging_schema

MS = 1_704_067_200_000  # 2024-01-01


def stg(spark, table, rows):
    schema = staging_schema(table)
    full = [tuple(r.get(f.name) for f in schema.fields) for r in rows]
    return spark.createDataFrame(full, schema)


def person(i, deleted="false", active=1, **kw):
    return dict(id=i, email=f"c{i}@x.io", first_name=f"F{i}", last_name=f"L{i}", hashed_password="h",
                is_active=active, __source_ts_ms=MS, __deleted=deleted, **kw)


def order(i, cust, status="CONFIRMED", ttc=12.0, ts=MS, deleted="false"):
    return dict(id=i, customer_id=cust, status=status, total_ht=round(ttc / 1.2, 2), total_ttc=ttc,
                __source_ts_ms=ts, __deleted=deleted)


def line(i, order_id, item, qty=1, ht=10.0, ttc=12.0, deleted="false"):
    return dict(id=i, order_id=order_id, item_id=item, quantity=qty, unit_price_ht=ht, unit_price_ttc=ttc,
                __deleted=deleted)


def item(i, qty=5, deleted="false"):
    return dict(id=i, title=f"item{i}", price_ht=10.0, tva_rate=20.0, price_ttc=12.0, quantity=qty,
                __source_ts_ms=MS, __deleted=deleted)


def test_live_row_filter_and_decodes(spark):
    rows = [person(1, deleted=None, active=None), person(2, deleted="true"), person(3, deleted="false", active=0)]
    out = {r["customer_id"]: r for r in dwh.load_customers(stg(spark, "customers", rows)).collect()}
    assert set(out) == {1, 3}                         # NULL __deleted is live, 'true' is not
    assert out[1]["is_active"] is None and out[3]["is_active"] is False
    assert out[1]["source_updated_at"] == dt.datetime(2024, 1, 1)
    assert "hashed_password" not in dwh.load_customers(stg(spark, "customers", rows)).columns


def test_status_lowercased_payment_status_kept(spark):
    o = dwh.load_orders(stg(spark, "orders", [order(1, 1, status="CONFIRMED"), order(2, 1, status="Pending")]))
    assert sorted(r["status"] for r in o.collect()) == ["confirmed", "pending"]
    p = dwh.load_payments(stg(spark, "payments", [dict(id=1, order_id=1, amount=1.0, status="COMPLETED",
                                                       payment_method="CARD", __deleted="false")]))
    assert p.collect()[0]["payment_status"] == "COMPLETED"


def _dwh(spark, customers, orders, lines, items):
    return (dwh.load_customers(stg(spark, "customers", customers)), dwh.load_orders(stg(spark, "orders", orders)),
            dwh.load_order_items(stg(spark, "order_items", lines)), dwh.load_items(stg(spark, "items", items)))


def test_segments_unsold_items_and_delete_cascades(spark):
    customers = [person(i) for i in range(6)] + [person(9, deleted="true")]
    orders, lines, n = [], [], 0
    for cust, k in ((1, 1), (2, 2), (3, 4), (4, 5)):
        for _ in range(k):
            n += 1
            orders.append(order(n, cust))
            lines.append(line(n, n, item=1))
    orders += [order(100, 5, status="PENDING"), order(101, 9), order(102, 1)]  # 102: no lines; 101: deleted customer
    lines += [line(200, 101, item=1), line(201, 1, item=7)]                    # item 7 deleted
    items = [item(1), item(2), item(7, deleted="true")]
    c, o, li, it = _dwh(spark, customers, orders, lines, items)

    seg = {r["customer_id"]: (r["nb_orders"], r["customer_segment"]) for r in marts.customer_lifetime(c, o).collect()}
    assert seg[0] == (0, "no_order") and seg[1] == (2, "recurring") and seg[2] == (2, "recurring")
    assert seg[3] == (4, "recurring") and seg[4] == (5, "loyal") and seg[5] == (0, "no_order")
    assert 9 not in seg

    rev = {r["item_id"]: r for r in marts.revenue_by_item(it, li, o).collect()}
    assert rev[2]["nb_orders"] == 0 and rev[2]["total_revenue_ttc"] == 0   # unsold item kept with zeros
    assert 7 not in rev

    daily = marts.sales_daily(o, li).collect()
    assert len(daily) == 1
    # every confirmed order with lines counts, including the deleted customer's (101); 102 has no line
    assert daily[0]["nb_orders"] == 12 + 1
    reorders = {(r["customer_id"], r["item_id"]) for r in marts.customer_reorders(li, o, it).collect()}
    assert (1, 7) not in reorders and (1, 1) in reorders                    # deleted item drops out


def test_invoice_due_status_and_payment_cascade(spark):
    customers = [person(1), person(2, deleted="true")]
    orders = [order(1, 1), order(2, 2)]
    day = dt.datetime(2024, 3, 10)
    ms = lambda d: int(d.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    inv = [dict(id=i, order_id=1, invoice_number=f"INV-{i}", issued_at=MS, due_date=due, total_ht=10.0,
                total_tva=2.0, total_ttc=12.0, __source_ts_ms=MS, __deleted="false")
           for i, due in ((1, None), (2, ms(day + dt.timedelta(hours=10))), (3, ms(day - dt.timedelta(days=1))))]
    inv.append(dict(id=4, order_id=2, invoice_number="INV-4", issued_at=MS, due_date=None, total_ht=1.0,
                    total_tva=0.2, total_ttc=1.2, __source_ts_ms=MS, __deleted="false"))
    c = dwh.load_customers(stg(spark, "customers", customers))
    o = dwh.load_orders(stg(spark, "orders", orders))
    v = dwh.load_invoices(stg(spark, "invoices", inv))
    got = {r["invoice_id"]: r["due_status"] for r in marts.invoices(v, o, c, as_of=day.date()).collect()}
    assert got == {1: "on_time", 2: "on_time", 3: "overdue"}   # NULL due, due today 10:00, due yesterday


def test_null_day_sorts_last_in_running_total(spark):
    orders = [order(1, 1, ts=MS), order(2, 1, ts=None), order(3, 1, ts=MS + 86_400_000)]
    lines = [line(i, i, item=1, qty=1, ttc=12.0) for i in (1, 2, 3)]
    o = dwh.load_orders(stg(spark, "orders", orders))
    li = dwh.load_order_items(stg(spark, "order_items", lines))
    rows = {r["order_date"]: r["cumulative_revenue_ttc"] for r in marts.sales_daily(o, li).collect()}
    assert rows[None] == Decimal("36.00")
    assert rows[dt.date(2024, 1, 1)] == Decimal("12.00") and rows[dt.date(2024, 1, 2)] == Decimal("24.00")
