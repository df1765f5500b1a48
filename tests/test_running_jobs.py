"""Carts kept as a table and allotment from a ledger, against the batch plans over all rows."""

from __future__ import annotations

import datetime as dt
import random
import threading

import pytest
from pyspark.sql import functions as F

from martforge.operators.carts import cart_state
from martforge.operators.orders import allocate_orders, stock_after_orders
from martforge.plans import catalog, changes
from martforge.streaming.allocation import StockLedger
from martforge.streaming.cart_table import CartTable

DAY = dt.timedelta(days=1)
ACTIONS = "cart_id long, item_id long, action string, quantity int, ts timestamp, arrival long"
REQUESTS = "request_id long, customer_id long, item_id long, quantity int, arrival long"


def random_cuts(r, n, parts):
    cuts = sorted(r.randrange(n + 1) for _ in range(parts - 1))
    return list(zip([0, *cuts], [*cuts, n], strict=True))


# -- carts ------------------------------------------------------------------------

def random_actions(r, n):
    now, rows = dt.datetime(2024, 1, 1), []
    for arrival in range(n):
        now += r.choice([dt.timedelta(minutes=1), dt.timedelta(minutes=1), DAY, 5 * DAY])
        cart = r.choice([1, 1, 1, 2, 3, None])  # one cart holds half of all
        rows.append((cart, r.choice([1, 2, 3, 4, 9, None]), r.choice(["add", "add", "add", "update", "remove", "clear"]), r.randrange(-1, 5), now, arrival))
    return rows, now


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_carts_in_any_batches_equal_the_batch_fold(spark, tmpdir_, seed):
    catalog.ensure_namespaces(spark)
    r = random.Random(seed)
    items = spark.createDataFrame([(1, 5), (2, 0), (3, 2), (4, 100)], "item_id long, quantity int")  # 9 is unknown
    rows, now = random_actions(r, 70)
    carts = CartTable(spark, f"staging.carts{seed}", tmpdir_, width=4)
    for k, (a, b) in enumerate(random_cuts(r, len(rows), 4)):
        part = rows[a:b]
        r.shuffle(part)
        batch = spark.createDataFrame(part, ACTIONS)
        carts.take(batch, items, "s", k)
        if k % 2:
            version = carts.table.current().version if carts.table.current() else None
            carts.take(spark.createDataFrame(rows, ACTIONS), items, "s", k)  # a replay is skipped
            assert version is None or carts.table.current().version == version
        before = spark.createDataFrame([row for row in rows[:b] if row[0] is not None], ACTIONS)
        for as_of in (rows[max(b - 1, 0)][4], now + 8 * DAY):
            want = sorted(map(tuple, cart_state(before, items, as_of=as_of, width=4).collect()), key=str)
            assert sorted(map(tuple, carts.read(as_of=as_of).collect()), key=str) == want
    carts.table.compact(force=True)
    assert sorted(map(tuple, carts.read(as_of=now).collect()), key=str) == sorted(map(tuple, cart_state(before, items, as_of=now, width=4).collect()), key=str)


def test_a_large_batch_needs_no_namespace_made_before(spark, tmpdir_, monkeypatch):
    monkeypatch.setattr(changes, "BUCKET_BYTES", 1)  # as if the batch were large: laid out as a catalogue table
    actions = spark.createDataFrame([(1, 4, "add", 1, dt.datetime(2020, 1, 1), 0)], ACTIONS)
    carts = CartTable(spark, "carts_unheard_of.state", tmpdir_)
    carts.take(actions, spark.createDataFrame(ITEMS, ITEM_COLUMNS), "s", 0)
    assert carts.read(as_of="2020-01-02").collect() == [(1, 4, 1)]
    public = changes.ChangeTable(spark, "unheard_of.t", tmpdir_, order=("offset",))  # a view, too
    public.append(spark.createDataFrame([(1, 1, 1)], "id long, offset long, v long"))
    assert spark.table("unheard_of.t").count() == 1


def test_a_batch_writes_what_it_touches_and_is_combined_map_side(spark, tmpdir_):
    catalog.ensure_namespaces(spark)
    items = spark.createDataFrame([(i, 1000) for i in range(50)], "item_id long, quantity int")
    at = dt.datetime(2024, 1, 1)
    carts = CartTable(spark, "staging.carts_touch", tmpdir_)
    assert carts.read(as_of=at).count() == 0
    carts.take(spark.createDataFrame([], ACTIONS), items, "s", 0)
    many = [(c, i, "add", 1, at, c * 50 + i) for c in range(20) for i in range(50)]
    carts.take(spark.createDataFrame(many, ACTIONS), items, "s", 1)
    carts.take(spark.createDataFrame([(7, 0, "clear", 0, at, 5000), (7, 3, "add", 2, at, 5001), (8, 4, "add", 2, at, 5002)], ACTIONS), items, "s", 2)
    last = carts.table.current().segments[-1]
    assert spark.read.parquet(last.path).count() == 4  # two carts, two entries: the 50 that were cleared aren't touched
    state = carts.read(as_of=at)
    assert state.count() == 19 * 50 + 1
    assert {(r["item_id"], r["quantity"]) for r in state.where("cart_id = 7").collect()} == {(3, 2)}
    assert state.where("cart_id = 8 AND item_id = 4").first()["quantity"] == 3


# -- allotment ----------------------------------------------------------------------

ITEMS = [(1, 20, 1.5, 1.8), (2, 0, 2.0, 2.4), (3, 7, 0.99, 1.19), (4, 100, 10.0, 12.0), (5, -3, 1.0, 1.2)]
ITEM_COLUMNS = "item_id long, quantity long, price_ht double, price_ttc double"


def random_requests(r, n):
    return [(k, r.randrange(4), r.choice([1, 1, 1, 2, 3, 4, 5, 8, None]), r.randrange(-1, 6), k) for k in range(n)]


def lines_of(df):
    return sorted(map(str, df.collect())) if df is not None else []


@pytest.mark.parametrize("seed", [1, 2])
def test_one_share_in_any_batches_equals_the_batch_plan(spark, tmpdir_, seed):
    catalog.ensure_namespaces(spark)
    r, rows = random.Random(seed), random_requests(random.Random(seed), 40)
    items = spark.createDataFrame(ITEMS, ITEM_COLUMNS)
    ledger = StockLedger(spark, f"staging.stock{seed}", tmpdir_, width=4)
    if seed == 2:  # no units yet: lines of 0
        ledger.allot(spark.createDataFrame(rows[:1], REQUESTS).withColumns({"item_id": F.lit(1).cast("long"), "quantity": F.lit(2)}), items, "early", 0)
        assert [row["quantity"] for row in ledger.lines().collect()] == [0]
    opening = items.select("item_id", F.col("quantity").alias("units"))
    ledger.restock(opening, "opening")
    ledger.restock(opening, "opening")  # a replay
    for k, (a, b) in enumerate(random_cuts(r, len(rows), 4)):
        ledger.allot(spark.createDataFrame(rows[a:b], REQUESTS), items, "s", k)
        ledger.allot(spark.createDataFrame(rows, REQUESTS), items, "s", k)
    want = allocate_orders(spark.createDataFrame(rows, REQUESTS), items, width=4)
    got = ledger.lines().where("request_id >= 0")
    if seed == 2:
        got = got.exceptAll(ledger.lines().where("requested = 2 AND item_id = 1 AND quantity = 0 AND request_id = 0").limit(1))
    assert lines_of(got.select(want.columns)) == lines_of(want)
    left = {row["item_id"]: row["stock_after"] for row in stock_after_orders(items, want).collect() if row["stock_after"]}
    assert {row["item_id"]: row["units"] for row in ledger.left().collect()} == left


def test_shares_at_once_never_allot_too_much_and_lose_nothing(spark, tmpdir_):
    catalog.ensure_namespaces(spark)
    items = spark.createDataFrame(ITEMS[:4], ITEM_COLUMNS)
    StockLedger(spark, "staging.stock_s", tmpdir_, shares=3).restock(items.select("item_id", F.col("quantity").alias("units")), "opening")
    errors = []

    def run(share):
        try:
            r, ledger = random.Random(share), StockLedger(spark, "staging.stock_s", tmpdir_, shares=3)
            for k in range(3):
                rows = [(share * 100 + k * 10 + i, 1, r.choice([1, 1, 3, 4]), r.randrange(1, 5), i) for i in range(6)]
                ledger.allot(spark.createDataFrame(rows, REQUESTS), items, f"s{share}", k, share % 3)
                if k == 1:
                    ledger.rebalance()
        except Exception as error:  # shown below
            errors.append(error)

    threads = [threading.Thread(target=run, args=(s,)) for s in (0, 1, 2, 4)]  # 1 and 4 draw from one share
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    ledger = StockLedger(spark, "staging.stock_s", tmpdir_, shares=3)
    taken = {r["item_id"]: r["q"] for r in ledger.lines().groupBy("item_id").agg(F.sum("quantity").alias("q")).collect()}
    left = {r["item_id"]: r["units"] for r in ledger.left().collect()}
    assert ledger.lines().count() == 4 * 3 * 6
    for item, stock, *_ in ITEMS[:4]:
        assert taken.get(item, 0) + left.get(item, 0) == stock
    assert all(r["units"] >= 0 for r in ledger.left(by_share=True).collect())
    ledger.rebalance()
    spread = {}
    for r in ledger.left(by_share=True).collect():
        spread.setdefault(r["item_id"], []).append(r["units"])
    assert {i: sum(u) for i, u in spread.items()} == left and all(max(u) - min(u) <= 1 for u in spread.values() if len(u) == 3)


def test_a_failed_batch_leaves_nothing_and_a_late_one_is_computed_again(spark, tmpdir_, monkeypatch):
    catalog.ensure_namespaces(spark)
    items = spark.createDataFrame([(1, 10, 1.0, 1.2)], ITEM_COLUMNS)
    ledger = StockLedger(spark, "staging.stock_f", tmpdir_)
    ledger.restock(items.select("item_id", F.col("quantity").alias("units")), "opening")
    batch = spark.createDataFrame([(1, 1, 1, 8, 1)], REQUESTS)
    commit = ledger._commit
    monkeypatch.setattr(ledger, "_commit", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        ledger.allot(batch, items, "s", 0)
    assert ledger.lines() is None and ledger.left().first()["units"] == 10
    other = StockLedger(spark, "staging.stock_f", tmpdir_)
    calls = []

    def overtaken(*a, **k):  # another stream of the same share is first, once
        if not calls:
            calls.append(1)
            other.allot(spark.createDataFrame([(2, 1, 1, 5, 1)], REQUESTS), items, "t", 0)
        return commit(*a, **k)

    monkeypatch.setattr(ledger, "_commit", overtaken)
    ledger.allot(batch, items, "s", 0)
    assert {r["request_id"]: r["quantity"] for r in ledger.lines().collect()} == {2: 5, 1: 5} and ledger.left().count() == 0
    ledger.table.versions.vacuum(keep=1, orphans_after=-1)
    assert ledger.lines().count() == 2
    with pytest.raises(ValueError, match="share 1 of 1"):
        ledger.allot(batch, items, "s", 1, share=1)
