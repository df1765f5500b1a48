"""Versions by manifest, merge-on-read tables, kept marts: against plain folds and full recomputation."""

from __future__ import annotations

import random
import threading

import pytest
from pyspark.sql import functions as F

from martforge.operators import dwh, marts, shop
from martforge.plans import catalog, changes, incremental
from martforge.plans.changes import ChangeTable
from martforge.plans.incremental import KEPT, KeptMart
from martforge.plans.suggestions import KeptSuggestions
from martforge.plans.versions import Segment, Versions
from martforge.session import configure


# -- versions -----------------------------------------------------------------

def test_only_one_of_two_writers_gets_a_version(spark, tmpdir_):
    store = Versions(spark, f"{tmpdir_}/t")
    barrier, got = threading.Barrier(4), []

    def write(k):
        own = Versions(spark, f"{tmpdir_}/t")
        barrier.wait()
        for _ in range(5):
            got.append(own.commit(lambda m: m.segments.append(Segment(f"{k}", {}))).version)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(got) == list(range(1, 21)) and len(store.current().segments) == 20  # none lost, none twice


def test_vacuum_keeps_leased_versions_and_fresh_orphans(spark, tmpdir_):
    store = Versions(spark, f"{tmpdir_}/t")
    folders = []
    for k in range(5):
        folders.append(store.new_folder())
        spark.range(k).write.parquet(folders[-1])
        store.commit(lambda m: setattr(m, "segments", [Segment(folders[-1], {})]))
        if k == 1:
            _, lease = store.take()
    orphan = store.new_folder()
    spark.range(1).write.parquet(orphan)
    assert store.vacuum(keep=1) == sorted([folders[0], folders[2], folders[3]]) and store.numbers() == [2, 5]
    store.give_back(lease)
    assert store.vacuum(keep=1) == [folders[1]]
    assert store.vacuum(keep=1, orphans_after=-1) == [orphan] and store.numbers() == [5]
    assert store.take(version=5)[0].version == 5
    with pytest.raises(LookupError):
        store.take(version=2)


def test_vacuum_passes_over_a_folder_that_another_has_removed(spark, tmpdir_, monkeypatch):
    store = Versions(spark, f"{tmpdir_}/t")
    store.commit(lambda m: m.segments.clear())
    names = store.files.names
    monkeypatch.setattr(store.files, "names", lambda folder: [*names(folder), *(["removed"] if folder.endswith("/data") else [])])
    assert store.vacuum() == []


def test_a_lease_that_has_run_out_holds_nothing(spark, tmpdir_):
    store = Versions(spark, f"{tmpdir_}/t")
    store.commit(lambda m: m.segments.clear())
    store.take(seconds=-1)
    store.commit(lambda m: m.segments.clear())
    store.vacuum(keep=1)
    assert store.numbers() == [2] and store.files.names(f"{store.folder}/leases") == []


# -- merge on read --------------------------------------------------------------

SCHEMA = "id long, v string, n int, __source_ts_ms long, offset long, __deleted string"


def random_batch(r, k):
    rows = [(r.choice([None, *range(12)]), r.choice([None, "a", "b"]), r.randrange(5), r.choice([None, *range(8)]), r.randrange(4), r.choice(["true", "false"]))
            for _ in range(r.randrange(0, 12))]
    # one row per (id, order) in a batch: which of two equal ones wins isn't defined
    return list({(row[0], row[3], row[4]): row for row in rows}.values())


def plain_fold(batches):
    out = {}
    for rows in batches:
        mine = {}
        for row in rows:
            rank = tuple(-1 if x is None else x for x in row[3:5])
            if row[0] is not None and (row[0] not in mine or rank >= mine[row[0]][0]):
                mine[row[0]] = (rank, row)
        for key, (rank, row) in mine.items():
            if key not in out or rank >= out[key][0]:
                out[key] = (rank, row)
    return sorted((row for _, row in out.values()), key=str)


def folded(table, manifest=None):
    return sorted(map(tuple, table.read(manifest).select("id", "v", "n", "__source_ts_ms", "offset", "__deleted").collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_batches_and_compactions_fold_to_the_latest_rows(spark, tmpdir_, seed):
    catalog.ensure_namespaces(spark)
    r, batches = random.Random(seed), []
    table = ChangeTable(spark, f"staging.random{seed}", tmpdir_, buckets=3)
    for k in range(7):
        batch = random_batch(r, k)
        df = spark.createDataFrame(batch, SCHEMA).coalesce(1)
        if k == 0:
            table.load(df) if seed % 2 else table.append(df, "s", k)
        else:
            table.append(df, "s", k)
        batches.append(batch)
        if r.random() < 0.4 and (k or seed % 2 == 0):  # a replayed batch changes nothing
            before = table.current().version
            assert table.append(spark.createDataFrame(random_batch(r, k), SCHEMA), "s", k).version == before
        held = table.current()
        want = plain_fold(batches)
        assert folded(table) == want
        if r.random() < 0.6:
            table.compact(force=r.random() < 0.5)
            assert folded(table) == want and folded(table, held) == want  # after, and by the version before
        assert sorted(map(tuple, spark.table(table.name).select("id", "v", "n", "__source_ts_ms", "offset", "__deleted").collect()), key=str) == want
    keys = spark.range(0, 12, 2)
    want = plain_fold(batches)
    assert sorted(r["id"] for r in table.only(keys).collect()) == [row[0] for row in sorted(want, key=lambda x: x[0]) if row[0] % 2 == 0]
    values = spark.createDataFrame([("a",)], "v string")
    assert sorted(r["id"] for r in table.only(values, "v").collect()) == sorted(row[0] for row in want if row[1] == "a")


def test_what_is_appended_during_a_compaction_stays(spark, tmpdir_, monkeypatch):
    catalog.ensure_namespaces(spark)
    table, other = (ChangeTable(spark, "staging.during", tmpdir_, buckets=2) for _ in range(2))
    row = lambda i, v, t: spark.createDataFrame([(i, v, 0, t, 0, "false")], SCHEMA)
    table.load(row(1, "old", 1))
    table.append(row(1, "new", 2))
    write = table._segment

    def slow(*args, **kwargs):
        done = write(*args, **kwargs)
        other.append(row(2, "meanwhile", 1))
        return done

    monkeypatch.setattr(table, "_segment", slow)
    assert table.compact(force=True)
    assert [(r["id"], r["v"]) for r in table.read().orderBy("id").collect()] == [(1, "new"), (2, "meanwhile")]
    assert [s.kind for s in table.current().segments] == ["base", "delta"]
    monkeypatch.setattr(table, "_segment", lambda *a, **k: (other.compact(force=True), write(*a, **k))[1])
    table.append(row(3, "x", 1))
    assert not table.compact(force=True)  # the other one was first
    assert table.read().count() == 3


def test_a_batch_writes_in_proportion_to_itself_and_tiers_merge(spark, tmpdir_):
    catalog.ensure_namespaces(spark)
    table = ChangeTable(spark, "staging.sizes", tmpdir_, buckets=2)
    rows = lambda lo, hi, t: spark.range(lo, hi, 1, 1).select(
        "id", F.sha2(F.col("id").cast("string"), 256).alias("v"), F.lit(t).cast("long").alias("__source_ts_ms"), F.lit(0).cast("long").alias("offset"))
    table.load(rows(0, 200_000, 0))
    base = table.current().segments[0].bytes
    for k in range(5):
        small = table.append(rows(k * 100, k * 100 + 50, 1 + k)).segments[-1].bytes
        assert small < base / 500
        table.compact()
    assert [(s.kind, s.stored_seq) for s in table.current().segments] in ([("delta", True), ("base", False), ("delta", False)],)
    assert table.read().where("__source_ts_ms > 0").count() == 250
    big = table.append(rows(0, 100_000, 9))
    assert table.plan_compaction(big)[1] == "base" and table.compact()
    assert [s.kind for s in table.current().segments] == ["base"] and table.read().where("__source_ts_ms = 9").count() == 100_000
    # keys changed after a version, also across the compaction
    assert table.changed(big.next_seq - 2).count() == 100_000 and table.changed(big.next_seq - 3).count() == 100_000


def test_schema_evolves_and_types_that_clash_are_refused(spark, tmpdir_):
    catalog.ensure_namespaces(spark)
    table = ChangeTable(spark, "staging.evolving", tmpdir_, buckets=2)
    table.load(spark.sql("SELECT 1L AS id, 7 AS n, 1L AS __source_ts_ms, 0L AS offset"))
    table.append(spark.sql("SELECT 1L AS id, 9007199254740993L AS n, 'x' AS extra, 2L AS __source_ts_ms, 0L AS offset"))
    assert table.read().select("id", "n", "extra").collect() == [(1, 9007199254740993, "x")]
    version = table.current().version
    with pytest.raises(TypeError, match="column n is bigint in the table and double"):
        table.append(spark.sql("SELECT 1L AS id, 0.5D AS n, 3L AS __source_ts_ms, 0L AS offset"))
    assert table.current().version == version and table.read().count() == 1


def test_a_fold_shuffles_the_segments_only(spark, tmpdir_):
    catalog.ensure_namespaces(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = ChangeTable(spark, "staging.planned", tmpdir_, buckets=n)
    rows = lambda lo, hi, t: spark.range(lo, hi).select("id", F.col("id").alias("order_id"), F.lit(t).cast("long").alias("__source_ts_ms"),
                                                       F.lit(0).cast("long").alias("offset"))
    table.load(rows(0, 5000, 0))
    table.append(rows(0, 20, 1))
    for key in ("autoBroadcastJoinThreshold", "adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(f"spark.sql.{key}", "-1")
    try:
        plan = table.read()._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in ("autoBroadcastJoinThreshold", "adaptive.autoBroadcastJoinThreshold"):
            spark.conf.set(f"spark.sql.{key}", str(32 * 1024 * 1024))
        configure(spark)
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    # rows of some keys: the base is filtered by broadcast keys before anything is shuffled
    plan = table.only(spark.range(3).toDF("key"), "order_id")._jdf.queryExecution().executedPlan().toString()
    base = plan[plan.index("FileScan parquet"):]
    assert "BroadcastHashJoin" in plan and "ExistenceJoin" in plan and "Bucketed: true" in base


# -- kept marts ---------------------------------------------------------------

TYPES = {
    "customers": "id long, email string, first_name string, last_name string, phone string, address string, is_active smallint",
    "items": "id long, title string, description string, image_url string, price_ht double, tva_rate double, price_ttc double, quantity int",
    "orders": "id long, customer_id long, status string, total_ht double, total_ttc double",
    "order_items": "id long, order_id long, item_id long, quantity int, unit_price_ht double, unit_price_ttc double",
    "payments": "id long, order_id long, amount double, status string, payment_method string, transaction_id string",
    "invoices": "id long, order_id long, invoice_number string, issued_at long, due_date long, total_ht double, total_tva double, total_ttc double",
}
META = ", __source_ts_ms long, __deleted string, offset long"


def random_changes(r, table, offset):
    """Inserts, updates, deletes, late and repeated changes of few ids, so that they meet."""
    own = {"customers": lambda: ("e", r.choice("ab"), "l", None, None, 1), "items": lambda: (r.choice("xy"), None, None, 1.0, 20.0, 1.2, r.randrange(3)),
           "orders": lambda: (r.randrange(4), r.choice(["CONFIRMED", "CONFIRMED", "PENDING"]), 1.0, r.choice([None, 2.5, 7.25])),
           "order_items": lambda: (r.randrange(7), r.randrange(4), r.choice([None, 1, 2]), 1.5, 2.0),
           "payments": lambda: (r.randrange(7), 1.0, r.choice(["FAILED", "OK"]), "CARD", "t"), "invoices": lambda: (r.randrange(7), "i", 0, r.choice([None, 5]), 1.0, 0.2, 1.2)}
    rows = []
    for _ in range(r.randrange(1, 8)):
        offset += 1
        rows.append((r.randrange(7), *own[table](), r.randrange(6) * 86_400_000 * 40, r.choice(["true", "false", "false", None]), offset))
    return rows, offset


def full(name, tables):
    fn, sources = marts.MARTS[name]
    rows = [dwh.LOADS[s](tables[s].read()) for s in sources]
    return fn(*rows, as_of="1970-01-03") if name == "mart_invoices" else fn(*rows)


def rows_of(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", sorted(KEPT))
def test_kept_mart_equals_the_full_one_after_random_batches(spark, tmpdir_, name):
    catalog.ensure_namespaces(spark)
    r, offset = random.Random(name), 0
    sources = sorted({*KEPT[name].sources, *KEPT[name].dimensions})
    tables = {t: ChangeTable(spark, f"staging.{t}", tmpdir_, public=False, buckets=2) for t in sources}
    mart, seen = KeptMart(spark, name, tables, tmpdir_), []
    for k in range(4):
        for t in sources:
            if k and r.random() < 0.4:
                continue
            rows, offset = random_changes(r, t, offset)
            rows += r.sample(seen, 1) if seen and seen[-1][0] == t else []
            tables[t].append(spark.createDataFrame(rows, TYPES[t] + META).coalesce(1))
            if r.random() < 0.3:
                tables[t].compact(force=True)
            tables[t].versions.vacuum(keep=1)  # the seen versions are held
        mart.refresh()
        got, want = mart.read(as_of="1970-01-03"), full(name, tables)
        assert rows_of(got) == rows_of(want), (name, k)
        assert sorted(got.columns) == sorted(want.columns)
    assert not mart.refresh()  # nothing new
    assert {t: len(tables[t].versions.leased()) for t in KEPT[name].sources} == {t: 1 for t in KEPT[name].sources}


def test_a_cancelled_first_order_moves_the_first_time(spark, tmpdir_):
    catalog.ensure_namespaces(spark)
    tables = {t: ChangeTable(spark, f"staging.{t}", tmpdir_, public=False, buckets=2) for t in ("customers", "orders")}
    day = 86_400_000
    order = lambda *rows: spark.createDataFrame([(i, 1, s, 1.0, 2.0, t * day, "false", t) for i, s, t in rows], TYPES["orders"] + META)
    tables["customers"].load(spark.createDataFrame([(1, "e", "a", "b", None, None, 1, 0, "false", 0)], TYPES["customers"] + META))
    tables["orders"].load(order((1, "CONFIRMED", 1), (2, "CONFIRMED", 2), (3, "CONFIRMED", 3)))
    mart = KeptMart(spark, "mart_customer_lifetime", tables, tmpdir_)
    mart.refresh()
    tables["orders"].append(order((1, "CANCELLED", 9), (3, "CANCELLED", 10)))
    mart.refresh()
    row = mart.read().first()
    assert (row["nb_orders"], row["first_order_at"], row["last_order_at"]) == (1, row["last_order_at"], row["first_order_at"])
    assert row["first_order_at"].day == 3 and mart.store.read().where("n > 0").count() == 1


def test_a_refresh_writes_what_changed(spark, tmpdir_):
    """One changed order among thousands: few contributions, no shuffle of the lines."""
    catalog.ensure_namespaces(spark)
    tables = {t: ChangeTable(spark, f"staging.{t}", tmpdir_, public=False, buckets=4) for t in ("items", "orders", "order_items")}
    lit = lambda v, t: F.lit(v).cast(t)
    meta = [lit(0, "long").alias("__source_ts_ms"), F.lit("false").alias("__deleted"), lit(0, "long").alias("offset")]
    tables["orders"].load(spark.range(5000).select("id", (F.col("id") % 50).alias("customer_id"), F.lit("CONFIRMED").alias("status"),
                                                   lit(1, "double").alias("total_ht"), lit(1, "double").alias("total_ttc"), *meta))
    tables["order_items"].load(spark.range(20000).select("id", (F.col("id") % 5000).alias("order_id"), (F.col("id") % 300).alias("item_id"),
                                                         F.lit(2).alias("quantity"), lit(1, "double").alias("unit_price_ht"), lit(1, "double").alias("unit_price_ttc"), *meta))
    mart = KeptMart(spark, "mart_revenue_by_item", tables, tmpdir_)
    mart.refresh(compact=False)
    tables["orders"].append(spark.sql("SELECT 7L AS id, 7L AS customer_id, 'PENDING' AS status, 1D AS total_ht, 1D AS total_ttc, 5L AS __source_ts_ms, "
                                      "'false' AS __deleted, 1L AS offset"))
    mart.refresh(compact=False)
    last = mart.store.current().segments[-1]
    rows = spark.read.parquet(last.path).collect()
    assert 1 <= len(rows) <= 4 and all(r["nb_orders"] < 0 for r in rows)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
    lines = tables["order_items"].only(spark.range(7, 8).toDF("key"), "order_id")
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


# -- kept suggestions ---------------------------------------------------------------

@pytest.mark.parametrize("seed", [1, 2])
def test_kept_suggestions_equal_the_full_ones(spark, tmpdir_, seed):
    catalog.ensure_namespaces(spark)
    r, offset = random.Random(seed), 0
    tables = {t: ChangeTable(spark, f"staging.{t}", tmpdir_, public=False, buckets=2) for t in ("items", "order_items", "orders")}
    kept = KeptSuggestions(spark, tables, tmpdir_, k=2, spare=seed - 1)
    for k in range(4):
        for t in tables:
            if k and r.random() < 0.3:
                continue
            for _ in range(3 if k == 0 else 1):
                rows, offset = random_changes(r, t, offset)
                tables[t].append(spark.createDataFrame(rows, TYPES[t] + META).coalesce(1))
            tables[t].versions.vacuum(keep=1)
        kept.refresh()
        loads = {t: dwh.LOADS[t](tables[t].read()) for t in tables}
        assert rows_of(kept.read()) == rows_of(shop.reorder_suggestions(loads["order_items"], loads["orders"], loads["items"], k=2)), k
    assert not kept.refresh()


def test_an_item_that_sells_out_or_comes_back_moves_the_right_customers(spark, tmpdir_):
    catalog.ensure_namespaces(spark)
    tables = {t: ChangeTable(spark, f"staging.{t}", tmpdir_, public=False, buckets=2) for t in ("items", "order_items", "orders")}
    item = lambda ids, q, t: spark.createDataFrame([(i, "t", None, None, 1.0, 20.0, 1.2, q, t, "false", t) for i in ids], TYPES["items"] + META)
    tables["items"].load(item(range(1, 8), 5, 0))
    tables["orders"].load(spark.createDataFrame([(c, c, "CONFIRMED", 1.0, 2.0, 0, "false", 0) for c in (1, 2, 3)], TYPES["orders"] + META))
    bought = [(1, i) for i in range(1, 8)] + [(2, 7), (2, 1), (3, 2)]  # customer 1 has all, 2 has 7 and 1, 3 has 2
    tables["order_items"].load(spark.createDataFrame([(n, c, i, 1, 1.0, 1.2, 0, "false", 0) for n, (c, i) in enumerate(bought)], TYPES["order_items"] + META))
    kept = KeptSuggestions(spark, tables, tmpdir_, k=2, spare=1)
    shown = lambda: {c: [r["item_id"] for r in sorted((r for r in rows if r["customer_id"] == c), key=lambda r: r["rank"])]
                     for rows in [kept.read().collect()] for c in {r["customer_id"] for r in rows}}
    last = lambda: {r["customer_id"]: (r["floor"], r["items"]) for r in spark.read.parquet(kept.heaps.current().segments[-1].path).collect()}
    kept.heaps.compact = lambda: False
    assert kept.refresh() and shown() == {1: [7, 6], 2: [7, 1], 3: [2]} and last()[1] == (5, [7, 6, 5])
    tables["items"].append(item([7], 0, 1))
    assert kept.refresh() and last() == {1: (5, [6, 5]), 2: (None, [1])}  # a spare place is used, nothing filled anew
    tables["items"].append(item([3], 0, 2))  # nobody holds it in a heap
    assert not kept.refresh()
    tables["items"].append(item([6], 0, 3))
    assert kept.refresh() and last() == {1: (2, [5, 4, 2])}  # below k: filled from the purchases
    tables["items"].append(item([5], 9, 4))  # another quantity, still in stock
    assert not kept.refresh()
    tables["items"].append(item([7], 1, 5))
    assert kept.refresh() and last() == {1: (4, [7, 5, 4]), 2: (None, [7, 1])}
    assert shown() == {1: [7, 5], 2: [7, 1], 3: [2]}


# -- what a refresh moves -----------------------------------------------------------

def test_one_segment_is_folded_without_aggregation_and_a_merge_is_not_shuffled_again(spark, tmpdir_, monkeypatch):
    catalog.ensure_namespaces(spark)
    table = ChangeTable(spark, "staging.orders", tmpdir_, public=False, buckets=4)
    rows = spark.range(400).selectExpr("id", "id % 7 AS n", "id % 3 AS unused", "0L AS __source_ts_ms", "0L AS offset", "'false' AS __deleted")
    table.load(rows)
    monkeypatch.setattr(changes, "BUCKET_BYTES", 1)  # as if the batch were large
    table.append(rows.where("id % 2 = 0").selectExpr("id", "n + 1 AS n", "unused", "1L AS __source_ts_ms", "0L AS offset", "__deleted"))
    assert table.current().segments[-1].table
    read = table.read().select("id", "n")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "max_by" not in plan and "unused" not in plan
    want = sorted((i, i % 7 + (i % 2 == 0)) for i in range(400))
    assert sorted(map(tuple, read.collect())) == want
    assert table._laid_out(table.current().segments) and table.compact(force=True)
    (base,) = table.current().segments
    files = spark.read.parquet(base.path).inputFiles()
    assert len(files) <= 4 and sorted(map(tuple, table.read().select("id", "n").collect())) == want


def test_a_first_refresh_reads_each_source_once(spark, tmpdir_, monkeypatch):
    catalog.ensure_namespaces(spark)
    tables = {t: ChangeTable(spark, f"staging.{t}", tmpdir_, public=False, buckets=2) for t in ("orders", "order_items", "items")}
    r = random.Random(5)
    for t, table in tables.items():
        table.load(spark.createDataFrame(random_changes(r, t, 0)[0], TYPES[t] + META))
    only = []
    monkeypatch.setattr(ChangeTable, "only", lambda self, *a, **k: only.append(self.name))
    mart = KeptMart(spark, "mart_revenue_by_item", tables, tmpdir_)
    assert mart.refresh(compact=False) and not only
    assert rows_of(mart.read()) == rows_of(full("mart_revenue_by_item", tables))


@pytest.mark.parametrize("name", ["mart_payments", "mart_invoices", "mart_customer_reorders"])
def test_a_large_batch_is_taken_from_the_present_image_alone(spark, tmpdir_, monkeypatch, name):
    catalog.ensure_namespaces(spark)
    monkeypatch.setattr(incremental, "SMALL", 0)  # as if there were many rows
    r, offset = random.Random(name), 0
    sources = sorted({*KEPT[name].sources, *KEPT[name].dimensions})
    tables = {t: ChangeTable(spark, f"staging.{t}", tmpdir_, public=False, buckets=2) for t in sources}
    mart, before = KeptMart(spark, name, tables, tmpdir_), {}
    monkeypatch.setattr(ChangeTable, "only", lambda self, *a, **k: pytest.fail(f"{self.name} is read by key"))
    for k in range(4):
        for t in sources:
            for _ in range(4 if k == 0 else 1):
                rows, offset = random_changes(r, t, offset)
                tables[t].append(spark.createDataFrame(rows, TYPES[t] + META).coalesce(1))
        parts = len(mart.store.current().segments) if k else 0
        mart.refresh(compact=False)
        assert rows_of(mart.read(as_of="1970-01-03")) == rows_of(full(name, tables)), k
        if KEPT[name].kind == "latest":  # only rows that differ are written, those that are gone marked
            now = {x[mart.kept.keys[0]]: x for x in mart.store.read().where("__deleted = 'false'").collect()}
            wrote = {x[mart.kept.keys[0]]: x for s in mart.store.current().segments[parts:] for x in spark.read.parquet(s.path).collect()}
            assert {i for i, x in wrote.items() if x["__deleted"] == "true"} == set(before) - set(now)
            assert {i for i, x in wrote.items() if x["__deleted"] == "false"} == {i for i in now if before.get(i) != now[i]}
            before = now


def test_heaps_after_a_large_batch_are_made_anew(spark, tmpdir_, monkeypatch):
    catalog.ensure_namespaces(spark)
    monkeypatch.setattr(incremental, "SMALL", -1)
    monkeypatch.setattr(incremental, "LARGE", 0)
    monkeypatch.setattr(KeptSuggestions, "_changed_heaps", lambda self, *a: pytest.fail("one heap after the other"))
    r, offset = random.Random(3), 0
    tables = {t: ChangeTable(spark, f"staging.{t}", tmpdir_, public=False, buckets=2) for t in ("items", "order_items", "orders")}
    kept = KeptSuggestions(spark, tables, tmpdir_, k=2, spare=1)
    for k in range(4):
        for t in tables:
            for _ in range(4 if k == 0 else 1):
                rows, offset = random_changes(r, t, offset)
                tables[t].append(spark.createDataFrame(rows, TYPES[t] + META).coalesce(1))
        kept.refresh()
        loads = {t: dwh.LOADS[t](tables[t].read()) for t in tables}
        assert rows_of(kept.read()) == rows_of(shop.reorder_suggestions(loads["order_items"], loads["orders"], loads["items"], k=2)), k
