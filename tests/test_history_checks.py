"""Bloom filters of change tables and the checks kept through them: against full checks after random batches."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from martforge.operators import dwh, quality
from martforge.plans import catalog
from martforge.plans.changes import ChangeTable
from martforge.plans.history import Filters, hash_of, kept_checks, mask_of, words_for

from .test_changes import META, TYPES, random_changes, rows_of

CHECKED = ("customers", "invoices", "items", "orders", "order_items", "payments")
UNIQUE = {"invoices.order_id": ("invoices", "order_id"), "payments.order_id": ("payments", "order_id")}
FOREIGN = {"orders.customer_id": ("orders", "customer_id", "customers"), "order_items.item_id": ("order_items", "item_id", "items"),
           "payments.order_id": ("payments", "order_id", "orders")}


@pytest.mark.parametrize("seed", [1, 2])
def test_kept_checks_equal_the_full_ones_after_random_batches(spark, tmpdir_, seed):
    catalog.ensure_namespaces(spark)
    r, offset = random.Random(seed), 0
    tables = {t: ChangeTable(spark, f"staging.{t}", tmpdir_, public=False, buckets=2) for t in CHECKED}
    checks = kept_checks(spark, tables, tmpdir_, UNIQUE, FOREIGN)
    found = 0
    for k in range(3):
        for t in CHECKED:
            if k and r.random() < 0.3:
                continue
            rows, offset = random_changes(r, t, offset)
            tables[t].append(spark.createDataFrame(rows, TYPES[t] + META).coalesce(1))
            if r.random() < 0.4:
                tables[t].compact(force=True)
            tables[t].versions.vacuum(keep=1)  # the seen versions are held
        for check in checks:
            check.refresh()
        loads = {t: dwh.LOADS[t](tables[t].read()) for t in CHECKED}
        full = {**{t: loads["customers"].limit(0) for t in ("admins",)}, **loads}
        want = rows_of(quality.dq_unique(full).where(F.col("check").isin(*UNIQUE))) + rows_of(quality.dq_foreign_keys(full).where(F.col("check").isin(*FOREIGN)))
        got = [row for n in range(2) for row in rows_of(_union([c.read() for c in (checks[:2], checks[2:])[n]]))]
        assert got == want, k
        found += len(want)
    assert found and not any(check.refresh() for check in checks)  # nothing new
    assert {len(table.versions.leased()) for table in tables.values()} == {1}


def _union(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def test_a_filter_passes_all_it_has_taken_and_few_others(spark):
    held = spark.range(20_000).select((F.col("id") * 7).alias("v"))
    words = F.lit(words_for(20_000))
    bits = held.select(hash_of(F.col("v"), "bigint").alias("h")).groupBy(F.pmod("h", words).alias("word")).agg(F.bit_or(mask_of(F.col("h"))).alias("bits"))
    asked = spark.range(140_000).select("id", hash_of(F.col("id").cast("string").cast("int"), "int").alias("h"))  # of another width
    passed = asked.withColumn("m", mask_of(F.col("h"))).withColumn("word", F.pmod("h", words)).join(bits, "word").where(F.col("bits").bitwiseAND(F.col("m")) == F.col("m"))
    right, wrong = passed.agg(F.count_if(F.col("id") % 7 == 0), F.count_if(F.col("id") % 7 != 0)).first()
    assert right == 20_000 and wrong < 0.01 * 120_000


def _emails(spark, ids, at=0, name=None):
    return spark.createDataFrame([], TYPES["customers"] + META).unionByName(
        ids.select("id", (F.lit(name) if name else F.concat(F.lit("m"), F.col("id").cast("string"))).alias("email"), F.lit("false").alias("__deleted"),
                   F.lit(at).cast("long").alias("__source_ts_ms"), F.lit(at).cast("long").alias("offset")), allowMissingColumns=True)


def test_only_files_that_pass_the_filters_are_read(spark, tmpdir_):
    """32 files; a batch of new values reads next to none, one of held values those that hold them, and no row of history is shuffled by the question."""
    catalog.ensure_namespaces(spark)
    table = ChangeTable(spark, "staging.customers", tmpdir_, public=False, buckets=32)
    table.load(_emails(spark, spark.range(8000)))
    filters = Filters(table, ["email"])
    assert filters.index(table.current()) == 1 and filters.index(table.current()) == 0
    now = table.current()
    files = [n for n in filters.files.names(now.segments[0].path) if n.endswith(".parquet")]
    assert len(files) == 32
    ask = lambda *v: spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{x}')" for x in v) + ", (NULL) AS t(v)")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
    fresh = filters.rows_with(ask(*[f"new{k}" for k in range(20)]), "email", ["id"], now)
    assert fresh.count() == 0 and len(fresh.inputFiles()) <= 4
    held = filters.rows_with(ask("m17", "m4000"), "email", ["id"], now)
    assert sorted(r["id"] for r in held.collect()) == [17, 4000]
    assert 1 <= len(held.inputFiles()) <= 4  # of 32
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    ids = filters.images(spark.createDataFrame([(17,), (99999,)], "id long"), ["email"], now)
    assert [tuple(x) for x in ids.collect()] == [(17, "m17")]


def test_a_repair_clears_a_violation_and_filters_follow_compaction(spark, tmpdir_):
    catalog.ensure_namespaces(spark)
    table = ChangeTable(spark, "staging.customers", tmpdir_, public=False, buckets=4)
    (check,) = kept_checks(spark, {"customers": table}, tmpdir_, {"customers.email": ("customers", "email")}, {})
    table.load(_emails(spark, spark.range(100)))
    assert check.refresh() and check.read().count() == 0
    table.append(_emails(spark, spark.range(200, 202), 1, "m5"))
    assert check.refresh() and [tuple(x) for x in check.read().collect()] == [("customers.email", "m5", 3)]
    # the value leaves two rows; the image it is in is gone from the newest files
    table.append(_emails(spark, spark.range(200, 202), 2))
    table.compact(force=True)
    table.versions.vacuum(keep=1)
    assert check.refresh() and check.read().count() == 0
    rows = {r["key"]: r["n"] for r in check.store.read().collect()}
    assert rows == {"m5": 1, "m200": 1, "m201": 1}  # the touched values alone are stored
    table.versions.vacuum(keep=1)
    check.filters["customers"].prune()
    assert set(check.filters["customers"].files.names(check.filters["customers"].folder)) <= set(table.versions.files.names(f"{table.versions.folder}/data"))


def test_a_filter_is_built_when_it_is_asked(spark, tmpdir_):
    catalog.ensure_namespaces(spark)
    table = ChangeTable(spark, "staging.customers", tmpdir_, public=False, buckets=8)
    (check,) = kept_checks(spark, {"customers": table}, tmpdir_, {"customers.email": ("customers", "email")}, {})
    filters = check.filters["customers"]
    built = lambda: [sorted(n for n in filters.files.names(filters._home(s)) if n.endswith(".json")) for s in table.current().segments]
    table.load(_emails(spark, spark.range(1000)))
    assert check.refresh() and built() == [[]]  # all rows are looked at
    table.append(_emails(spark, spark.range(1000), 1))
    assert check.refresh() and built() == [["id.json"]] * 2  # the keys, which most files hold
    table.append(_emails(spark, spark.range(5, 6), 2, "m7"))
    assert check.refresh() and built() == [["email.json", "id.json"]] * 3
    assert [tuple(x) for x in check.read().collect()] == [("customers.email", "m7", 2)]


def test_columns_of_nulls_missing_columns_and_empty_tables(spark, tmpdir_):
    catalog.ensure_namespaces(spark)
    tables = {t: ChangeTable(spark, f"staging.{t}", tmpdir_, public=False, buckets=2) for t in ("customers", "orders")}
    checks = kept_checks(spark, tables, tmpdir_, {"customers.email": ("customers", "email")}, {"orders.customer_id": ("orders", "customer_id", "customers")})
    tables["customers"].load(_emails(spark, spark.range(0)))
    tables["orders"].load(spark.createDataFrame([(1, None, "x", 1.0, 1.0, 0, None, 0)], TYPES["orders"] + META))
    assert all(c.refresh() for c in checks) and [r["id"] for r in checks[1].read().collect()] == [1]
    tables["customers"].append(_emails(spark, spark.range(3), 1).drop("email"))  # a batch without the column
    tables["orders"].append(spark.createDataFrame([(1, 2, "x", 1.0, 1.0, 1, None, 1), (2, 9, "x", 1.0, 1.0, 1, None, 1)], TYPES["orders"] + META))
    assert all(c.refresh() for c in checks)
    assert checks[0].read().count() == 0 and [tuple(r)[1:] for r in checks[1].read().collect()] == [(2, 9)]
    tables["customers"].append(_emails(spark, spark.range(9, 10), 2))  # the parent comes
    assert checks[1].refresh() and checks[1].read().count() == 0


def test_a_batch_that_touches_most_files_takes_one_pass(spark, tmpdir_, monkeypatch):
    catalog.ensure_namespaces(spark)
    tables = {t: ChangeTable(spark, f"staging.{t}", tmpdir_, public=False, buckets=2) for t in ("orders", "payments")}
    row = "id, id AS order_id, CAST(1 AS double) AS amount, 'x' AS status, 'c' AS payment_method, 't' AS transaction_id, 0L AS offset, 'false' AS __deleted"
    tables["orders"].load(spark.range(100).selectExpr("id", "id AS customer_id", "'A' AS status", "0L AS __source_ts_ms", "0L AS offset", "'false' AS __deleted"))
    tables["payments"].load(spark.range(100).selectExpr(*row.split(", "), "0L AS __source_ts_ms"))
    checks = kept_checks(spark, tables, tmpdir_, {"p": ("payments", "order_id")}, {"p": ("payments", "order_id", "orders")})
    for check in checks:
        check.refresh()
        monkeypatch.setattr(check, "_again", None)  # would ask the filters row by row
    # every second one twice, some without a parent; then all as before
    for k, order in ((1, "id - id % 2 + CASE WHEN id < 10 THEN 1000 ELSE 0 END"), (2, "id")):
        tables["payments"].append(spark.range(100).selectExpr(*row.replace("id AS order_id", f"{order} AS order_id").split(", "), f"{k}L AS __source_ts_ms"))
        assert all([check.refresh() for check in checks])
        twice, lost = (check.read().collect() for check in checks)
        assert len(twice) == (50 if k == 1 else 0) and sorted(r["id"] for r in lost) == (list(range(10)) if k == 1 else [])
