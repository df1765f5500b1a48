"""Refresh pipeline: guarded rebuilds, barrier, atomic publish."""

from __future__ import annotations

from pyspark.sql import functions as F

from martforge.operators import dwh, marts
from martforge.plans import catalog, refresh
from martforge.sources import testdata as td

from .conftest import SF_SMALL


def test_refresh_builds_all_tables(spark, tmpdir_):
    refresh.publish_staging(spark, td.staging(spark, SF_SMALL), root=tmpdir_)
    built = refresh.refresh(spark, root=tmpdir_, as_of="1997-01-01")
    assert all(built.values()), built
    assert len(built) == 13
    # published tables equal the operators run directly
    direct = marts.sales_daily(dwh.load_orders(td.staging_orders(spark, SF_SMALL)),
                               dwh.load_order_items(td.staging_order_items(spark, SF_SMALL)))
    assert sorted(spark.table("dmart.mart_sales_daily").collect()) == sorted(direct.collect())
    # a second refresh swaps to the next version and keeps the same content
    before = spark.table("dmart.mart_customer_lifetime").count()
    version = catalog.current_version(spark, "dmart.mart_customer_lifetime")
    refresh.refresh(spark, root=tmpdir_, as_of="1997-01-01")
    assert spark.table("dmart.mart_customer_lifetime").count() == before
    assert catalog.current_version(spark, "dmart.mart_customer_lifetime") == version + 1


def test_missing_source_leaves_target_absent(spark, tmpdir_):
    catalog.ensure_namespaces(spark)
    for t in ("customers", "orders", "invoices"):
        catalog.drop(spark, f"staging.{t}")
        catalog.drop(spark, f"dwh.{t}")
    catalog.publish(spark, td.staging_orders(spark, SF_SMALL), "staging.orders", tmpdir_)
    assert catalog.rebuild_table(spark, "dwh.orders", ["staging.orders"], dwh.load_orders, tmpdir_)
    assert not catalog.rebuild_table(spark, "dwh.customers", ["staging.customers"], dwh.load_customers, tmpdir_)
    assert not spark.catalog.tableExists("dwh.customers")
    ok = catalog.rebuild_table(spark, "dmart.mart_invoices", ["dwh.invoices", "dwh.orders", "dwh.customers"],
                               marts.invoices, tmpdir_)
    assert not ok and not spark.catalog.tableExists("dmart.mart_invoices")


def test_barrier_stops_marts_when_a_load_fails(spark, tmpdir_):
    refresh.publish_staging(spark, td.staging(spark, SF_SMALL), root=tmpdir_)
    # a staging table whose columns do not fit the load makes that load fail
    bad = spark.range(3).select(F.col("id"), F.lit("x").alias("__deleted"))
    catalog.publish(spark, bad, "staging.items", tmpdir_)
    for m in marts.MARTS:
        catalog.drop(spark, f"dmart.{m}")
    try:
        refresh.refresh(spark, root=tmpdir_, retries=0)
        raised = False
    except Exception:
        raised = True
    assert raised
    assert not any(spark.catalog.tableExists(f"dmart.{m}") for m in marts.MARTS)


def test_publish_swaps_atomically_and_removes_old_versions(spark, tmpdir_):
    catalog.ensure_namespaces(spark)
    catalog.drop(spark, "dmart.rotation")
    store = catalog.versions(spark, "dmart.rotation", tmpdir_)
    for i in range(4):
        path = catalog.publish(spark, spark.range(i + 1), "dmart.rotation", tmpdir_, keep=2)
        assert catalog.current_version(spark, "dmart.rotation") == i + 1
        assert spark.table("dmart.rotation").count() == i + 1   # the view always shows a complete version
    assert store.numbers() == [3, 4] and len(store.files.names(f"{store.folder}/data")) == 2 and path.startswith(store.folder)


def test_a_reader_outlives_five_rebuilds(spark, tmpdir_):
    catalog.ensure_namespaces(spark)
    catalog.drop(spark, "dmart.held")
    store = catalog.versions(spark, "dmart.held", tmpdir_)
    catalog.publish(spark, spark.range(10), "dmart.held", tmpdir_, bucket_by=("id", 2))
    with catalog.reading(spark, "dmart.held", tmpdir_) as held:
        for i in range(5):
            catalog.publish(spark, spark.range(100 + i), "dmart.held", tmpdir_, bucket_by=("id", 2))
        assert held.count() == 10 and store.numbers() == [1, 5, 6]
    catalog.publish(spark, spark.range(3), "dmart.held", tmpdir_, bucket_by=("id", 2))
    assert store.numbers() == [6, 7] and len(store.files.names(f"{store.folder}/data")) == 2
    assert sum(t.name.startswith("held__") for t in spark.catalog.listTables("dmart")) == 2
