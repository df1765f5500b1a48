"""Plan-shape guards for the scale design, and hot-key inputs (one key with a
third of the rows) checked against brute force."""

from __future__ import annotations

import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from martforge.operators import marts, orders as orderops, shop, staging as stg
from martforge.plans import catalog


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_limits_before_the_shuffle(spark):
    pairs = spark.range(2000).select((F.col("id") % 3).alias("customer_id"), F.col("id").alias("item_id"))
    lines = pairs.select(F.col("item_id").alias("order_id"), "item_id")
    orders = pairs.select(F.col("item_id").alias("order_id"), "customer_id", F.lit("confirmed").alias("status"))
    items = pairs.select("item_id", F.lit("t").alias("title"), F.lit(1).alias("price_ttc"), F.lit(3).alias("quantity"))
    p = plan_of(shop.reorder_suggestions(lines, orders, items))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_upsert_combines_map_side(spark):
    ch = spark.range(1000).select((F.col("id") % 2).alias("id"), F.col("id").alias("offset"),
                                  F.col("id").alias("__source_ts_ms"), F.lit("x").alias("v"))
    p = plan_of(stg.latest_per_key(ch))
    assert "partial_max_by" in p


def test_bucketed_merge_shuffles_only_the_batch(spark, tmpdir_):
    catalog.ensure_namespaces(spark)
    cur = spark.range(500).select(F.col("id"), F.lit("a").alias("v"), F.col("id").alias("__source_ts_ms"),
                                  F.lit(0).cast("long").alias("offset"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    catalog.publish(spark, cur, "staging.guard", tmpdir_, bucket_by=("id", n))
    batch = spark.range(50).select(F.col("id"), F.lit("b").alias("v"), (F.col("id") + 1000).alias("__source_ts_ms"),
                                   F.lit(1).cast("long").alias("offset"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan_of(stg.merge_latest(spark.table("staging.guard"), batch))
    finally:
        from martforge.session import BROADCAST_LIMIT_BYTES
        for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.set(key, str(BROADCAST_LIMIT_BYTES))
    assert p.count("Exchange hashpartitioning") == 1   # the batch side only
    assert "Bucketed: true" in p


def _hot_lines(rnd, n=3000):
    # order 0 holds a third of all lines; customer 0 a third of the orders
    rows = []
    for i in range(n):
        order = 0 if i % 3 == 0 else rnd.randint(1, 400)
        rows.append((i, order, rnd.randint(0, 30), rnd.randint(1, 5), 10.0, 12.0))
    return rows


def test_hot_order_and_customer_marts_match_brute_force(spark):
    rnd = random.Random(3)
    lines_rows = _hot_lines(rnd)
    orders_rows = [(o, 0 if o % 3 == 0 else rnd.randint(1, 50), "confirmed" if o % 4 else "pending",
                    12.0, (pd.Timestamp("2024-01-01") + pd.Timedelta(days=o % 9)).to_pydatetime())
                   for o in range(401)]
    lines = spark.createDataFrame(lines_rows, "order_item_id long, order_id long, item_id long, quantity int, "
                                              "unit_price_ht double, unit_price_ttc double").select(
        "*", (F.col("quantity") * F.col("unit_price_ht")).cast("decimal(10,2)").alias("line_total_ht"),
        (F.col("quantity") * F.col("unit_price_ttc")).cast("decimal(10,2)").alias("line_total_ttc"))
    orders = spark.createDataFrame(orders_rows, "order_id long, customer_id long, status string, total_ttc double, "
                                                "source_updated_at timestamp").withColumn(
        "total_ttc", F.col("total_ttc").cast("decimal(10,2)"))
    daily = {r["order_date"]: (r["nb_orders"], r["units_sold"]) for r in marts.sales_daily(orders, lines).collect()}

    lp = pd.DataFrame(lines_rows, columns=["order_item_id", "order_id", "item_id", "quantity", "ht", "ttc"])
    op = pd.DataFrame(orders_rows, columns=["order_id", "customer_id", "status", "total_ttc", "ts"])
    op["ts"] = pd.to_datetime(op.ts)
    j = lp.merge(op[op.status == "confirmed"], on="order_id")
    j["day"] = j.ts.dt.date
    want = j.groupby("day").agg(n=("order_id", "nunique"), u=("quantity", "sum"))
    assert daily == {d: (r.n, r.u) for d, r in want.iterrows()}

    hist = shop.order_history(orders.withColumn("status", F.lit("confirmed")), lines,
                              spark.createDataFrame([(0, "t")], "item_id long, title string"))
    assert hist.count() == len(lp) + len(set(op.order_id) - set(lp.order_id))


def test_hot_item_allocation_has_no_unkeyed_window(spark):
    reqs = spark.range(3000).select(F.col("id").alias("request_id"), F.lit(1).cast("long").alias("customer_id"),
                                    F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("item_id"),
                                    F.lit(1).alias("quantity"), F.col("id").alias("arrival"))
    items = spark.range(7).select(F.col("id").alias("item_id"), F.lit(500).alias("quantity"),
                                  F.lit(1).cast("decimal(10,2)").alias("price_ht"),
                                  F.lit(1).cast("decimal(10,2)").alias("price_ttc"))
    lines = orderops.allocate_orders(reqs, items, width=256)
    assert "SinglePartition" not in plan_of(lines)
    got = {r["item_id"]: r["s"] for r in lines.groupBy("item_id").agg(F.sum("quantity").alias("s")).collect()}
    assert got[0] == 500   # 1000 requests for the hot item, stock 500


HOT = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
       "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.autoBroadcastJoinThreshold": "-1",
       "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture()
def hot_order(spark, tmpdir_):
    """Published tables whose lines belong to one order by a third, written as
    several files (one file is one map task, which AQE can't split)."""
    lines = spark.range(0, 6000, 1, 8).select(
        F.col("id").alias("order_item_id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 400).alias("order_id"),
        (F.col("id") * 7919 % 900).alias("item_id"), F.lit(1).alias("quantity"), F.lit(2).cast("decimal(10,2)").alias("unit_price_ttc"),
        F.lit(2).cast("decimal(20,2)").alias("line_total_ht"), F.lit(2).cast("decimal(20,2)").alias("line_total_ttc"))
    orders = spark.range(0, 400, 1, 4).select(
        F.col("id").alias("order_id"), (F.col("id") % 50).alias("customer_id"), F.lit("confirmed").alias("status"),
        F.lit(1).cast("decimal(10,2)").alias("total_ttc"), F.current_timestamp().alias("source_updated_at"))
    items = spark.range(900).select(F.col("id").alias("item_id"), F.lit("t").alias("title"), F.lit(1).cast("decimal(10,2)").alias("price_ht"),
                                    F.lit(1).cast("decimal(10,2)").alias("price_ttc"), F.lit(20).cast("decimal(5,2)").alias("tva_rate"), F.lit(5).alias("quantity"))
    from martforge.plans import catalog
    catalog.ensure_namespaces(spark)
    for name, df in (("order_items", lines), ("orders", orders), ("items", items)):
        catalog.publish(spark, df, f"dwh.hot_{name}", tmpdir_)
    old = {k: spark.conf.get(k, None) for k in HOT}
    for k, v in HOT.items():
        spark.conf.set(k, v)
    yield tuple(spark.table(f"dwh.hot_{t}") for t in ("orders", "order_items", "items"))
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("read", ["order_history", "revenue_by_item", "customer_reorders"])
def test_hot_order_over_published_tables_is_split(hot_order, read):
    orders, lines, items = hot_order
    build = {"order_history": lambda: shop.order_history(orders, lines, items), "revenue_by_item": lambda: marts.revenue_by_item(items, lines, orders),
             "customer_reorders": lambda: marts.customer_reorders(lines, orders, items)}[read]
    assert "skew=true" in final_plan(build())


def test_bucketed_version_has_a_file_per_bucket_at_most(spark, tmpdir_):
    import glob
    from martforge.plans import catalog
    catalog.ensure_namespaces(spark)
    path = catalog.publish(spark, spark.range(0, 10_000, 1, 8), "staging.many_tasks", tmpdir_, bucket_by=("id", 6))
    assert len(glob.glob(path + "/part-*")) <= 6


def test_prefix_sum_window_is_keyed_by_chunk(spark):
    reqs = spark.range(1000).select(F.col("id").alias("request_id"), F.lit(1).cast("long").alias("customer_id"),
                                    (F.col("id") % 3).alias("item_id"), F.lit(1).alias("quantity"),
                                    F.col("id").alias("arrival"))
    items = spark.range(3).select(F.col("id").alias("item_id"), F.lit(10).alias("quantity"),
                                  F.lit(1).cast("decimal(10,2)").alias("price_ht"),
                                  F.lit(1).cast("decimal(10,2)").alias("price_ttc"))
    p = plan_of(orderops.allocate_orders(reqs, items, width=64))
    assert re.search(r"Exchange hashpartitioning\(item_id#\d+L?, __chunk#\d+L?", p)


def test_purchased_items_are_distinct_before_the_semi_join(spark):
    from martforge.operators import shop
    lines = spark.range(100).select(F.col("id").alias("order_id"), (F.col("id") % 3).alias("item_id"))
    orders = spark.range(100).select(F.col("id").alias("order_id"), F.lit("confirmed").alias("status"))
    items = spark.range(3).select(F.col("id").alias("item_id"), F.lit(1).alias("quantity"))
    p = plan_of(shop.purchased_in_stock(items, lines, orders))
    assert re.search(r"HashAggregate\(keys=\[item_id#\d+L\], functions=\[\]", p)
