"""Registered queries: (spark, sf_dir) -> DataFrame, one per operator.

Each builds the stand-in staging input from the provided tables
(``sources.testdata``) and runs the library operator on it, over whole
tables.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import carts as cartops
from .operators import customers as custops
from .operators import dwh, marts, quality, shop
from .operators import orders as orderops
from .operators import staging as stg
from .plans import catalog as cat
from .plans import refresh as refr
from .plans.changes import ChangeTable
from .plans.history import FOREIGN, UNIQUE, kept_checks
from .plans.incremental import KEPT, KeptMart
from .plans.suggestions import KeptSuggestions
from .schemas import row_schema
from .session import RUNTIME_PERF_CONF, configure, materialise, scratch_path, ship_package, spread
from .sources import cdc
from .sources import testdata as td
from .streaming.allocation import StockLedger, start_allocation
from .streaming.cart_state import cart_state_stream
from .streaming.cart_table import CartTable, start_cart_table
from .streaming.cdc_stream import ingest_batch, staging_table, start_cdc_stream
from .streaming.chunk_copy import POSITION, ChangeLog, ChunkCopy

# Arrivals per chunk of running values: many chunks per key on every input.
RUN_WIDTH = 4096
AS_OF = "1997-01-01"  # fixed as-of date for compared runs (oracle uses the same)

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(spark, sf_dir)
        run.__name__ = name
        run.__doc__ = fn.__doc__
        REGISTRY[name] = run
        return fn
    return deco


def dwh_table(spark, sf_dir, table: str) -> DataFrame:
    """Cleaned table built from its stand-in staging table."""
    return dwh.LOADS[table](td.STAGING_BUILDERS[table](spark, sf_dir))


def _dwh_query(table):
    def q(spark, sf_dir):
        return dwh_table(spark, sf_dir, table)
    q.__doc__ = f"Cleaning load of staging.{table} into dwh.{table}."
    return q


for _t in dwh.LOADS:
    register(f"dwh_{_t}")(_dwh_query(_t))


def _mart_query(name):
    fn, sources = marts.MARTS[name]

    def q(spark, sf_dir):
        args = [dwh_table(spark, sf_dir, s) for s in sources]
        if name == "mart_invoices":
            return fn(*args, as_of=AS_OF)
        return fn(*args)
    q.__doc__ = fn.__doc__
    return q


for _m in marts.MARTS:
    register(_m)(_mart_query(_m))


# --- change capture and staging ------------------------------------------------

@register("cdc_unwrap")
def q_cdc_unwrap(spark, sf_dir):
    """Flatten before/after change envelopes into row images + metadata."""
    return cdc.unwrap(td.change_envelopes(spark, sf_dir))


@register("cdc_decode")
def q_cdc_decode(spark, sf_dir):
    """Decode JSON-with-schema change values, then flatten them."""
    return cdc.unwrap(cdc.decode(td.change_wire(spark, sf_dir), td.EVENT_ROW))


@register("cdc_route")
def q_cdc_route(spark, sf_dir):
    """Route change topics to table names; other topics are dropped."""
    return cdc.route(cdc.unwrap(td.change_envelopes(spark, sf_dir)))


@register("staging_upsert")
def q_staging_upsert(spark, sf_dir):
    """Latest row per key of the whole change log (soft deletes kept)."""
    return stg.latest_per_key(td.change_log(spark, sf_dir))


_FIRST_BATCH_OPS = ("c", "d")  # creates and deletes arrive first, updates later


def _two_batches(spark, sf_dir):
    log = td.change_log(spark, sf_dir)
    first_batch = F.col("__op").isin(*_FIRST_BATCH_OPS)
    return log.filter(first_batch), log.filter(~first_batch)


@register("staging_merge")
def q_staging_merge(spark, sf_dir):
    """Upsert a second change batch into the table built from the first."""
    first, later = _two_batches(spark, sf_dir)
    return stg.merge_latest(stg.latest_per_key(first), later)


@register("schema_evolve")
def q_schema_evolve(spark, sf_dir):
    """Upsert a batch that brings a new column (props) into a table without it."""
    first, later = _two_batches(spark, sf_dir)
    return stg.merge_latest(stg.latest_per_key(first.drop("props")), later)


@register("cdc_bad_records")
def q_cdc_bad_records(spark, sf_dir):
    """Change records of which some are cut off and some hold text where a
    number belongs: those that can't be decoded, with their offsets, beside
    the decoded and unwrapped ones."""
    wire = td.spoiled_wire(spark, sf_dir)
    decoded = cdc.decode(wire, td.EVENT_ROW, bad="mark")
    good = cdc.unwrap(decoded.filter(F.col(cdc.BAD).isNull()).drop(cdc.BAD))
    return (decoded.filter(F.col(cdc.BAD).isNotNull()).select("offset", F.lit("rejected").alias("outcome"))
            .unionByName(good.select("offset", F.lit("decoded").alias("outcome"))))


@register("cdc_snapshot_then_stream")
def q_snapshot_then_stream(spark, sf_dir):
    """Initial copy of customers (op r rows) followed by the change log, both
    upserted in one batch (the streaming form is ``snapshot_then_stream``)."""
    snap = td.staging_customers(spark, sf_dir).select(
        "id", "email", "__ts_ms", "__source_ts_ms")
    changes = td.change_log(spark, sf_dir)
    return stg.latest_per_key(stg.bootstrap(snap, changes))


# --- shop reads, orders, carts, customers, checks --------------------------------
ISSUED_AT = "2024-06-30 10:00:00"  # fixed issue time for compared runs
CART_AS_OF = "2024-02-05 00:00:00"  # fixed as-of time for compared runs


def _dwh(spark, sf_dir, *names):
    return [dwh_table(spark, sf_dir, n) for n in names]


def _all_dwh(spark, sf_dir):
    return {t: dwh_table(spark, sf_dir, t) for t in dwh.LOADS}


@register("catalog_in_stock")
def q_catalog_in_stock(spark, sf_dir):
    """Items with stock > 0, newest id first."""
    return shop.catalog_in_stock(*_dwh(spark, sf_dir, "items"))


@register("items_by_newest")
def q_items_by_newest(spark, sf_dir):
    """All items, newest id first."""
    return shop.items_by_newest(*_dwh(spark, sf_dir, "items"))


@register("reorder_suggestions")
def q_reorder_suggestions(spark, sf_dir):
    """Top 8 in-stock items (id desc) each customer bought in confirmed orders."""
    return shop.reorder_suggestions(*_dwh(spark, sf_dir, "order_items", "orders", "items"))


@register("purchased_in_stock")
def q_purchased_in_stock(spark, sf_dir):
    """In-stock items bought at least once in a confirmed order."""
    return shop.purchased_in_stock(*_dwh(spark, sf_dir, "items", "order_items", "orders"))


@register("order_history")
def q_order_history(spark, sf_dir):
    """Orders with their lines and item titles, newest first per customer."""
    return shop.order_history(*_dwh(spark, sf_dir, "orders", "order_items", "items"))


@register("customer_payments")
def q_customer_payments(spark, sf_dir):
    """Payments with the owning customer, newest first."""
    return shop.customer_payments(*_dwh(spark, sf_dir, "payments", "orders"))


@register("customer_invoices")
def q_customer_invoices(spark, sf_dir):
    """Invoices with the owning customer, newest first."""
    return shop.customer_invoices(*_dwh(spark, sf_dir, "invoices", "orders"))


@register("invoice_lines")
def q_invoice_lines(spark, sf_dir):
    """Printable document rows of every invoice."""
    return shop.invoice_lines(*_dwh(spark, sf_dir, "invoices", "orders", "order_items", "items"))


@register("order_confirmation")
def q_order_confirmation(spark, sf_dir):
    """Confirmation pages for owner-checked (order, customer) requests."""
    orders, lines, items = _dwh(spark, sf_dir, "orders", "order_items", "items")
    return shop.order_confirmation(td.confirmation_requests(spark, sf_dir), orders, lines, items)


@register("item_pricing")
def q_item_pricing(spark, sf_dir):
    """Price incl. VAT recomputed from HT and VAT rate for every staged item."""
    return shop.item_pricing(td.staging_items(spark, sf_dir))


@register("cart_parse")
def q_cart_parse(spark, sf_dir):
    """JSON cart cookies -> (cart, item, quantity) entries."""
    return shop.cart_parse(td.carts(spark, sf_dir))


@register("cart_count")
def q_cart_count(spark, sf_dir):
    """Item count per cart (0 when malformed)."""
    return shop.cart_count(td.carts(spark, sf_dir))


@register("cart_count_raw")
def q_cart_count_raw(spark, sf_dir):
    """Catalogue badge per cart: sum of the raw JSON values (0 when malformed)."""
    return shop.cart_count_raw(td.carts(spark, sf_dir))


@register("cart_pricing")
def q_cart_pricing(spark, sf_dir):
    """Cart lines priced against live items; TTC total per cart."""
    return shop.cart_pricing(td.carts(spark, sf_dir), *_dwh(spark, sf_dir, "items"))


@register("checkout_summary")
def q_checkout_summary(spark, sf_dir):
    """HT and TTC totals per cart at checkout."""
    return shop.checkout_summary(td.carts(spark, sf_dir), *_dwh(spark, sf_dir, "items"))


def _allocation(spark, sf_dir):
    reqs = td.order_requests(spark, sf_dir)
    items = dwh_table(spark, sf_dir, "items")
    return reqs, items, orderops.allocate_orders(reqs, items, width=RUN_WIDTH)


@register("allocate_orders")
def q_allocate_orders(spark, sf_dir):
    """Stock allocation of order requests in arrival order."""
    return _allocation(spark, sf_dir)[2]


@register("order_totals")
def q_order_totals(spark, sf_dir):
    """Order totals from allocated lines (zero when nothing valid)."""
    reqs, _, lines = _allocation(spark, sf_dir)
    return orderops.order_totals(reqs, lines)


@register("stock_after_orders")
def q_stock_after_orders(spark, sf_dir):
    """Remaining stock per item after allocation."""
    _, items, lines = _allocation(spark, sf_dir)
    return orderops.stock_after_orders(items, lines)


@register("derive_payments")
def q_derive_payments(spark, sf_dir):
    """One completed payment per allocated order."""
    reqs, _, lines = _allocation(spark, sf_dir)
    return orderops.derive_payments(orderops.order_totals(reqs, lines))


@register("derive_invoices")
def q_derive_invoices(spark, sf_dir):
    """One invoice per allocated order, issued at a fixed time."""
    reqs, _, lines = _allocation(spark, sf_dir)
    return orderops.derive_invoices(orderops.order_totals(reqs, lines), issued_at=ISSUED_AT)


@register("cart_state_batch")
def q_cart_state_batch(spark, sf_dir):
    """Cart contents folded from cart actions, as of a fixed time."""
    return cartops.cart_state(td.cart_events(spark, sf_dir), dwh_table(spark, sf_dir, "items"), as_of=CART_AS_OF)


@register("profile_normalise")
def q_profile_normalise(spark, sf_dir):
    """Trim profile fields; blank phone/address -> NULL."""
    return custops.profile_normalise(td.profile_edits(spark, sf_dir))


@register("register_new_customers")
def q_register_new_customers(spark, sf_dir):
    """Sign-ups accepted: e-mail not taken, first arrival per e-mail."""
    return custops.register_new_customers(dwh_table(spark, sf_dir, "customers"),
                                          td.customer_candidates(spark, sf_dir))


@register("item_changes")
def q_item_changes(spark, sf_dir):
    """Admin item actions -> change rows, upserted into staging items."""
    current = td.staging_items(spark, sf_dir)
    changes = custops.item_changes(td.item_actions(spark, sf_dir), current)
    return stg.merge_latest(current.withColumn("offset", F.lit(-1).cast("long")), changes)


@register("payment_labels")
def q_payment_labels(spark, sf_dir):
    """Customer-facing payment method / status / transaction labels."""
    return quality.payment_labels(dwh_table(spark, sf_dir, "payments"))


@register("order_status_label")
def q_order_status_label(spark, sf_dir):
    """Capitalised order status."""
    return quality.order_status_labels(dwh_table(spark, sf_dir, "orders"))


@register("stock_level")
def q_stock_level(spark, sf_dir):
    """Stock badge per item (out / low / ok) and VAT shown as an integer."""
    return quality.stock_levels(dwh_table(spark, sf_dir, "items"))


def _check_query(check):
    def q(spark, sf_dir):
        spread(spark, [f"{sf_dir}/{t}.parquet" for t in ("customer", "supplier", "part", "orders", "lineitem")])
        return check(_all_dwh(spark, sf_dir))
    q.__doc__ = check.__doc__
    return q


for _check in (quality.dq_unique, quality.dq_foreign_keys, quality.dq_not_null, quality.dq_domains,
               quality.dq_reconcile):
    register(_check.__name__)(_check_query(_check))


# --- whole pipeline runs (write tables under the session's shared folder) --------

def _run_folder(spark, name: str) -> str:
    """A folder of this run's own, removed when the application ends."""
    return scratch_path(spark, f"run-{name}")


@register("refresh_pipeline")
def q_refresh_pipeline(spark, sf_dir):
    """Publish the staging snapshot, run the full refresh (7 loads -> barrier
    -> 6 marts) into a fresh folder, and report each published table's rows."""
    root = _run_folder(spark, "refresh")
    refr.publish_staging(spark, td.staging(spark, sf_dir), root=root)
    built = refr.refresh(spark, root=root, as_of=AS_OF, retries=0)
    counts = [spark.table(t).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows")
              for t, ok in sorted(built.items()) if ok]
    return reduce(lambda a, b: a.unionByName(b), counts)


STREAM_TABLES = ("click", "view", "purchase", "signup")


@register("cdc_stream_ingest")
def q_cdc_stream_ingest(spark, sf_dir):
    """Change events written as JSON files, ingested by the streaming job
    (route -> decode -> unwrap -> foreachBatch upsert into versioned staging);
    returns the staging tables the stream built."""
    base = _run_folder(spark, "stream")
    td.change_wire(spark, sf_dir).write.mode("overwrite").json(os.path.join(base, "in"))
    row = td.EVENT_ROW
    cat.ensure_namespaces(spark)
    for t in STREAM_TABLES:
        cat.drop(spark, f"staging.{t}")
    q = start_cdc_stream(spark, cdc.cdc_source(spark, fmt="json", path=os.path.join(base, "in"), tables=STREAM_TABLES),
                         root=os.path.join(base, "wh"), checkpoint=os.path.join(base, "ckpt"), available_now=True,
                         tables=STREAM_TABLES, schemas={t: row for t in STREAM_TABLES},
                         query_name=f"ingest_{uuid.uuid4().hex[:8]}")
    q.awaitTermination()
    return reduce(lambda a, b: a.unionByName(b),
                  [spark.table(f"staging.{t}").withColumn("table", F.lit(t)) for t in STREAM_TABLES])


@register("cart_state_stream")
def q_cart_state_stream(spark, sf_dir):
    """Cart actions written as files, folded by the streaming
    ``transformWithState`` job (7-day event-time timers, watermark at the
    latest action); its change log is reduced to the final cart contents."""
    base = _run_folder(spark, "carts")
    actions = td.cart_events(spark, sf_dir)
    actions.write.mode("overwrite").parquet(os.path.join(base, "in"))
    out = os.path.join(base, "out")

    def sink(df, batch_id):
        df.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out)

    # the state store that transformWithState needs
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", RUNTIME_PERF_CONF["spark.sql.streaming.stateStore.providerClass"])
    ship_package(spark)
    stream = spark.readStream.schema(actions.schema).parquet(os.path.join(base, "in"))
    q = (cart_state_stream(stream, dwh_table(spark, sf_dir, "items")).writeStream.outputMode("update")
         .foreachBatch(sink).option("checkpointLocation", os.path.join(base, "ckpt")).trigger(availableNow=True)
         .start())
    q.awaitTermination()
    changes = spark.read.parquet(out)
    last = changes.groupBy("cart_id", "item_id").agg(
        F.max_by(F.col("quantity"), F.struct("batch_id", "ts")).alias("quantity"))
    return last.filter(F.col("quantity").isNotNull())


def _in_arrival_batches(rows, folder: str, start) -> None:
    """Run a stream to completion on each third of ``rows`` by arrival, one
    after the other under one checkpoint. ``start(stream)`` starts it."""
    spark = rows.sparkSession
    low, high = rows.agg(F.min("arrival"), F.max("arrival")).first()
    low, high = (0, 0) if low is None else (low, high)
    third = F.least(F.lit(2), F.floor((F.col("arrival") - low) * 3 / (high - low + 1)))
    for k in range(3):
        rows.filter(third == k).write.mode("append").parquet(folder)
        start(spark.readStream.schema(rows.schema).parquet(folder)).awaitTermination()


@register("cart_state_table")
def q_cart_state_table(spark, sf_dir):
    """Cart actions in three batches by arrival, each one reduced to maps that
    are applied to the state table by a stream; the final cart contents."""
    base = _run_folder(spark, "cart-table")
    carts = CartTable(spark, "staging.cart_state", base, width=RUN_WIDTH)
    items = dwh_table(spark, sf_dir, "items")
    _in_arrival_batches(td.cart_events(spark, sf_dir), os.path.join(base, "in"),
                        lambda stream: start_cart_table(spark, stream, items, carts, os.path.join(base, "ckpt"), available_now=True))
    return carts.read(as_of=CART_AS_OF)


@register("allocate_orders_stream")
def q_allocate_orders_stream(spark, sf_dir):
    """Order requests in three batches by arrival, allotted by a stream from a
    ledger of one share; the order lines."""
    base = _run_folder(spark, "allocation")
    items = dwh_table(spark, sf_dir, "items")
    ledger = StockLedger(spark, "staging.stock", base, width=RUN_WIDTH)
    ledger.restock(items.select("item_id", F.col("quantity").alias("units")), "opening")
    _in_arrival_batches(td.order_requests(spark, sf_dir), os.path.join(base, "in"),
                        lambda stream: start_allocation(spark, stream, items, ledger, checkpoint=os.path.join(base, "ckpt"), available_now=True))
    return ledger.lines()


# --- change tables and kept marts ----------------------------------------------

def _change_tables(spark, names, public: bool = False) -> tuple[str, dict[str, ChangeTable]]:
    cat.ensure_namespaces(spark)
    root = _run_folder(spark, "changes")
    return root, {t: ChangeTable(spark, f"staging.{t}", root, public=public) for t in names}


def _take_batch(tables, batches, k: int) -> None:
    """The k-th batch of each table; the last one is followed by a compaction."""
    for t, table in tables.items():
        if k == 0:
            table.load(batches[t][0])
        else:
            table.append(batches[t][k], source="batches", batch=k)
        if k == 2:
            table.compact(force=True)


@register("staging_merge_on_read")
def q_staging_merge_on_read(spark, sf_dir):
    """Orders loaded and changed in batches, each written as a segment of its
    own, merged in between; the folded rows."""
    batches = td.staging_batches(spark, sf_dir, "orders")
    _, tables = _change_tables(spark, ["orders"])
    for k in range(3):
        _take_batch(tables, {"orders": batches}, k)
    tables["orders"].append(batches[1], source="batches", batch=1)  # a replay: skipped
    tables["orders"].append(batches[0])  # the same without a name: nothing newer in it
    return tables["orders"].read().select("id", "customer_id", "status", "total_ht", "total_ttc", "__source_ts_ms", "__deleted")


@register("staging_copy_by_chunks")
def q_staging_copy_by_chunks(spark, sf_dir):
    """Orders copied in four chunks while the source changes and the stream
    runs: before, during (on either side of the read) and after a chunk's
    read; a copy that is started again in between; then a repair copy after
    changes that never reached the log. The folded rows."""
    cat.ensure_namespaces(spark)
    root = _run_folder(spark, "copy")
    states, records = td.copied_orders(spark, sf_dir)
    now, folder, name = {"state": 0}, os.path.join(root, "log"), td.COPIED
    log = ChangeLog(spark, name, "json", folder)
    records[0].limit(0).write.json(f"{folder}/phase=0")  # an empty log

    def advance():
        """The source's next state, and its records in the log."""
        now["state"] += 1
        records[now["state"] - 1].write.json(f"{folder}/phase={now['state']}")

    def ingest(batch):
        """What the log holds, as a stream's batch (with all before it once more)."""
        ingest_batch(spark, log.between(-1), root, tables=(name,), schemas={name: row_schema("orders")}, batch_id=batch, stream="log", order=POSITION)

    def copy(label, before=None, after=None, repair=False):
        """A copy whose reads may meet a change, before or after the read itself."""
        def read(within):
            if before:
                before.pop()()
            rows = states[now["state"]].where(within)
            if after:
                rows = materialise(rows, "read")
                after.pop()()
            return rows
        return ChunkCopy(staging_table(spark, name, root, POSITION), read, log, label, repair)

    first = copy("initial")
    first.plan(4)
    first.step(4)  # nothing happens
    copy("initial", before=[advance]).step(4)  # changes between the low mark and the read
    ingest(0)
    copy("initial", after=[advance]).step(4)  # changes between the read and the high mark
    copy("initial").run(4)
    ingest(1)
    now["state"] = 3  # changes are lost
    copy("again", repair=True).run(4)
    ingest(1)  # a replay
    return staging_table(spark, name, root, POSITION).read().select("id", "customer_id", "status", "total_ttc", "__deleted")


def _kept_query(name):
    def q(spark, sf_dir):
        sources = (*KEPT[name].sources, *KEPT[name].dimensions)
        batches = {t: td.staging_batches(spark, sf_dir, t) for t in sources}
        root, tables = _change_tables(spark, sources)
        mart = KeptMart(spark, name, tables, root)
        for k in range(3):
            _take_batch(tables, batches, k)
            mart.refresh()
        return mart.read(as_of=AS_OF)
    q.__doc__ = f"{name}, kept up to date over three batches of changes of its sources."
    return q


for _m in KEPT:
    register(f"{_m}_kept")(_kept_query(_m))


@register("reorder_suggestions_kept")
def q_reorder_suggestions_kept(spark, sf_dir):
    """Re-order suggestions, kept up to date over three batches of changes of
    orders, lines and items (sold out, back, deleted)."""
    sources = ("orders", "order_items", "items")
    batches = {t: td.staging_batches(spark, sf_dir, t) for t in sources}
    root, tables = _change_tables(spark, sources)
    kept = KeptSuggestions(spark, tables, root)
    for k in range(3):
        _take_batch(tables, batches, k)
        kept.refresh()
    return kept.read()


def _kept_checks_query(name, unique, foreign):
    def q(spark, sf_dir):
        sources = {t for t, _ in unique.values()} | {x for child, _, parent in foreign.values() for x in (child, parent)}
        more = td.COLLIDING if unique else {}
        batches = {t: td.staging_batches(spark, sf_dir, t, more.get(t)) for t in sorted(sources)}
        root, tables = _change_tables(spark, sorted(sources))
        checks = kept_checks(spark, tables, root, unique, foreign)
        for k in range(3):
            _take_batch(tables, batches, k)
            for check in checks:
                check.refresh()
        return reduce(lambda a, b: a.unionByName(b), [check.read() for check in checks])
    q.__doc__ = f"{name}, kept up to date over three batches of changes; history is asked through Bloom filters."
    return q


register("dq_unique_kept")(_kept_checks_query("dq_unique", UNIQUE, {}))
register("dq_foreign_keys_kept")(_kept_checks_query("dq_foreign_keys", {}, FOREIGN))
