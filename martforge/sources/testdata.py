"""Stand-in inputs built from the provided TPC-H-like tables.

Each function only maps provided columns into the schema a job expects
(staging rows, change events, carts, order requests); none of them does any
of the jobs' work. The mapping rules are fixed test-data conventions and are
mirrored, rule for rule, by the SQL oracle's CTEs.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import row_schema

# Fixed test-data conventions.
BASE_SOURCE_MS = 1704067200000  # 2024-01-01T00:00:00Z, source time of dimension rows
ORDER_STATUS_BY_CODE = {"F": "CONFIRMED", "O": "PENDING", "P": "SHIPPED"}
PAYMENT_STATUS_BY_CODE = {"F": "COMPLETED", "O": "PENDING", "P": "FAILED"}
PAYMENT_METHOD_BY_MOD3 = ("CARD", "BANK_TRANSFER", "PAYPAL")
VAT_BY_SIZE_MOD4 = ("0", "5.5", "10", "20")
CHANGE_OP_BY_EVENT = {"signup": "c", "click": "u", "view": "u", "purchase": "u", "error": "d"}
CART_ACTION_BY_EVENT = {"purchase": "add", "click": "add", "view": "update", "error": "remove", "signup": "clear"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ms_of(ts_ntz) -> Column:
    """Epoch millis (floor) of a timestamp without time zone, read as UTC."""
    return F.unix_millis(F.col(ts_ntz).cast("timestamp"))


def deleted_flag(id_col: str = "id") -> Column:
    k = F.col(id_col) % 50
    return F.when(k == 49, F.lit("true")).when(k == 48, F.lit(None).cast("string")).otherwise(F.lit("false"))


def _case(col: Column, mapping: dict) -> Column:
    out = None
    for key, value in mapping.items():
        out = (F.when(col == key, value) if out is None else out.when(col == key, value))
    return out


def _meta(src_ms: Column, op: str = "r") -> list:
    return [F.lit(op).alias("__op"), src_ms.alias("__ts_ms"), src_ms.alias("__source_ts_ms"),
            deleted_flag("id").alias("__deleted")]


def _person(df: DataFrame, key: str, name: str, balance: str, with_contact: bool) -> DataFrame:
    src = F.lit(BASE_SOURCE_MS) + F.col(key) * 1000
    cols = [
        F.col(key).alias("id"),
        F.concat(F.lower(F.col(name)), F.lit("@example.com")).alias("email"),
        F.split_part(F.col(name), F.lit("#"), F.lit(1)).alias("first_name"),
        F.split_part(F.col(name), F.lit("#"), F.lit(2)).alias("last_name"),
        F.sha2(F.col(name), 256).alias("hashed_password"),
    ]
    if with_contact:
        cols += [F.lit(None).cast("string").alias("phone"), F.lit(None).cast("string").alias("address")]
    cols += [F.when(F.col(balance) >= 0, 1).otherwise(0).cast("smallint").alias("is_active"),
             src.alias("created_at"), src.alias("updated_at")]
    return df.select(*cols, *_meta(src))


def staging_customers(spark, sf_dir) -> DataFrame:
    return _person(read(spark, sf_dir, "customer"), "c_custkey", "c_name", "c_acctbal", True)


def staging_admins(spark, sf_dir) -> DataFrame:
    return _person(read(spark, sf_dir, "supplier"), "s_suppkey", "s_name", "s_acctbal", False)


def staging_items(spark, sf_dir) -> DataFrame:
    p = read(spark, sf_dir, "part")
    src = F.lit(BASE_SOURCE_MS) + F.col("p_partkey") * 1000
    vat = _case(F.col("p_size") % 4, {i: F.lit(Decimal(v)) for i, v in enumerate(VAT_BY_SIZE_MOD4)}).cast("decimal(5,2)")
    factor = F.lit(Decimal("1")) + vat * F.lit(Decimal("0.01"))
    ttc = F.round(F.col("p_retailprice").cast("decimal(12,2)") * factor, 2).cast("double")
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("description"),
        F.lit(None).cast("string").alias("image_url"), F.col("p_retailprice").alias("price_ht"),
        vat.cast("double").alias("tva_rate"), ttc.alias("price_ttc"),
        F.when(F.col("p_size") % 5 == 0, 0).otherwise(F.col("p_size")).cast("int").alias("quantity"),
        src.alias("created_at"), src.alias("updated_at"), *_meta(src))


def _orders_base(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")


def _total_ht(price: str) -> Column:
    return F.round(F.col(price).cast("decimal(18,2)") * F.lit(Decimal("0.80")), 2)


def staging_orders(spark, sf_dir) -> DataFrame:
    o = _orders_base(spark, sf_dir)
    src = ms_of("o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer_id"),
        _case(F.col("o_orderstatus"), ORDER_STATUS_BY_CODE).alias("status"),
        _total_ht("o_totalprice").cast("double").alias("total_ht"), F.col("o_totalprice").alias("total_ttc"),
        src.alias("created_at"), src.alias("updated_at"), *_meta(src))


def staging_order_items(spark, sf_dir) -> DataFrame:
    """Order lines. ``id`` is 10*orderkey+linenumber and is NOT unique in the
    provided data: a raw change stream rather than an upserted table."""
    li = read(spark, sf_dir, "lineitem")
    src = ms_of("l_shipdate")
    ttc = F.round(F.col("l_extendedprice").cast("decimal(18,2)")
                  * (F.lit(Decimal("1")) + F.col("l_tax").cast("decimal(4,2)")), 2)
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("item_id"), F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_extendedprice").alias("unit_price_ht"), ttc.cast("double").alias("unit_price_ttc"), *_meta(src))


def staging_payments(spark, sf_dir) -> DataFrame:
    o = _orders_base(spark, sf_dir)
    src = ms_of("o_orderdate")
    method = _case(F.col("o_orderkey") % 3, dict(enumerate(PAYMENT_METHOD_BY_MOD3)))
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("order_id"),
        F.col("o_totalprice").alias("amount"), _case(F.col("o_orderstatus"), PAYMENT_STATUS_BY_CODE).alias("status"),
        method.alias("payment_method"),
        F.concat(F.lit("TXN-"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("transaction_id"),
        src.alias("created_at"), src.alias("updated_at"), *_meta(src))


def staging_invoices(spark, sf_dir) -> DataFrame:
    o = _orders_base(spark, sf_dir).filter(F.col("o_orderstatus") == "F")
    src = ms_of("o_orderdate")
    due = F.when(F.col("o_orderkey") % 97 == 0, F.lit(None).cast("long")).otherwise(src + F.lit(30 * 86400000))
    ht = _total_ht("o_totalprice")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("order_id"),
        F.concat(F.lit("INV-"), F.date_format(F.col("o_orderdate"), "yyyyMMdd"), F.lit("-"),
                 F.col("o_orderkey").cast("string")).alias("invoice_number"),
        src.alias("issued_at"), due.alias("due_date"), ht.cast("double").alias("total_ht"),
        (F.col("o_totalprice").cast("decimal(18,2)") - ht).cast("double").alias("total_tva"),
        F.col("o_totalprice").alias("total_ttc"), *_meta(src))


STAGING_BUILDERS = {
    "admins": staging_admins, "customers": staging_customers, "items": staging_items,
    "orders": staging_orders, "order_items": staging_order_items, "payments": staging_payments,
    "invoices": staging_invoices,
}


def staging(spark, sf_dir) -> dict[str, DataFrame]:
    return {name: fn(spark, sf_dir) for name, fn in STAGING_BUILDERS.items()}


# --- change log ------------------------------------------------------------

EVENT_ROW = T.StructType([T.StructField("id", T.LongType()), T.StructField("value", T.DoubleType()),
                          T.StructField("props", T.StringType())])

def change_log(spark, sf_dir) -> DataFrame:
    """Flat change rows from ``events``: key = user_id, offset = event_id."""
    e = read(spark, sf_dir, "events")
    op = _case(F.col("event_type"), CHANGE_OP_BY_EVENT)
    return e.select(
        F.col("user_id").alias("id"), F.col("value"), F.col("props"),
        op.alias("__op"), ms_of("ts").alias("__ts_ms"), ms_of("ts").alias("__source_ts_ms"),
        F.when(op == "d", "true").otherwise("false").alias("__deleted"),
        F.col("event_id").alias("offset"))


def change_envelopes(spark, sf_dir) -> DataFrame:
    """Raw change events (before/after envelope) from ``events``.

    Topic per event type; ``error`` events go to the schema-change topic so
    that routing has something to drop.
    """
    e = read(spark, sf_dir, "events")
    op = _case(F.col("event_type"), CHANGE_OP_BY_EVENT)
    image = F.struct(F.col("user_id").alias("id"), F.col("value"), F.col("props"))
    null_image = F.lit(None).cast(EVENT_ROW)
    topic = F.when(F.col("event_type") == "error", F.lit("schema-changes.ecommerce")).otherwise(
        F.concat(F.lit("ecommerce.ecommerce."), F.col("event_type")))
    envelope = F.struct(
        F.when(op == "c", null_image).otherwise(image).alias("before"),
        F.when(op == "d", null_image).otherwise(image).alias("after"),
        op.alias("op"), ms_of("ts").alias("ts_ms"),
        F.struct(ms_of("ts").alias("ts_ms"), F.lit("ecommerce").alias("db"),
                 F.col("event_type").alias("table")).alias("source"))
    return e.select(topic.alias("topic"), F.col("user_id").cast("string").alias("key"),
                    envelope.alias("value"), F.col("event_id").alias("offset"))


# --- carts and order requests ----------------------------------------------

def _item_of_props(spark, sf_dir) -> Column:
    """item = (k * 20) % number of parts; the count is a scalar subquery."""
    n_parts = read(spark, sf_dir, "part").select(F.count(F.lit(1))).scalar()
    return (F.get_json_object(F.col("props"), "$.k").cast("long") * 20) % n_parts


def cart_lines(spark, sf_dir) -> DataFrame:
    """(cart_id, item_id, quantity, arrival) from purchase events."""
    e = read(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")
    return e.select(
        F.col("user_id").alias("cart_id"), _item_of_props(spark, sf_dir).alias("item_id"),
        (F.lit(1) + F.col("event_id") % 5).cast("int").alias("quantity"), F.col("event_id").alias("arrival"))


def carts(spark, sf_dir) -> DataFrame:
    """(cart_id, raw) JSON carts; repeated items are summed first. The number
    of distinct items per cart is bounded by the props domain (k in 0..99)."""
    lines = cart_lines(spark, sf_dir).groupBy("cart_id", "item_id").agg(F.sum("quantity").alias("q"))
    return lines.groupBy("cart_id").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("item_id").cast("string"), F.col("q"))))).alias("raw"))


def cart_events(spark, sf_dir) -> DataFrame:
    """(cart_id, item_id, action, quantity, ts, arrival) cart actions from events."""
    e = read(spark, sf_dir, "events")
    action = _case(F.col("event_type"), CART_ACTION_BY_EVENT)
    q = (F.floor(F.col("value")) - F.lit(5)).cast("int")
    return e.select(
        F.col("user_id").alias("cart_id"), _item_of_props(spark, sf_dir).alias("item_id"),
        action.alias("action"), q.alias("quantity"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("arrival"))


def order_requests(spark, sf_dir) -> DataFrame:
    """(request_id, customer_id, item_id, quantity, arrival): every purchase
    event is one single-line order request; arrival = event_id."""
    lines = cart_lines(spark, sf_dir)
    return lines.select(F.col("arrival").alias("request_id"), F.col("cart_id").alias("customer_id"),
                        "item_id", "quantity", "arrival")


def customer_candidates(spark, sf_dir) -> DataFrame:
    """Sign-up candidates: one per signup event; e-mail derived from user_id so
    some collide with existing customers and some repeat within the batch."""
    e = read(spark, sf_dir, "events").filter(F.col("event_type") == "signup")
    name = F.concat(F.lit("Customer#"), F.lpad((F.col("user_id") * 13).cast("string"), 9, "0"))
    return e.select(
        F.col("event_id").alias("arrival"),
        F.concat(F.lower(name), F.lit("@example.com")).alias("email"),
        F.concat(F.lit("  "), F.lit("New"), F.lit(" ")).alias("first_name"),
        name.alias("last_name"), F.lit(" ").alias("phone"), F.lit(None).cast("string").alias("address"))


def change_wire(spark, sf_dir) -> DataFrame:
    """Change events as they travel: JSON value with schema envelope."""
    env = change_envelopes(spark, sf_dir)
    wire = F.to_json(F.struct(F.lit("envelope").alias("schema"), F.col("value").alias("payload")))
    return env.select("topic", "key", wire.alias("value"), "offset")


def spoiled_wire(spark, sf_dir) -> DataFrame:
    """``change_wire`` with some records cut off (offset % 7 = 1) and some
    with text in place of the id (offset % 7 = 3)."""
    wire = change_wire(spark, sf_dir)
    cut = F.substring("value", 1, 40)
    mistyped = F.regexp_replace("value", r'"id":-?\d+', '"id":"abc"')
    value = F.when(F.col("offset") % 7 == 1, cut).when(F.col("offset") % 7 == 3, mistyped).otherwise(F.col("value"))
    return wire.withColumn("value", value)


def confirmation_requests(spark, sf_dir) -> DataFrame:
    """(order_id, customer_id) page requests: every order asked for by its
    owner and by the next customer id (which the owner check must refuse)."""
    o = _orders_base(spark, sf_dir)
    owner = o.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"))
    other = o.select(F.col("o_orderkey").alias("order_id"), (F.col("o_custkey") + 1).alias("customer_id"))
    return owner.unionByName(other)


ITEM_ACTION_BY_EVENT = {"signup": "c", "click": "u", "view": "u", "purchase": "u", "error": "d"}


def item_actions(spark, sf_dir) -> DataFrame:
    """Admin item actions from events: item = (k*20) % parts (signup creates
    a new id past the catalogue), new HT price = value, VAT by k % 4."""
    e = read(spark, sf_dir, "events")
    n_parts = read(spark, sf_dir, "part").select(F.count(F.lit(1))).scalar()
    k = F.get_json_object(F.col("props"), "$.k").cast("long")
    action = _case(F.col("event_type"), ITEM_ACTION_BY_EVENT)
    vat = _case(k % 4, {i: F.lit(float(v)) for i, v in enumerate(VAT_BY_SIZE_MOD4)})
    item = F.when(action == "c", F.lit(n_parts) + F.col("event_id")).otherwise((k * 20) % n_parts)
    return e.select(
        action.alias("action"), item.alias("id"), F.concat(F.lit("item "), k.cast("string")).alias("title"),
        F.when(k % 10 == 0, F.lit("")).otherwise(F.col("event_type")).alias("description"),
        F.col("value").alias("price_ht"), vat.alias("tva_rate"), (k % 7).cast("int").alias("quantity"),
        ms_of("ts").alias("ts_ms"), F.col("event_id").alias("offset"))


def profile_edits(spark, sf_dir) -> DataFrame:
    """Profile form submissions: sign-up candidates' raw fields."""
    return customer_candidates(spark, sf_dir).select("arrival", "first_name", "last_name", "phone", "address")


# --- staging tables in batches ------------------------------------------------
DAY_MS = 86_400_000


def _offset(table: str) -> Column:
    """Tells apart changes of one id and time: order lines by their price in
    cents (their ids repeat), other tables' ids don't."""
    return F.floor(F.col("unit_price_ht") * 100 + F.lit(0.5)).cast("long") if table == "order_items" else F.lit(0).cast("long")


#: Edits after which rows share what should be unique: two of five customers' e-mails, invoices' orders.
COLLIDING = {"customers": {"email": "concat('shared', id div 10, '@shop.test')"}, "invoices": {"order_id": "id div 10"}}


def _edited(df: DataFrame, table: str, more: dict | None = None) -> DataFrame:
    """An edit of each row."""
    edits = {"orders": {"status": F.when(F.col("status") == "CONFIRMED", "PENDING").otherwise("CONFIRMED"), "total_ttc": F.col("total_ttc") + 1},
             "order_items": {"quantity": F.col("quantity") + 1}, "items": {"quantity": F.col("quantity") + 1},
             "customers": {"last_name": F.concat("last_name", F.lit("-b"))}, "admins": {"last_name": F.concat("last_name", F.lit("-b"))},
             "payments": {"status": F.lit("FAILED")}, "invoices": {"total_ht": F.col("total_ht") + 1}}
    more = {c: F.expr(e) for c, e in (more or {}).items()}
    return df.withColumns({**edits[table], **more, "__op": F.lit("u")})


def staging_batches(spark, sf_dir, table: str, more: dict | None = None) -> list[DataFrame]:
    """The rows of a staging table as three batches of changes. First: ids
    that leave 0, 1 or 2 by 4. Second: the other ids, and edits (a day later)
    of ids divisible by 5. Third: deletes (two days later) of ids divisible by
    7, edits that come late (a second before the row they edit) of ids
    divisible by 11, and the rows of ids divisible by 13 once more. ``more``:
    further columns that an edit sets, as SQL."""
    rows = STAGING_BUILDERS[table](spark, sf_dir).withColumn("offset", _offset(table))
    later = lambda df, ms: df.withColumn("__source_ts_ms", F.col("__source_ts_ms") + F.lit(ms))
    of = lambda k: rows.where(F.col("id") % k == 0)
    gone = later(of(7), 2 * DAY_MS).withColumns({"__op": F.lit("d"), "__deleted": F.lit("true")})
    return [rows.where(F.col("id") % 4 != 3),
            rows.where(F.col("id") % 4 == 3).unionByName(later(_edited(of(5), table, more), DAY_MS)),
            gone.unionByName(later(_edited(of(11), table, more), -1000)).unionByName(of(13))]


# --- a source table that changes while it is copied --------------------------------

COPIED = "orders_copied"
_POSITIONS = 1 << 40  # of the log, for each phase


def _log_records(rows, phase: int, op: str, step: int) -> DataFrame:
    """Change records as they travel: JSON key and value, positions by id."""
    image = F.struct(*[F.col(f.name) for f in row_schema("orders")])
    void = F.lit(None).cast(row_schema("orders"))
    envelope = F.struct((image if op == "d" else void).alias("before"), (void if op == "d" else image).alias("after"), F.lit(op).alias("op"),
                        F.col("updated_at").alias("ts_ms"), F.struct(F.col("updated_at").alias("ts_ms"), F.lit("ecommerce").alias("db"), F.lit(COPIED).alias("table")).alias("source"))
    return rows.select(
        F.lit(f"ecommerce.ecommerce.{COPIED}").alias("topic"), F.to_json(F.struct("id")).alias("key"),
        F.to_json(F.struct(F.lit("envelope").alias("schema"), envelope.alias("payload"))).alias("value"), F.lit(0).alias("partition"),
        (F.lit(phase * _POSITIONS) + F.col("id") * 2 + step).alias("offset"))


def copied_orders(spark, sf_dir) -> tuple[list[DataFrame], list[DataFrame]]:
    """A source table of orders at four times, and the change records between
    the first three. First: ids that leave 0, 1 or 2 by 4. Second: the others
    as well, and ids divisible by 5 edited. Third: without ids divisible by 7.
    Fourth: ids divisible by 11 edited (total + 2) and ids divisible by 13
    gone, but no record of it reaches the log."""
    rows = staging_orders(spark, sf_dir).select(*row_schema("orders").fieldNames())
    edited = _edited(rows.where(F.col("id") % 5 == 0), "orders").drop("__op")
    second = rows.where(F.col("id") % 5 != 0).unionByName(edited)
    third = second.where(F.col("id") % 7 != 0)
    fourth = third.where(F.col("id") % 13 != 0).withColumn("total_ttc", F.col("total_ttc") + F.when(F.col("id") % 11 == 0, 2.0).otherwise(0.0))
    logs = [_log_records(rows.where(F.col("id") % 4 == 3), 1, "c", 0).unionByName(_log_records(edited, 1, "u", 1)),
            _log_records(second.where(F.col("id") % 7 == 0), 2, "d", 0)]
    return [rows.where(F.col("id") % 4 != 3), second, third, fourth], logs
