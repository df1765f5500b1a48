"""Change capture operators and the keyed upsert on hand-made events."""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martforge.operators import staging as stg
from martforge.schemas import envelope_schema, row_schema
from martforge.sources import cdc


def envelopes(spark, rows):
    schema = f"topic string, key string, value {envelope_schema_ddl()}, offset long"
    return spark.createDataFrame(rows, schema)


def envelope_schema_ddl():
    return ("struct<before:struct<id:bigint,name:string>,after:struct<id:bigint,name:string>,op:string,"
            "ts_ms:bigint,source:struct<ts_ms:bigint,db:string,table:string>>")


def ev(op, before, after, ts):
    return {"before": before, "after": after, "op": op, "ts_ms": ts + 5, "source": {"ts_ms": ts, "db": "d", "table": "t"}}


def test_unwrap_route(spark):
    rows = [("ecommerce.ecommerce.items", "1", ev("c", None, {"id": 1, "name": "a"}, 10), 0),
            ("ecommerce.ecommerce.items", "1", ev("d", {"id": 1, "name": "a"}, None, 20), 1),
            ("ecommerce.ecommerce.items", "1", None, 2),                                   # tombstone
            ("schema-changes.ecommerce", "x", ev("c", None, {"id": 9, "name": "z"}, 5), 3),
            ("ecommerce.ecommerce.orders", "2", ev("r", None, {"id": 2, "name": "b"}, 1), 4)]
    flat = cdc.unwrap(envelopes(spark, rows))
    got = {r["offset"]: r for r in flat.collect()}
    assert set(got) == {0, 1, 3, 4}
    assert got[1]["name"] == "a" and got[1]["__deleted"] == "true" and got[1]["__op"] == "d"
    assert got[0]["__deleted"] == "false" and got[0]["__source_ts_ms"] == 10 and got[0]["__ts_ms"] == 15
    routed = {r["offset"]: r["table"] for r in cdc.route(flat).collect()}
    assert routed == {0: "items", 1: "items", 4: "orders"}


def test_decode_round_trip(spark):
    rows = [("t", "k", ev("u", {"id": 1, "name": "a"}, {"id": 1, "name": "b"}, 7), 0)]
    env = envelopes(spark, rows)
    wire = env.select("topic", "key", F.to_json(F.struct(F.lit("s").alias("schema"), F.col("value").alias("payload")))
                      .alias("value"), "offset")
    row = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    out = cdc.unwrap(cdc.decode(wire, row)).collect()[0]
    assert (out["id"], out["name"], out["__op"]) == (1, "b", "u")


def _changes(spark, rows):
    return spark.createDataFrame(rows, "id long, name string, __source_ts_ms long, __deleted string, offset long")


def test_latest_per_key_rules(spark):
    rows = [(1, "old", None, "false", 9),     # NULL source time sorts oldest even with a big offset
            (1, "new", 5, "false", 1),
            (2, "x", 5, "false", 1), (2, "gone", 6, "true", 2), (2, "back", 7, "false", 3),  # delete, re-create
            (3, "a", 5, "false", 1), (3, "b", 5, "false", 2)]                              # tie -> higher offset
    got = {r["id"]: (r["name"], r["__deleted"]) for r in stg.latest_per_key(_changes(spark, rows)).collect()}
    assert got == {1: ("new", "false"), 2: ("back", "false"), 3: ("b", "false")}


def test_merge_is_idempotent_and_never_regresses(spark):
    current = stg.latest_per_key(_changes(spark, [(1, "a", 10, "false", 1), (2, "b", 10, "false", 2)]))
    batch = _changes(spark, [(1, "late", 5, "false", 3), (2, "b2", 11, "false", 4), (3, "c", 1, "false", 5)])
    once = stg.merge_latest(current, batch)
    twice = stg.merge_latest(once, batch)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(once) == rows(twice)
    got = {r["id"]: r["name"] for r in once.collect()}
    assert got == {1: "a", 2: "b2", 3: "c"}


def test_schema_evolution_adds_column(spark):
    current = stg.latest_per_key(_changes(spark, [(1, "a", 1, "false", 1)]))
    batch = spark.createDataFrame([(2, "b", 2, "false", 2, "red")],
                                  "id long, name string, __source_ts_ms long, __deleted string, offset long, color string")
    merged = {r["id"]: r for r in stg.merge_latest(current, batch).collect()}
    assert merged[1]["color"] is None and merged[2]["color"] == "red"
    snap = spark.createDataFrame([(1, "snap", 1)], "id long, name string, __source_ts_ms long")
    boot = stg.latest_per_key(stg.bootstrap(snap, _changes(spark, [(1, "live", 1, "false", 0)])))
    assert boot.collect()[0]["name"] == "live"  # a change at the snapshot's time wins over the snapshot row


def test_envelope_schema_shape():
    s = envelope_schema(row_schema("items"))
    assert [f.name for f in s.fields] == ["before", "after", "op", "ts_ms", "source"]


changes_st = st.lists(st.tuples(st.integers(0, 5), st.one_of(st.none(), st.integers(0, 6)),
                                st.sampled_from(["false", "true"])), min_size=1, max_size=25)


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(changes=changes_st, cuts=st.lists(st.integers(0, 25), max_size=3), replay=st.booleans())
def test_batchwise_merge_equals_one_upsert(spark, changes, cuts, replay):
    rows = [(k, f"v{i}", ts, d, i) for i, (k, ts, d) in enumerate(changes)]
    bounds = sorted({0, len(rows), *[min(c, len(rows)) for c in cuts]})
    batches = [rows[a:b] for a, b in zip(bounds, bounds[1:]) if b > a]
    if replay:
        batches.append(batches[0])                      # a replayed (old) batch arrives again
    state = stg.latest_per_key(_changes(spark, batches[0]))
    for b in batches[1:]:
        state = stg.merge_latest(state, _changes(spark, b))
    want = stg.latest_per_key(_changes(spark, rows))
    key = lambda df: sorted(tuple(r) for r in df.select("id", "name", "__source_ts_ms", "__deleted", "offset").collect())
    assert key(state) == key(want)
