"""Copy by chunks beside a change stream: random interleavings against the source itself."""

from __future__ import annotations

import json
import os
import random
import threading
import time
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martforge.plans import catalog
from martforge.plans.changes import ChangeTable
from martforge.sources.cdc import cdc_source
from martforge.streaming.cdc_stream import ingest_batch, staging_table
from martforge.streaming.chunk_copy import POSITION, ChangeLog, ChunkCopy, copy_while_streaming

ROW = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType())])


class Source:
    """A table {id: n} whose changes go to a log of JSON files; n grows with every change."""

    def __init__(self, spark, folder, name):
        self.spark, self.folder, self.name = spark, folder, name
        self.rows, self.history, self.records, self.written, self.n = {}, {}, [], 0, 0
        self.lock = threading.Lock()
        os.makedirs(folder)

    def change(self, key, delete=False, lost=False):
        before = self.rows.get(key)
        if delete and before is None:
            return
        self.n += 1
        op = "d" if delete else "c" if before is None else "u"
        image = lambda n: None if n is None else {"id": key, "n": n}
        self.history.setdefault(key, []).append((before, "true") if delete else (self.n, "false"))
        if delete:
            del self.rows[key]
        else:
            self.rows[key] = self.n
        if not lost:
            payload = {"before": image(before), "after": None if delete else image(self.n), "op": op, "ts_ms": 5, "source": {"ts_ms": 5}}
            self.records.append({"topic": f"ecommerce.ecommerce.{self.name}", "key": json.dumps({"id": key}), "value": json.dumps({"schema": "", "payload": payload}),
                                 "partition": 0, "offset": len(self.records)})

    def flush(self):
        """What is new in the log, as one file."""
        if new := self.records[self.written:]:
            path = f"{self.folder}/{self.written:06d}.json"
            with open(f"{path}.tmp", "w") as f:
                f.write("\n".join(map(json.dumps, new)))
            os.rename(f"{path}.tmp", path)
            self.written = len(self.records)

    def read(self, within):
        return self.spark.createDataFrame(sorted(self.rows.items()), ROW).where(within)


def shown(table):
    if table.current() is None:
        return {}
    return {r["id"]: (r["n"], r["__deleted"]) for r in table.read().collect()}


class Crash(Exception):
    pass


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_interleavings_equal_the_source(spark, tmpdir_, seed):
    catalog.ensure_namespaces(spark)
    r, name = random.Random(seed), f"copied{seed}"
    source = Source(spark, f"{tmpdir_}/log", name)
    log = ChangeLog(spark, name, "json", source.folder)
    target = lambda: staging_table(spark, name, tmpdir_, POSITION)
    repair = seed == 3
    for key in range(12):  # rows older than the log
        source.change(key, lost=True)
    if repair:  # the table held them, then a stretch of changes got lost
        old = spark.createDataFrame([(k, v) for k, v in source.rows.items()], ROW)
        target().append(old.selectExpr("*", "'c' __op", "0L __ts_ms", "0L __source_ts_ms", "'false' __deleted", "-1L offset"))
        for _ in range(8):
            source.change(r.randrange(14), delete=r.random() < 0.5, lost=True)
    batches, seen = [], {}

    def mutate():
        for _ in range(r.randrange(0, 4)):
            source.change(r.randrange(16), delete=r.random() < 0.3)
        source.flush()

    def ingest(k):
        after, upto = batches[k]
        ingest_batch(spark, log.between(after, upto), tmpdir_, tables=(name,), schemas={name: ROW}, batch_id=k, stream="s", order=POSITION)

    def read(within):
        mutate()
        rows = spark.createDataFrame(source.read(within).collect(), ROW)
        mutate()  # the high mark comes after these
        if crashes and r.random() < 0.3:
            crashes.pop()
            raise Crash
        return rows

    crashes, copied, steps = [1, 1], 0, 0
    while True:
        mutate()
        what = r.choice(["stream", "copy", "copy", "replay"])
        if what == "copy":
            copy = ChunkCopy(target(), read, log, repair=repair)  # as if started again every time
            try:
                copied += copy.step(3)
            except Crash:
                assert copy.done() == copied
        elif what == "stream":
            batches.append((batches[-1][1] if batches else -1, len(source.records) - 1))
            ingest(len(batches) - 1)
        elif batches:
            ingest(len(batches) - 1)
        for key, state in shown(target()).items():  # no key goes back to an older state
            at = len(source.history[key]) - 1 - source.history[key][::-1].index(state) if state in source.history[key] else -1
            if at >= 0:
                assert at >= seen.get(key, -1), (key, state)
                seen[key] = at
        steps += 1
        if steps > 8 and copied == len(copy_bounds := ChunkCopy(target(), read, log).plan(3)):
            break
    assert len(copy_bounds) > 1 and not ChunkCopy(target(), read, log).step(3)
    source.flush()
    batches.append((batches[-1][1] if batches else -1, len(source.records) - 1))
    ingest(len(batches) - 1)
    assert {k: n for k, (n, deleted) in shown(target()).items() if deleted == "false"} == source.rows


def test_overtaken_rows_are_left_out_and_others_beat_what_is_stale(spark, tmpdir_):
    catalog.ensure_namespaces(spark)
    source = Source(spark, f"{tmpdir_}/log", "marks")
    log = ChangeLog(spark, "marks", "json", source.folder)
    for key in (1, 2, 3, 4):
        source.change(key)
    source.flush()
    table = staging_table(spark, "marks", tmpdir_, POSITION)
    stream = lambda k: ingest_batch(spark, log.between(-1), tmpdir_, tables=("marks",), schemas={"marks": ROW}, batch_id=k, stream="s", order=POSITION)
    stream(0)
    source.change(1, lost=True)
    source.change(2, delete=True, lost=True)
    n = source.n

    def read(within):
        rows = spark.createDataFrame(source.read(within).collect(), ROW)
        source.change(3)
        source.change(4, delete=True)
        source.change(9)
        source.flush()
        return rows

    copy = ChunkCopy(table, read, log, "fix", repair=True)
    assert copy.run(1) == 1
    added = [s for s in table.current().segments][-1]
    assert sorted((r["id"], r["n"], r["__deleted"], r["offset"]) for r in spark.read.parquet(added.path).collect()) == [(1, n - 1, "false", 3), (2, 2, "true", 3)]
    stream(1)
    assert shown(table) == {1: (n - 1, "false"), 2: (2, "true"), 3: (n + 1, "false"), 4: (4, "true"), 9: (n + 3, "false")}


def test_a_copy_beside_a_running_stream(spark, tmpdir_):
    source, name = Source(spark, f"{tmpdir_}/log", "beside"), "beside"
    for key in range(30):
        source.change(key, lost=True)
    source.change(40)
    source.flush()
    stop, r = threading.Event(), random.Random(5)

    def writer():
        while not stop.is_set():
            with source.lock:
                source.change(r.randrange(45), delete=r.random() < 0.3)
                source.flush()
            time.sleep(0.2)

    def read(within):
        with source.lock:
            return source.read(within)

    thread = threading.Thread(target=writer)
    thread.start()
    try:
        query = copy_while_streaming(
            spark, {name: read}, cdc_source(spark, "json", source.folder, tables=(name,)), {name: ChangeLog(spark, name, "json", source.folder)}, 4, tmpdir_,
            checkpoint=f"{tmpdir_}/ckpt", trigger="1 second", tables=(name,), schemas={name: ROW}, query_name=f"q{uuid.uuid4().hex[:6]}")
    finally:
        stop.set()
        thread.join()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    table = staging_table(spark, name, tmpdir_, POSITION)
    assert {k: n for k, (n, deleted) in shown(table).items() if deleted == "false"} == source.rows
    assert {r["id"]: r["n"] for r in spark.table("staging.beside").where("__deleted = 'false'").collect()} == source.rows


def test_odd_rows_and_refusals(spark, tmpdir_):
    catalog.ensure_namespaces(spark)
    with pytest.raises(ValueError, match="log position"):
        ChunkCopy(ChangeTable(spark, "staging.odd0", tmpdir_), None, None)
    source = Source(spark, f"{tmpdir_}/log", "odd")
    log = ChangeLog(spark, "odd", "json", source.folder)
    table = ChangeTable(spark, "staging.odd", tmpdir_, order=POSITION)
    empty = ChunkCopy(table, lambda within: spark.createDataFrame([], ROW).where(within), log, "empty", repair=True)
    assert empty.plan(4) == [(None, None)] and empty.run(4) == 1 and shown(table) == {}
    clash = spark.createDataFrame([(None, 1, "x"), (5, 2, "y"), (5, 2, "y"), (6, None, None)], "id long, n long, __op string")
    odd = ChunkCopy(table, lambda within: clash.where(within), log, "odd", repair=True)
    odd.run(2)
    assert shown(table) == {5: (2, "false"), 6: (None, "false")}
    assert {r["__op"] for r in table.read().collect()} == {"r"}
    text = ChangeTable(spark, "staging.odd2", tmpdir_, keys=("code",), order=POSITION)
    words = spark.createDataFrame([(c, 1) for c in "ab'd"], "code string, n int")
    # a text key has no percentiles: one chunk
    copy = ChunkCopy(text, lambda within: words.where(within), ChangeLog(spark, "odd2", "json", source.folder, key="code", key_type="string"), "t", repair=True)
    assert copy.run(1) == 1 and text.read().count() == 4
    source.records = [{"topic": "ecommerce.ecommerce.odd", "key": "{}", "value": None, "partition": p, "offset": p} for p in (0, 1)]
    source.flush()
    with pytest.raises(ValueError, match="several partitions"):
        log.end()
    with pytest.raises(Exception, match="without a readable key"):
        log.keys(-1, 1).collect()


def test_a_chunk_reads_its_range_and_not_the_table(spark, tmpdir_):
    catalog.ensure_namespaces(spark)
    spark.range(1000).selectExpr("id", "id AS n").write.parquet(f"{tmpdir_}/source")
    asked = []

    def read(within):
        asked.append(spark.read.parquet(f"{tmpdir_}/source").where(within))
        return asked[-1]

    os.makedirs(f"{tmpdir_}/log")
    table = ChangeTable(spark, "staging.ranges", tmpdir_, order=POSITION)
    copy = ChunkCopy(table, read, ChangeLog(spark, "ranges", "json", f"{tmpdir_}/log"))
    sizes = []
    while copy.step(4):
        sizes.append(asked[-1].count())
    assert len(sizes) == 4 and sum(sizes) == 1000 and max(sizes) < 300
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id," in asked[-1]._jdf.queryExecution().toString()
    assert table.read().agg(F.sum("n")).first()[0] == 499500
