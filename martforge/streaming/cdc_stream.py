"""Continuous change capture into staging (and, optionally, the refresh).

``readStream`` (kafka or JSON files) -> route topics -> decode -> unwrap ->
``foreachBatch``: per table, append the batch as a change segment of the
staging table (keyed upsert, soft deletes, schema evolution; merged when it
is read, see ``plans.changes``): a batch writes bytes in proportion to itself.
The stream's checkpoint records source offsets, and a staging table the last
batch it took of a stream: a replayed batch is skipped, so the sink is
exactly-once. Segments are compacted by size tiers after a batch.

With ``refresh_after=True`` every micro-batch also rebuilds the cleaned
layer and marts -- the source system's 2-minute cadence becomes the
trigger interval.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.staging import DEFAULT_ORDER
from ..plans.catalog import ensure_namespaces, table_exists
from ..plans.changes import ChangeTable
from ..plans.refresh import refresh
from ..plans.versions import Files
from ..fixed import REFRESH_PERIOD
from ..schemas import STAGING_TABLES, row_schema
from ..session import checkpoint_dir
from ..sources.cdc import BAD, decode, evolved_row, route, unwrap


def staging_table(spark: SparkSession, table: str, root: str | None = None, order=DEFAULT_ORDER) -> ChangeTable:
    """staging.<table>; if it was dropped from the catalogue, it starts empty."""
    found = ChangeTable(spark, f"staging.{table}", root, order=order)
    if found.published() and not table_exists(spark, found.name):
        found.clear()
    return found


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The stream's own id: that of its checkpoint, whatever the folder is called."""
    return json.loads(Files(spark, checkpoint).read(f"{checkpoint}/metadata"))["id"]


def ingest_batch(spark: SparkSession, batch: DataFrame, root: str | None = None,
                 tables=STAGING_TABLES, schemas: dict | None = None, dead_letters: str | None = None,
                 batch_id: int = 0, stream: str | None = None, order=DEFAULT_ORDER) -> list[str]:
    """Add one batch of raw change records (topic, key, value, offset) into
    staging.<table>. Returns the tables touched.

    Columns that the records bring and the table lacks are added. A record
    that can't be decoded stops the batch; with ``dead_letters`` (a folder) it
    is written there instead, as Parquet per table and batch (topic, key,
    offset, record), a replayed batch over its own earlier files. With the id
    of a ``stream``, a batch that a table has taken already is skipped: its
    records for that table aren't decoded again.

    Only the batch is read, shuffled and written, never the current table."""
    ensure_namespaces(spark)
    taken = [t for t in tables if stream is not None and (found := ChangeTable(spark, f"staging.{t}", root, order=order).versions.current())
             and found.applied.get(stream, -1) >= batch_id]
    for t in taken:  # what a writer that failed may have left undone
        table = staging_table(spark, t, root, order)
        table.compact()
        table.versions.vacuum()
    if not (left := [t for t in tables if t not in taken]):
        return sorted(taken)
    routed = route(batch).filter(F.col("table").isin(*left)).persist()
    try:
        # at most len(left) names: the whitelist bounds this collect
        present = sorted(r["table"] for r in routed.select("table").distinct().collect())
        for t in present:
            records = routed.filter(F.col("table") == t)
            row = evolved_row(records, (schemas or {}).get(t) or row_schema(t))
            decoded = decode(records, row, bad="mark" if dead_letters else "fail")
            if dead_letters:
                (decoded.filter(F.col(BAD).isNotNull()).select("topic", "key", "offset", F.col(BAD).alias("record"))
                 .write.mode("overwrite").parquet(os.path.join(dead_letters, f"table={t}", f"batch={batch_id}")))
                decoded = decoded.filter(F.col(BAD).isNull())
            changes = unwrap(decoded).select(
                *row.fieldNames(), "__op", "__ts_ms", "__source_ts_ms", "__deleted", "offset")
            table = staging_table(spark, t, root, order)
            table.append(changes, source=stream, batch=batch_id)
            table.compact()
            table.versions.vacuum()
        return sorted([*taken, *present])
    finally:
        routed.unpersist()


def start_cdc_stream(spark: SparkSession, source: DataFrame, root: str | None = None,
                     checkpoint: str | None = None, trigger: str | None = REFRESH_PERIOD,
                     available_now: bool = False, refresh_after: bool = False, as_of=None,
                     tables=STAGING_TABLES, schemas: dict | None = None, dead_letters: str | None = None,
                     query_name: str = "cdc_to_staging", order=DEFAULT_ORDER) -> StreamingQuery:
    """Start the ingest stream. ``checkpoint`` defaults to a folder under the
    session's shared ``spark.checkpoint.dir``. ``order``: the columns by which
    a key's latest row is told (``chunk_copy.POSITION`` beside a copy by chunks)."""
    ckpt = checkpoint or os.path.join(checkpoint_dir(spark), query_name)

    def each(batch: DataFrame, batch_id: int) -> None:
        touched = ingest_batch(spark, batch, root, tables, schemas, dead_letters, batch_id, stream_id(spark, ckpt), order)
        if refresh_after and touched:
            refresh(spark, root=root, as_of=as_of)

    writer = source.writeStream.queryName(query_name).foreachBatch(each).option("checkpointLocation", ckpt)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)
    return writer.start()


def _has_offsets(spark: SparkSession, checkpoint: str) -> bool:
    """Has a stream with this checkpoint planned a batch before?"""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.join(checkpoint, "offsets"))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(path) and any(not s.getPath().getName().startswith(".") for s in fs.listStatus(path))


def snapshot_then_stream(spark: SparkSession, snapshot: dict, source: DataFrame, root: str | None = None,
                         checkpoint: str | None = None, **stream_options) -> StreamingQuery:
    """Initial copy first, then increments: publish each snapshot table
    (row images) as op ``r`` staging rows ordered before every change, then
    start the change stream, which merges into them. Start the source at the
    offsets recorded when the snapshot was taken (kafka ``startingOffsets``).

    The copy is taken only when the stream has no offsets yet: a restart from
    its checkpoint goes on with the increments. A target that already exists
    is merged with the copy, not replaced."""
    ensure_namespaces(spark)
    checkpoint = checkpoint or os.path.join(checkpoint_dir(spark), stream_options.get("query_name", "cdc_to_staging"))
    for table, rows in ({} if _has_offsets(spark, checkpoint) else snapshot).items():
        snap = (rows.withColumn("__op", F.lit("r")).withColumn("__deleted", F.lit("false"))
                .withColumn("offset", F.lit(-1).cast("long")))
        for c in ("__ts_ms", "__source_ts_ms"):
            if c not in snap.columns:
                snap = snap.withColumn(c, F.lit(None).cast("long"))
        target = staging_table(spark, table, root)
        if target.current() is None:
            target.load(snap)
        else:
            target.append(snap)
    return start_cdc_stream(spark, source, root=root, checkpoint=checkpoint, **stream_options)
