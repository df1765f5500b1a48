"""Copy of a source table by key chunks while its change stream runs.

The initial copy needn't hold up the stream, nor a lost stretch of changes a
new table. The table's key range is cut into chunks; for each chunk, in any
time relation to the stream,

1. the end of the change log is noted (low mark),
2. the chunk's rows are read from the source, in one statement,
3. the end of the log is noted again (high mark),
4. rows whose key has a change between the marks are left out: the read may
   have seen that change or not, and the stream brings it anyway,
5. the other rows are added to the change table at the position of the low mark.

A row that no change has overtaken is the key's state at the low mark, so it
beats whatever the table holds from before and loses to every later change.
The chunk and the stream's batches may therefore be added in any order: the
table comes out the same, and no key goes back to an older state meanwhile.

With ``repair`` the table may hold rows already, some of them stale because
changes were lost. Then keys of the chunk's range that the table holds as live,
that the read hasn't found and that no change has overtaken, are marked deleted.

Tables are ordered by log position alone (``POSITION``): the stream must be
started with ``order=POSITION``. Positions of one log are compared, so the
topic has one partition (the capture tool's default); another one is refused.

Bounds are fixed when a copy is planned, in a file beside the table, and a
chunk is committed with its number: a copy that is started again goes on with
the first chunk that isn't in the table, with new marks. NULL keys are left
out, as by the stream. Of rows that share a key any one is kept. Columns named
like the change metadata are replaced.

A chunk is a distributed read of its range; nothing but the bounds and two
positions is collected. A repair folds the range of the table that it checks.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..fixed import SOURCE_DATABASE, TOPIC_PREFIX
from ..functions.columns import live_row
from ..plans.changes import ChangeTable
from ..session import materialise, release
from ..sources.cdc import cdc_source
from .cdc_stream import staging_table, start_cdc_stream

#: The order of tables that are copied by chunks.
POSITION = ("offset",)
_META = ("__op", "__ts_ms", "__source_ts_ms", "__deleted", "offset")


class ChangeLog:
    """The change topic of one table, read in stretches of positions."""

    def __init__(self, spark: SparkSession, table: str, fmt: str = "kafka", path: str | None = None, options: dict | None = None,
                 key: str = "id", key_type: str = "bigint"):
        self.spark, self.table, self.fmt, self.path, self.options = spark, table, fmt, path, dict(options or {})
        self.key, self.key_type = key, key_type

    def between(self, after: int, upto: int | None = None) -> DataFrame:
        """Records of positions above ``after``, at most ``upto``."""
        options = dict(self.options)
        if self.fmt == "kafka":
            topic = f"{TOPIC_PREFIX}.{SOURCE_DATABASE}.{self.table}"
            options |= {"startingOffsets": json.dumps({topic: {"0": after + 1}}),
                        "endingOffsets": json.dumps({topic: {"0": -1 if upto is None else upto + 1}})}
        rows = cdc_source(self.spark, self.fmt, self.path, tables=(self.table,), streaming=False, options=options)
        return rows.where((F.col("offset") > after) & (F.lit(True) if upto is None else F.col("offset") <= upto))

    def end(self, after: int = -1) -> int:
        """The last position; ``after`` if nothing follows it."""
        last, partition = self.between(after).agg(F.max("offset"), F.max("partition")).first()
        if partition:
            raise ValueError(f"the topic of {self.table} has several partitions; their positions can't be compared")
        return after if last is None else last

    def keys(self, low: int, high: int) -> DataFrame:
        """Distinct keys of the records above ``low`` up to ``high``, whatever
        their values (deletes' tombstones included). A record whose key can't
        be read is an error: it may be of any row."""
        text = F.coalesce(F.get_json_object("key", f"$.{self.key}"), F.col("key"))
        key = text.try_cast(self.key_type)
        unread = F.concat(F.lit("change record without a readable key at position "), F.col("offset").cast("string"))
        return (self.between(low, high)
                .select(F.when(key.isNull(), F.raise_error(unread).cast(self.key_type)).otherwise(key).alias(self.key)).distinct())


class ChunkCopy:
    """One copy of a source table into ``target``.

    ``source`` maps a condition on the key to the rows that meet it now, e.g.
    ``lambda within: spark.read.jdbc(...).where(within)``."""

    def __init__(self, target: ChangeTable, source: Callable[[Column], DataFrame], log: ChangeLog, name: str = "initial", repair: bool = False):
        if target.order != POSITION:
            raise ValueError(f"{target.name} must be ordered by log position")
        self.target, self.source, self.log, self.name, self.repair = target, source, log, name, repair
        self.key, self.after = target.keys[0], -1

    # -- chunks ---------------------------------------------------------------

    def plan(self, chunks: int) -> list[tuple]:
        """The chunks (above, up to; None: open), about equal in rows; those
        planned before if this copy was. Keys are numbers; a table with
        another key is copied as one chunk."""
        path, files = f"{self.target.versions.folder}/copies/{self.name}.json", self.target.versions.files
        if f"{self.name}.json" not in files.names(f"{self.target.versions.folder}/copies"):
            shares = F.array(*[F.lit(i / chunks) for i in range(1, chunks)])
            found = self.source(F.lit(True)).agg(F.percentile_approx(self.key, shares)).first()[0] if chunks > 1 else None
            files.create(path, json.dumps(sorted(set(found or []))))
        bounds = json.loads(files.read(path))
        return list(zip([None, *bounds], [*bounds, None], strict=True))

    def done(self) -> int:
        """How many chunks the table holds."""
        manifest = self.target.versions.current()
        return manifest.applied.get(self._source_name(), -1) + 1 if manifest else 0

    def _source_name(self) -> str:
        return f"copy:{self.name}"

    def _within(self, above, upto) -> Column:
        key = F.col(self.key)
        return (F.lit(True) if above is None else key > above) & (F.lit(True) if upto is None else key <= upto)

    # -- one chunk --------------------------------------------------------------

    def _at(self, rows: DataFrame, position: int, op: str) -> DataFrame:
        """Change rows at one position of the log."""
        void = F.lit(None).cast("long")
        return rows.drop(*_META).withColumns({"__op": F.lit(op), "__ts_ms": void, "__source_ts_ms": void,
                                              "__deleted": F.lit("true" if op == "d" else "false"), "offset": F.lit(position).cast("long")})

    def _vanished(self, rows: DataFrame, above, upto, low: int) -> DataFrame | None:
        """Live rows of the table, of the low mark or before, that the read
        hasn't found. Written while the version read is leased."""
        if self.target.current() is None:
            return None
        parts = ([f"`{self.key}` > :above"] if above is not None else []) + ([f"`{self.key}` <= :upto"] if upto is not None else [])
        where = f"WHERE {' AND '.join(parts)}" if parts else ""
        args = {n: v for n, v in (("above", above), ("upto", upto)) if v is not None}
        with self.target.versions.lease() as manifest:
            held = self.target.spark.sql(self.target.sql(manifest, where, where), args=args)
            old = held.where(live_row() & (F.col("offset") <= low))
            return materialise(self._at(old.join(rows.select(self.key), self.key, "left_anti"), low, "d"), "vanished")

    def step(self, chunks: int) -> bool:
        """Copy the next chunk. False if none is left."""
        k, planned = self.done(), self.plan(chunks)
        if k >= len(planned):
            return False
        low = self.log.end(self.after)
        rows = materialise(self.source(self._within(*planned[k])), "chunk")
        high = self.log.end(low)
        changes, written = self._at(rows, low, "r"), [rows]
        if self.repair and (gone := self._vanished(rows, *planned[k], low)) is not None:
            changes, written = changes.unionByName(gone, allowMissingColumns=True), [rows, gone]
        if high > low:
            changes = changes.join(self.log.keys(low, high), self.key, "left_anti")
        self.target.append(changes, source=self._source_name(), batch=k)
        self.target.compact()
        self.target.versions.vacuum()
        release(*written)
        self.after = low
        return True

    def run(self, chunks: int) -> int:
        """Copy all chunks that are left; how many that were."""
        n = 0
        while self.step(chunks):
            n += 1
        return n


def copy_while_streaming(spark: SparkSession, sources: dict[str, Callable[[Column], DataFrame]], stream: DataFrame,
                         logs: dict[str, ChangeLog], chunks: int, root: str | None = None, name: str = "initial", repair: bool = False,
                         **stream_options) -> StreamingQuery:
    """Start the change stream, then copy the tables by chunks beside it.
    Returns the running stream when the copies are whole; if it ends early, so
    does this. Called again after a failure (same stream checkpoint), both go on."""
    query = start_cdc_stream(spark, stream, root=root, order=POSITION, **stream_options)
    for table, source in sources.items():
        copy = ChunkCopy(staging_table(spark, table, root, order=POSITION), source, logs[table], name, repair)
        while copy.step(chunks):
            if query.exception() is not None:
                raise query.exception()
    return query
