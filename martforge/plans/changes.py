"""Tables kept as a base and ordered change segments (merge on read).

``append`` writes one batch as one new segment: bytes in proportion to the
batch, whatever the table holds. A read folds: the base, bucketed by the key,
meets the folded segments in a full outer join (kind ``latest``: the row with
the greatest order wins, and of equal ones the later commit's) or is added up
with them (kind ``sum``: signed partial sums per key). Only segments are
shuffled for a ``latest`` read; the base is laid out already.

``compact`` merges size tiers: when a tier holds ``FANOUT`` segments they
become one, and when the segments reach a share of the base all become a new
base. So a row is rewritten a logarithmic number of times. A merge commits
only if all it read is still listed, beside what was appended meanwhile; every
read before, during and after gives the same rows.

Merged rows keep the sequence number of their commit (``__seq``), so a
consumer can ask which keys changed after the one it has seen, also across a
compaction. A batch of a named source is taken once: replays are skipped.
"""

from __future__ import annotations

import math
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.staging import DEFAULT_ORDER, latest_per_key, wider
from .catalog import ensure_namespaces, warehouse_root
from .versions import Manifest, Segment, Versions

SEQ = "__seq"
#: Segments of one size tier that are merged; also the ratio between tiers.
FANOUT = 4
#: Bytes of the smallest tier.
TIER_BYTES = 1 << 20
#: Share of the base's bytes at which the segments are merged into it.
BASE_SHARE = 0.25
#: Estimated bytes a bucket from which a batch is laid out like the base: then no fold shuffles it.
BUCKET_BYTES = 1 << 20
#: A file that tells a table that was dropped from one not yet in the catalogue.
PUBLISHED = "published"


def _names(columns) -> str:
    return ", ".join(f"`{c}`" for c in columns)


class ChangeTable:
    """``ns.table`` as a base with change segments; also a catalogue view."""

    def __init__(self, spark: SparkSession, name: str, root: str | None = None, keys=("id",), kind: str = "latest", order=DEFAULT_ORDER,
                 buckets: int | None = None, public: bool = True):
        self.spark, self.name, self.keys, self.kind, self.order, self.public = spark, name, tuple(keys), kind, tuple(order), public
        ns, table = name.split(".")
        self.versions = Versions(spark, os.path.join(warehouse_root(spark, root), ns, table))
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    # -- plans --------------------------------------------------------------

    def columns(self, manifest: Manifest) -> dict[str, str]:
        """The union of the segments' columns; of differing types the one that holds both."""
        out: dict[str, str] = {}
        for s in manifest.segments:
            for c, t in s.columns.items():
                out[c] = wider(out[c], t, c) if c in out else t
        return out

    def _rows(self, s: Segment, columns: dict[str, str], where: str = "") -> str:
        shown = [f"CAST(`{c}` AS {t}) AS `{c}`" if s.columns.get(c, t) != t else f"`{c}`" if c in s.columns else f"CAST(NULL AS {t}) AS `{c}`"
                 for c, t in columns.items()]
        seq = f"`{SEQ}`" if s.stored_seq else f"CAST({s.seq} AS BIGINT) AS `{SEQ}`"
        return f"SELECT {', '.join(shown)}, {seq} FROM {s.table or f'parquet.`{s.path}`'} {where}"

    def sql(self, manifest: Manifest, base_where: str = "", delta_where: str = "", seq: bool = False) -> str:
        """The folded rows as a query over the manifest's files."""
        columns = self.columns(manifest)
        base = [s for s in manifest.segments if s.kind == "base"]
        deltas = [s for s in manifest.segments if s.kind != "base"]
        keys = _names(self.keys)
        if self.kind == "sum":
            sums = [c for c in columns if c not in self.keys]
            rows = " UNION ALL ".join(self._rows(s, columns, base_where if s in base else delta_where) for s in base + deltas)
            added = ", ".join(f"CAST(sum(`{c}`) AS {columns[c]}) AS `{c}`" for c in sums)
            extra = f", max(`{SEQ}`) AS `{SEQ}`" if seq else ""
            return f"SELECT {keys}, {added}{extra} FROM ({rows}) GROUP BY {keys} HAVING " + " OR ".join(f"sum(`{c}`) <> 0" for c in sums)
        key, rest = self.keys[0], [c for c in columns if c != self.keys[0]]
        shown = [*rest, SEQ] if seq else rest
        rank = [*self.order, SEQ]
        whole = f"(SELECT * FROM ({self._rows(base[0], columns, base_where)}))" if base else ""
        if not deltas:
            return f"SELECT `{key}`, {_names(shown)} FROM {whole}"
        rows = " UNION ALL ".join(self._rows(s, columns, delta_where) for s in deltas)
        if len(deltas) == 1:  # a segment holds one row per key: as it is, only the columns asked for are moved
            folded, of = f"(SELECT * FROM ({rows}) WHERE `{key}` IS NOT NULL)", ""
        else:
            folded = (f"(SELECT `{key}`, max_by(struct({_names([*rest, SEQ])}), struct({_names(rank)})) AS r FROM ({rows}) "
                      f"WHERE `{key}` IS NOT NULL GROUP BY `{key}`)")
            of = "r."
        if not base:
            return f"SELECT `{key}`, " + ", ".join(f"{of}`{c}` AS `{c}`" for c in shown) + f" FROM {folded}"
        later = "struct({}) >= struct({})".format(", ".join(f"d.{of}`{c}`" for c in rank), ", ".join(f"b.`{c}`" for c in rank))
        wins = f"d.`{key}` IS NOT NULL AND (b.`{key}` IS NULL OR {later})"
        return (f"SELECT coalesce(b.`{key}`, d.`{key}`) AS `{key}`, " + ", ".join(f"CASE WHEN {wins} THEN d.{of}`{c}` ELSE b.`{c}` END AS `{c}`" for c in shown)
                + f" FROM {whole} b FULL OUTER JOIN {folded} d ON b.`{key}` = d.`{key}`")

    # -- reading ------------------------------------------------------------

    def current(self) -> Manifest | None:
        found = self.versions.current()
        return found if found and found.segments else None

    def read(self, manifest: Manifest | None = None, seq: bool = False) -> DataFrame:
        return self.spark.sql(self.sql(manifest or self.current(), seq=seq))

    def only(self, keys: DataFrame, column: str | None = None, manifest: Manifest | None = None, seq: bool = False) -> DataFrame:
        """The folded rows whose ``column`` (a key by default) is among
        ``keys`` (one column). The base is filtered in place by a semi join,
        before anything is shuffled."""
        manifest, column = manifest or self.current(), column or self.keys[0]
        among = f"`{column}` IN (SELECT * FROM {{wanted}})"
        session = keys.sparkSession  # a stream's batch has one of its own
        if column in self.keys:
            text = self.sql(manifest, f"WHERE {among}", f"WHERE {among}", seq)
            return session.sql(text, wanted=keys)
        # a change may move a row from one value to another: keys with changes are folded too
        deltas = [s for s in manifest.segments if s.kind != "base"]
        touched = " UNION ALL ".join(f"SELECT `{self.keys[0]}` FROM parquet.`{s.path}`" for s in deltas)
        base_where = f"WHERE {among}" + (f" OR `{self.keys[0]}` IN ({touched})" if deltas else "")
        return session.sql(f"SELECT * FROM ({self.sql(manifest, base_where, seq=seq)}) WHERE {among}", wanted=keys)

    def changed(self, after: int, manifest: Manifest | None = None) -> DataFrame:
        """Distinct first keys of rows that commits after ``after`` brought."""
        manifest = manifest or self.current()
        key = {self.keys[0]: self.columns(manifest)[self.keys[0]]}
        parts = [f"SELECT `{self.keys[0]}` FROM ({self._rows(s, key)}) WHERE `{SEQ}` > {after}" for s in manifest.segments if s.seq > after]
        return self.spark.sql("SELECT DISTINCT * FROM (" + " UNION ALL ".join(parts) + f") WHERE `{self.keys[0]}` IS NOT NULL")

    def brought(self, after: int, manifest: Manifest | None = None) -> tuple[int, int]:
        """How many stored rows commits after ``after`` brought, and how many there are."""
        manifest = manifest or self.current()
        if all(s.seq <= after for s in manifest.segments):
            return 0, 0
        key = {self.keys[0]: self.columns(manifest)[self.keys[0]]}
        rows = " UNION ALL ".join(self._rows(s, key) for s in manifest.segments)
        return tuple(self.spark.sql(f"SELECT count_if(`{SEQ}` > {after}), count(*) FROM ({rows})").first())

    # -- writing ------------------------------------------------------------

    def _segment(self, rows: DataFrame, kind: str = "delta", laid_out: bool = False, bucketed: bool = False, **more) -> Segment:
        """``rows`` as a new segment. ``laid_out``: they come from a join with
        a base of as many buckets, so each task holds whole buckets already.
        ``bucketed``: laid out by the key, as a base always is."""
        path, table = self.versions.new_folder(), None
        if (kind == "base" or bucketed) and self.kind == "latest":
            ensure_namespaces(self.spark, [self.name.split(".")[0]])  # the catalogue may not have it yet
            table = f"{self.name}__{uuid.uuid4().hex[:12]}"
            rows = rows if laid_out else rows.repartition(self.buckets, self.keys[0])
            (rows.write.format("parquet").option("compression", "zstd").bucketBy(self.buckets, self.keys[0]).sortBy(self.keys[0])
             .option("path", path).saveAsTable(table))
        else:
            rows.write.option("compression", "zstd").parquet(path)
        columns = {f.name: f.dataType.simpleString() for f in rows.schema if f.name != SEQ}
        return Segment(path, columns, kind, bytes=self.versions.files.size(path), table=table, **more)

    def _publish(self, manifest: Manifest) -> None:
        """The catalogue's view of ``manifest``, or of the version that another
        writer has committed meanwhile: the last to publish looks again."""
        while self.public:
            ensure_namespaces(self.spark, [self.name.split(".")[0]])
            self.spark.sql(f"CREATE OR REPLACE VIEW {self.name} AS {self.sql(manifest)}")
            newest = self.current()
            if newest is None or newest.version <= manifest.version:
                if PUBLISHED not in self.versions.files.names(self.versions.folder):
                    self.versions.files.create(f"{self.versions.folder}/{PUBLISHED}", "")
                return
            manifest = newest

    def load(self, rows: DataFrame) -> Manifest:
        """A first, large load as the base (one row per key is kept)."""
        segment = self._segment(latest_per_key(rows, self.keys[0], self.order) if self.kind == "latest" else rows, "base")

        def first(m: Manifest):
            if m.segments:
                return False
            segment.seq, m.segments, m.next_seq = m.next_seq, [segment], m.next_seq + 1

        done = self.versions.commit(first)
        if done is None:
            raise ValueError(f"{self.name} holds rows already; append to it")
        self._publish(done)
        return done

    def clear(self) -> None:
        """A next version without rows."""
        self.versions.commit(lambda m: m.segments.clear())
        self.versions.files.delete(f"{self.versions.folder}/{PUBLISHED}")

    def published(self) -> bool:
        """Has the catalogue held this table since it was last empty?"""
        return PUBLISHED in self.versions.files.names(self.versions.folder)

    def append(self, changes: DataFrame, source: str | None = None, batch: int = 0) -> Manifest:
        """Add one batch of changes (``latest``: change rows, reduced to one
        per key; ``sum``: signed sums). With a ``source``, a batch whose number
        isn't above the last one taken is skipped."""
        before = self.versions.current()
        if before and source and before.applied.get(source, -1) >= batch:
            return before
        latest = self.kind == "latest"
        segment = self._segment(latest_per_key(changes, self.keys[0], self.order) if latest else changes, bucketed=latest and self._large(changes))

        def add(m: Manifest):
            if source and m.applied.get(source, -1) >= batch:
                return False
            segment.seq = m.next_seq
            m.segments.append(segment)
            self.columns(m)  # types that don't go together stop here
            m.next_seq += 1
            if source:
                m.applied[source] = batch

        done = self.versions.commit(add)
        if done is None:
            if segment.table:
                self.spark.sql(f"DROP TABLE IF EXISTS {segment.table}")
            self.versions.files.delete(segment.path)
            return self.versions.current()
        self._publish(done)
        return done

    def _large(self, changes: DataFrame) -> bool:
        """Does the planner expect a batch large enough for a file a bucket?
        Only the layout depends on it."""
        expected = changes._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        return int(str(expected)) >= BUCKET_BYTES * self.buckets

    def _tier(self, s: Segment) -> int:
        return max(0, math.ceil(math.log(max(s.bytes, 1) / TIER_BYTES, FANOUT)))

    def plan_compaction(self, manifest: Manifest) -> tuple[list[Segment], str]:
        """Which segments to merge, and into what; from their counts and bytes alone."""
        base = [s for s in manifest.segments if s.kind == "base"]
        deltas = [s for s in manifest.segments if s.kind != "base"]
        if deltas and sum(s.bytes for s in deltas) >= BASE_SHARE * sum(s.bytes for s in base) and (base or len(deltas) >= FANOUT):
            return base + deltas, "base"
        for tier in sorted({self._tier(s) for s in deltas}):
            if len(same := [s for s in deltas if self._tier(s) == tier]) >= FANOUT:
                return same, "delta"
        return [], ""

    def _laid_out(self, chosen: list[Segment]) -> bool:
        """Does folding ``chosen`` leave rows in the buckets of a new base?"""
        base = [s for s in chosen if s.kind == "base" and s.table]
        if not base or len(chosen) == 1:
            return False
        count = self.spark.sql(f"DESCRIBE FORMATTED {base[0].table}").where("col_name = 'Num Buckets'").first()
        return count is not None and int(count["data_type"]) == self.buckets

    def compact(self, force: bool = False) -> bool:
        """Merge what is due (all, if forced). True if something was merged."""
        if (current := self.current()) is None:
            return False
        chosen, kind = (list(current.segments), "base") if force else self.plan_compaction(current)
        if not chosen or (force and len(chosen) == 1 and chosen[0].kind == "base"):
            return False
        try:
            manifest, lease = self.versions.take(owner="compaction", version=current.version)
        except LookupError:  # other writers have left it behind
            return False
        try:
            some = Manifest(segments=chosen)
            merged = self._segment(self.spark.sql(self.sql(some, seq=True)), kind, self._laid_out(chosen), seq=max(s.seq for s in chosen), stored_seq=True)
            paths = {s.path for s in chosen}

            def replace(m: Manifest):
                if not paths <= {s.path for s in m.segments}:
                    return False
                m.segments = [merged] + [s for s in m.segments if s.path not in paths]

            done = self.versions.commit(replace)
            if done is None:  # another compaction was first
                if merged.table:
                    self.spark.sql(f"DROP TABLE IF EXISTS {merged.table}")
                self.versions.files.delete(merged.path)
                return False
            self._publish(done)
            return True
        finally:
            self.versions.give_back(lease)
