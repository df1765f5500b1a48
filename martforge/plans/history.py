"""Checks of new changes against a table's whole history, by Bloom filters.

``Filters`` keeps, for every segment of a change table, Bloom filters of some
columns: one of the whole segment and one of each of its files. A filter is
itself a small table of 64-bit words: a value's hash names a word and five bits
in it, so building it is one ``bit_or`` per word (combined map side, whatever
value a third of all rows share), and asking it is a join on the word number.
Segments never change, so a filter is built once, before it is first asked; a
batch costs the filters of its own segment, a compaction those of what it has
rewritten.

A question ("which rows hold one of these values?") goes to the segments'
filters first; only values that pass meet the files' filters; only files that
pass are read, and the exact join over them decides. A filter passes every
value it has taken (never a wrong no) and, at 16 bits a value, fewer than one
in a hundred others.

If the filters let most files through for the changed keys, asking saves
nothing: the check then takes one pass over all rows and only what differs
from the violations kept is written. For that only keys are asked, so the other
columns' filters wait for a question, as do all of them at a first refresh.

``UniqueCheck`` and ``ForeignKeyCheck`` keep a check's violations up to date: a
refresh takes the keys changed since the versions it has seen and looks anew
at the values, or rows, that these changes touch. Results equal a check of all
rows. NULL isn't a repeated value; a NULL reference is a missing parent, as in
``operators.quality``. The versions seen are held by leases, since the value a
row had before is needed to see that it has left it.

Only names of files come to the driver, which lists them for a scan anyway.
"""

from __future__ import annotations

import json
import math
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import live_row
from ..operators.staging import latest_per_key
from ..session import materialise, release
from .changes import SEQ, ChangeTable
from .incremental import HOLD_SECONDS
from .versions import Manifest, Segment

#: Bits of a filter for each value, and bits that a value sets.
BITS = 16
SET = 5
#: Share of a table's files that the filters let through above which a check looks at all rows anew.
MOST = 0.5
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def hash_of(value: Column, kind: str) -> Column:
    """The same for a number whatever its width, as columns widen; NULL for NULL."""
    plain = value.cast("double") + F.lit(0.0) if kind.startswith(_NUMBERS) else value.cast("string")
    return F.when(value.isNotNull(), F.xxhash64(plain))


def mask_of(h: Column) -> Column:
    """The bits that a hash sets in its word."""
    h = F.xxhash64(h, F.lit(1))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * k).bitwiseAND(F.lit(63)).cast("int"))
    return reduce(lambda a, b: a.bitwiseOR(b), [bit(k) for k in range(SET)])


def words_for(values: int) -> int:
    return max(1, math.ceil(values * BITS / 64))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.union(b), parts)


class Filters:
    """Bloom filters of ``columns`` (and the key) of a change table."""

    def __init__(self, table: ChangeTable, columns=()):
        self.table, self.spark, self.files = table, table.spark, table.versions.files
        self.key = table.keys[0]
        self.columns = tuple(dict.fromkeys((self.key, *columns)))
        self.folder = f"{table.versions.folder}/filters"

    # -- building -----------------------------------------------------------

    def _home(self, s: Segment) -> str:
        return f"{self.folder}/{s.path.rsplit('/', 1)[1]}"

    def index(self, manifest: Manifest, columns=None) -> int:
        """Build what the segments of ``manifest`` lack, of all columns or
        some; how many lacked something."""
        built = 0
        for s in manifest.segments:
            there = self.files.names(self._home(s))
            if missing := [c for c in columns or self.columns if c in s.columns and f"{c}.json" not in there]:
                self._build(s, missing)
                built += 1
        return built

    def _build(self, s: Segment, columns: list[str]) -> None:
        fields = ", ".join(f"`{c}` {s.columns[c]}" for c in columns)  # an empty segment has no file to tell them
        # files and columns as numbers: keys of a fixed width. Files whose names had one hash would share their words, which only lets more through
        rows = self.spark.read.schema(fields).parquet(s.path).withColumn("file", F.xxhash64("_metadata.file_name"))
        counts = rows.groupBy("file").agg(*[F.count(c).alias(f"n{k}") for k, c in enumerate(columns)])
        most = counts.select(*[F.struct(F.sum(f"n{k}"), F.max(f"n{k}")) for k in range(len(columns))]).first()
        sizes = {c: [words_for(n or 0) for n in both] for c, both in zip(columns, most, strict=True)}
        names = [(n,) for n in self.files.names(s.path) if not n.startswith(("_", "."))]
        names = self.spark.createDataFrame(names, "file string").select("file", F.xxhash64("file").alias("h"))
        path = f"{self._home(s)}/{uuid.uuid4().hex}"
        for level, (name, of) in enumerate((("whole", []), ("files", ["file"]))):
            entry = lambda k, c: F.struct(F.lit(k).alias("k"), hash_of(F.col(c), s.columns[c]).alias("h"), F.lit(sizes[c][level]).cast("long").alias("words"))  # noqa: B023, E731
            values = rows.select(*of, F.inline(F.array(*[entry(k, c) for k, c in enumerate(columns)]))).where(F.col("h").isNotNull())
            bits = values.groupBy("k", *of, F.pmod("h", F.col("words")).alias("word")).agg(F.bit_or(mask_of(F.col("h"))).alias("bits"))
            bits = bits.withColumn("column", F.element_at(F.array(*map(F.lit, columns)), F.col("k") + 1)).drop("k")
            if of:
                bits = bits.withColumnRenamed("file", "h").join(F.broadcast(names), "h").drop("h")
            bits.write.partitionBy("column").parquet(f"{path}/{name}")
        for c in columns:  # a filter counts from here on; of two builders one is first
            self.files.create(f"{self._home(s)}/{c}.json", json.dumps({"path": path, "words": sizes[c][0], "file_words": sizes[c][1]}))

    def prune(self) -> list[str]:
        """Remove the filters of segments that are no more."""
        data = set(self.files.names(f"{self.table.versions.folder}/data"))
        gone = [f"{self.folder}/{n}" for n in self.files.names(self.folder) if n not in data]
        for path in gone:
            self.files.delete(path)
        return gone

    # -- asking -------------------------------------------------------------

    def _words(self, meta: dict, level: str, column: str, fields: str) -> DataFrame:
        path = f"{meta['path']}/{level}/column={column}"
        there = bool(self.files.names(path))  # a column of NULLs only has no words
        return self.spark.read.schema(fields).parquet(path) if there else self.spark.createDataFrame([], fields)

    def files_with(self, values: DataFrame, column: str, manifest: Manifest) -> dict[str, list[str]]:
        """Segment -> names of its files that may hold one of ``values`` (one column)."""
        value, kind = F.col(values.columns[0]), values.dtypes[0][1]
        wanted = values.select(hash_of(value, kind).alias("h")).where(F.col("h").isNotNull()).distinct().withColumn("m", mask_of(F.col("h")))
        passes = F.col("bits").bitwiseAND(F.col("m")) == F.col("m")
        found, parts = {}, []
        for k, s in enumerate(manifest.segments):
            if column not in s.columns:
                continue
            if f"{column}.json" not in self.files.names(self._home(s)):  # not indexed yet
                found[s.path] = [n for n in self.files.names(s.path) if not n.startswith(("_", "."))]
                continue
            meta = json.loads(self.files.read(f"{self._home(s)}/{column}.json"))
            of = lambda words: wanted.withColumn("word", F.pmod("h", F.lit(words)).cast("long"))
            some = of(meta["words"]).join(self._words(meta, "whole", column, "word long, bits long"), "word").where(passes).select("h", "m")
            some = some.withColumn("word", F.pmod("h", F.lit(meta["file_words"])).cast("long"))
            some = some.join(self._words(meta, "files", column, "file string, word long, bits long"), "word").where(passes)
            parts.append(some.select(F.lit(k).alias("segment"), "file").distinct())
        for k, name in _union(parts).collect() if parts else []:
            found.setdefault(manifest.segments[k].path, []).append(name)
        return found

    def passes_most(self, values: DataFrame, column: str, manifest: Manifest) -> bool:
        """Do the filters let through more than ``MOST`` of the files for
        ``values``? Then a whole pass reads hardly more than they would."""
        found = self.files_with(values, column, manifest)
        files = sum(1 for s in manifest.segments for n in self.files.names(s.path) if not n.startswith(("_", ".")))
        return sum(len(names) for names in found.values()) > MOST * files

    def rows_with(self, values: DataFrame, column: str, shown: list[str], manifest: Manifest) -> DataFrame:
        """``shown`` and the commit of all stored rows (also such as later ones
        have replaced) whose ``column`` is among ``values``: exact; only files
        that may hold one are read."""
        types = self.table.columns(manifest)
        shown = list(dict.fromkeys([column, *shown]))
        found, parts = self.files_with(values, column, manifest), []
        for s in manifest.segments:
            if names := sorted(found.get(s.path, [])):
                rows = self.spark.read.parquet(*[f"{s.path}/{n}" for n in names])
                cell = lambda c: (F.col(c) if c in s.columns else F.lit(None)).cast(types.get(c, "string")).alias(c)
                seq = F.col(SEQ) if s.stored_seq else F.lit(s.seq).cast("long").alias(SEQ)
                parts.append(rows.select(*map(cell, shown), seq))
        if not parts:
            return self.spark.createDataFrame([], ", ".join(f"`{c}` {types.get(c, 'string')}" for c in shown) + f", {SEQ} long")
        among = values.select(F.col(values.columns[0]).alias("__among"))
        return _union(parts).join(among, F.col(column) == F.col("__among"), "left_semi")

    def images(self, ids: DataFrame, shown: list[str], manifest: Manifest) -> DataFrame:
        """The live rows of ``ids`` (one column) as of ``manifest``: key and ``shown``."""
        order = [*self.table.order, SEQ]
        rows = self.rows_with(ids, self.key, [*shown, *self.table.order, "__deleted"], manifest)
        return latest_per_key(rows, self.key, order).where(live_row()).select(self.key, *shown)


class _KeptCheck:
    """A check whose violations are kept; see ``UniqueCheck``, ``ForeignKeyCheck``."""

    def __init__(self, spark: SparkSession, name: str, filters: dict[str, Filters], root: str | None = None):
        self.spark, self.name, self.filters = spark, name, filters
        self.slug = f"{self.kind}_{name.replace('.', '_')}"  # two checks may share a name
        self.store = ChangeTable(spark, f"dmart.dq_{self.slug}__kept", root, keys=("key",), order=(), public=False)

    def _live(self, table: str, shown: list[str], manifest: Manifest) -> DataFrame:
        return self.filters[table].table.read(manifest).where(live_row()).select("id", *shown) if manifest.segments else None

    def refresh(self, compact: bool = True) -> bool:
        """Take what changed since the last refresh. True if anything did."""
        before = self.store.versions.current()
        seen = dict(before.applied) if before else {}
        tables = {t: f.table for t, f in self.filters.items() if t in self.sources}
        owner = {t: f"dq-{self.slug}-{t}" for t in tables}
        now, holds = {}, {}
        for t, table in tables.items():
            now[t], holds[t] = table.versions.take(HOLD_SECONDS, owner=owner[t])
        old = {t: tables[t].versions.manifest(seen[t]) if seen.get(t) else None for t in tables}
        fresh = [t for t in tables if old[t] is None or now[t].next_seq > old[t].next_seq]
        if not fresh:
            for t, hold in holds.items():
                tables[t].versions.give_back(hold)
            return False
        first = not seen
        changed, most = {}, False
        for t in fresh if not first else ():
            self.filters[t].index(now[t], [self.filters[t].key])
            changed[t] = materialise(tables[t].changed(old[t].next_seq - 1, now[t]), "changed")
            if most := self.filters[t].passes_most(changed[t], self.filters[t].key, now[t]):
                break  # all rows are looked at
        if first:
            rows, used = self._all(now), []
        elif most:
            rows, used = self._differences(now)
        else:
            for t, m in [(t, m) for t in tables for m in (old[t], now[t]) if m]:
                self.filters[t].index(m)
            rows, used = self._again(changed, old, now)
        segment = self.store._segment(rows)

        def add(m: Manifest):
            if m.applied != seen:
                return False  # another refresh was first
            segment.seq, m.next_seq = m.next_seq, m.next_seq + 1
            m.segments.append(segment)
            m.applied = {t: now[t].version for t in tables}

        done = self.store.versions.commit(add)
        release(*used, *changed.values())
        for t, table in tables.items():  # hold what has been seen, and nothing older
            if done is None:
                table.versions.give_back(holds[t])
                continue
            for _, _, lease in table.versions._leases():
                if f".{owner[t]}." in lease and not holds[t].endswith(f"/{lease}"):
                    table.versions.give_back(f"{table.versions.folder}/leases/{lease}")
            self.filters[t].prune()
        if done is None:
            self.store.versions.files.delete(segment.path)
            return False
        if compact:
            self.store.compact()
        return True


class UniqueCheck(_KeptCheck):
    """Values of ``table.column`` that several live rows hold."""

    kind = "unique"

    def __init__(self, spark, name: str, table: str, column: str, filters, root=None):
        self.sources, self.of, self.column = (table,), table, column
        super().__init__(spark, name, filters, root)

    def _counted(self, rows: DataFrame) -> DataFrame:
        return rows.where(F.col(self.column).isNotNull()).groupBy(self.column).agg(F.count(F.lit(1)).alias("n"))

    def _all(self, now):
        counts = self._counted(self._live(self.of, [self.column], now[self.of]))
        return counts.where(F.col("n") > 1).select(F.col(self.column).cast("string").alias("key"), "n")

    def _differences(self, now):
        found = materialise(self._all(now), "found")
        kept = self.store.read().where(F.col("n") > 1).select("key", "n")
        gone = kept.join(found, "key", "left_anti").select("key", F.lit(0).cast("long").alias("n"))
        return found.join(kept, ["key", "n"], "left_anti").select("key", "n").unionByName(gone), [found]

    def _again(self, changed, old, now):
        f, t, c = self.filters[self.of], self.of, self.column
        touched = [f.rows_with(changed[t], f.key, [c], m).select(F.col(c).cast(f.table.columns(now[t])[c]).alias(c)) for m in (old[t], now[t])]
        values = materialise(_union(touched).where(F.col(c).isNotNull()).distinct(), "values")
        holders = materialise(f.rows_with(values, c, [f.key], now[t]).select(f.key).distinct(), "holders")
        counts = self._counted(f.images(holders, [c], now[t]))
        rows = values.join(counts, c, "left").select(F.col(c).cast("string").alias("key"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))
        return rows, [values, holders]

    def read(self) -> DataFrame:
        """(check, key, n), as ``quality.dq_unique``."""
        return self.store.read().where(F.col("n") > 1).select(F.lit(self.name).alias("check"), "key", "n")


class ForeignKeyCheck(_KeptCheck):
    """Live rows of ``child`` whose ``column`` is no live row of ``parent``."""

    kind = "foreign"

    def __init__(self, spark, name: str, child: str, column: str, parent: str, filters, root=None):
        self.sources, self.child, self.column, self.parent = (child, parent), child, column, parent
        super().__init__(spark, name, filters, root)

    @staticmethod
    def _orphans(children: DataFrame, parents: DataFrame) -> DataFrame:
        return children.toDF("key", "parent_id").join(parents.toDF("parent_id"), "parent_id", "left_anti")

    def _all(self, now):
        children, parents = self._live(self.child, [self.column], now[self.child]), self._live(self.parent, [], now[self.parent])
        return self._orphans(children, parents).select("key", "parent_id", F.lit(True).alias("missing"))

    def _differences(self, now):
        found = materialise(self._all(now), "found")
        kept = self.store.read().where("missing").select("key", F.col("parent_id").alias("was"))
        gone = kept.join(found, "key", "left_anti").select("key", F.col("was").alias("parent_id"), F.lit(False).alias("missing"))
        same = (found["key"] == kept["key"]) & found["parent_id"].eqNullSafe(kept["was"])
        return found.join(kept, same, "left_anti").unionByName(gone), [found]

    def _again(self, changed, old, now):
        child, parent, c = self.filters[self.child], self.filters[self.parent], self.column
        parts = [changed[self.child].toDF("key")] if self.child in changed else []
        if self.parent in changed:  # the children of parents that came or went
            parts.append(child.rows_with(changed[self.parent], c, [child.key], now[self.child]).select(F.col(child.key).alias("key")))
        ids = materialise(_union(parts).distinct(), "children")
        rows = materialise(child.images(ids, [c], now[self.child]), "images")
        asked = materialise(rows.where(F.col(c).isNotNull()).select(c).distinct(), "parents")
        orphans = self._orphans(rows, parent.images(asked, [], now[self.parent])).withColumn("missing", F.lit(True))
        out = ids.join(orphans, "key", "left").select("key", "parent_id", F.coalesce("missing", F.lit(False)).alias("missing"))
        return out, [ids, rows, asked]

    def read(self) -> DataFrame:
        """(check, id, parent_id), as ``quality.dq_foreign_keys``."""
        return self.store.read().where("missing").select(F.lit(self.name).alias("check"), F.col("key").alias("id"), "parent_id")


#: check -> (table, column), and check -> (child, column, parent), of the staging tables.
UNIQUE = {"customers.email": ("customers", "email"), "admins.email": ("admins", "email"), "invoices.invoice_number": ("invoices", "invoice_number"),
          "invoices.order_id": ("invoices", "order_id"), "payments.order_id": ("payments", "order_id")}
FOREIGN = {"orders.customer_id": ("orders", "customer_id", "customers"), "order_items.order_id": ("order_items", "order_id", "orders"),
           "order_items.item_id": ("order_items", "item_id", "items"), "payments.order_id": ("payments", "order_id", "orders"),
           "invoices.order_id": ("invoices", "order_id", "orders")}


def kept_checks(spark: SparkSession, staging: dict[str, ChangeTable], root: str | None = None, unique=None, foreign=None) -> list[_KeptCheck]:
    """The checks over ``staging``, sharing one set of filters per table."""
    unique, foreign = UNIQUE if unique is None else unique, FOREIGN if foreign is None else foreign
    columns = {t: [c for own, c in unique.values() if own == t] + [c for own, c, _ in foreign.values() if own == t] for t in staging}
    filters = {t: Filters(table, columns[t]) for t, table in staging.items()}
    return ([UniqueCheck(spark, n, t, c, filters, root) for n, (t, c) in unique.items()]
            + [ForeignKeyCheck(spark, n, t, c, p, filters, root) for n, (t, c, p) in foreign.items()])
