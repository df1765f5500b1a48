"""Re-order suggestions kept up to date: a bounded heap of items per customer.

Beside the purchases (a kept sum per customer and item) each customer has one
row: the ``k + spare`` greatest ids of items bought and in stock, and a floor.
What was bought, is in stock and isn't below the floor is in the heap; without
a floor the heap holds everything. So

* an item that sells out, or a purchase taken back, leaves the heaps that hold
  it; other customers are not touched;
* an item that comes back, or a new purchase, enters the heaps of its buyers
  whose floor isn't above it;
* only a heap that falls below ``k`` and has a floor is filled anew from the
  customer's purchases. The spare places make that rare.

A heap is at most ``k + spare`` ids; the best of a customer's candidates are
cut to that by a ranked window before they are gathered. Only rows that differ
are written. After a batch that brought a LARGE share of the purchases or items
nearly every heap is touched: all are made anew and compared with those stored. The versions of purchases and items that a heap holds are in the
commit that writes it: a refresh that failed is simply run again. Purchases
are compacted after that, since a compaction forgets pairs that are gone.

Results equal ``operators.shop.reorder_suggestions`` over the versions seen;
orders without a customer have no suggestions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixed import REORDER_TOP_K
from ..operators import dwh
from ..session import materialise, release
from .changes import SEQ, ChangeTable
from .incremental import HOLD_SECONDS, Change, Kept, KeptMart, _COUNT, _confirmed_lines, _keys, _n, _signed, large
from .versions import Manifest


def _bought(change: Change, orders: DataFrame | None) -> DataFrame:
    pairs = _confirmed_lines(change, orders, ["item_id", "customer_id"]).where(F.col("customer_id").isNotNull())
    return _signed(pairs, {c: F.col(c) for c in ("customer_id", "item_id")}, {"n": (_n, _COUNT)})


PURCHASES = Kept(("orders", "order_items"), ("customer_id", "item_id"), "sum", Change.orders, _bought, lambda rows: rows)
_OWNER = "reorder-items"


class KeptSuggestions:
    """Suggestions, refreshed from the change tables of orders, lines and items."""

    def __init__(self, spark: SparkSession, staging: dict[str, ChangeTable], root: str | None = None, k: int = REORDER_TOP_K, spare: int = REORDER_TOP_K):
        self.spark, self.staging, self.k, self.cap = spark, staging, k, k + spare
        self.purchases = KeptMart(spark, "customer_purchases", staging, root, PURCHASES)
        self.heaps = ChangeTable(spark, "dmart.reorder_suggestions__kept", root, keys=("customer_id",), kind="latest", order=(), public=False)

    # -- the sources at one version ---------------------------------------------

    def _in_stock(self, manifest: Manifest, items: DataFrame | None = None) -> DataFrame:
        table = self.staging["items"]
        rows = table.read(manifest) if items is None else table.only(items, "id", manifest)
        return dwh.LOADS["items"](rows).where(F.col("quantity") > 0).select("item_id")

    def _pairs_of(self, manifest: Manifest, keys: DataFrame | None, column: str = "customer_id") -> DataFrame:
        """(customer_id, item_id) that are bought."""
        rows = self.purchases.store.read(manifest) if keys is None else self.purchases.store.only(keys, column, manifest)
        return rows.where(F.col("n") > 0).select("customer_id", "item_id")

    def _changed_pairs(self, manifest: Manifest, after: int) -> DataFrame:
        store, kinds = self.purchases.store, self.purchases.store.columns(manifest)
        parts = [store._rows(s, kinds, f"WHERE `{SEQ}` > {after}" if s.stored_seq else "") for s in manifest.segments if s.seq > after]
        if not parts:
            return self.spark.createDataFrame([], "customer_id long, item_id long")
        return self.spark.sql("SELECT DISTINCT customer_id, item_id FROM (" + " UNION ALL ".join(parts) + ")")

    # -- heaps ----------------------------------------------------------------------

    def _heaps(self, entries: DataFrame, floors: DataFrame | None = None) -> DataFrame:
        """customer_id, floor, items: the best ``cap`` of each customer's
        entries; the floor is the least of them if there are more, else the
        one of ``floors``."""
        rank = F.row_number().over(Window.partitionBy("customer_id").orderBy(F.desc("item_id")))
        best = entries.distinct().withColumn("rank", rank).where(F.col("rank") <= self.cap + 1)
        kept = F.col("rank") <= self.cap
        out = best.groupBy("customer_id").agg(F.reverse(F.array_sort(F.collect_list(F.when(kept, F.col("item_id"))))).alias("items"),
                                              F.when(F.max("rank") > self.cap, F.min(F.when(kept, F.col("item_id")))).alias("own"))
        if floors is None:
            return out.select("customer_id", F.col("own").alias("floor"), "items")
        return floors.join(out, "customer_id", "left").select(
            "customer_id", F.coalesce("own", "floor").alias("floor"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"))

    def refresh(self) -> bool:
        """Take what changed since the last refresh. True if any heap changed."""
        self.purchases.refresh(compact=False)
        bought = self.purchases.store.current()
        seen = (self.heaps.versions.current() or Manifest()).applied
        if bought is None:
            return False
        now, hold = self.staging["items"].versions.take(HOLD_SECONDS, owner=_OWNER)
        first = "items" not in seen
        if first or large(self.purchases.store, seen["pairs"], bought) or large(self.staging["items"], seen["item_changes"], now):
            rows = self._heaps(self._pairs_of(bought, None).join(self._in_stock(now), "item_id", "left_semi"))
            rows = materialise(rows if first else self._differing(rows), "heaps")
        else:
            rows = self._changed_heaps(bought, now, seen)
        changed = first or not rows.isEmpty()
        segment = self.heaps._segment(rows) if changed else None

        def add(m: Manifest):
            if m.applied != seen:
                return False  # another refresh was first
            if segment:
                segment.seq, m.next_seq = m.next_seq, m.next_seq + 1
                m.segments.append(segment)
            m.applied = {"pairs": bought.next_seq - 1, "items": now.version, "item_changes": now.next_seq - 1}

        done = self.heaps.versions.commit(add)
        release(rows)
        if done is None:
            self.staging["items"].versions.give_back(hold)
            if segment:
                self.heaps.versions.files.delete(segment.path)
            return False
        items = self.staging["items"].versions
        for version, _, name in items._leases():  # hold the version seen, by one lease
            lease = f"{items.folder}/leases/{name}"
            if f".{_OWNER}." in name and lease != hold:
                items.give_back(lease)
        self.purchases.store.compact()
        self.heaps.compact()
        return changed

    def _changed_heaps(self, bought: Manifest, now: Manifest, seen: dict[str, int]) -> DataFrame:
        """The rows of heaps that differ."""
        pairs = materialise(self._changed_pairs(bought, seen["pairs"]), "pairs")
        moved = _keys(self.staging["items"].changed(seen["item_changes"], now)) if now.next_seq - 1 > seen["item_changes"] else None
        written = [pairs]
        if moved is None:
            moved = self.spark.createDataFrame([], "key long")
        # items whose being in stock changed; all that changed, if the version seen is gone
        old = self.staging["items"].versions.manifest(seen["items"])
        stocked = self._in_stock(now, moved)
        before = self._in_stock(old, moved) if old else None
        back = materialise(stocked.join(before, "item_id", "left_anti") if before is not None else stocked, "back")
        gone = materialise((before if before is not None else moved.toDF("item_id")).join(stocked, "item_id", "left_anti"), "gone")
        # purchases that are new or taken back
        still = materialise(self._pairs_of(bought, pairs.select("customer_id").distinct()).join(pairs, ["customer_id", "item_id"], "left_semi"), "still")
        undone = pairs.join(still, ["customer_id", "item_id"], "left_anti")
        usable = self._in_stock(now, still.select("item_id").distinct())
        entering = materialise(still.join(usable, "item_id", "left_semi").unionByName(self._pairs_of(bought, back, "item_id")).distinct(), "entering")
        # the customers whose heaps may differ
        held = self.heaps.read().select("customer_id", F.explode("items").alias("item_id"))
        losing = held.join(gone, "item_id", "left_semi").unionByName(held.join(undone, ["customer_id", "item_id"], "left_semi"))
        touched = materialise(losing.select("customer_id").unionByName(entering.select("customer_id")).distinct(), "touched")
        mine = self.heaps.only(touched)
        floors = touched.join(mine.select("customer_id", "floor"), "customer_id", "left")
        staying = (mine.select("customer_id", F.explode("items").alias("item_id")).join(gone, "item_id", "left_anti")
                   .join(undone, ["customer_id", "item_id"], "left_anti"))
        coming = entering.join(floors, "customer_id").where(F.col("floor").isNull() | (F.col("item_id") >= F.col("floor")))
        fresh = materialise(self._heaps(staying.unionByName(coming.select("customer_id", "item_id")), floors), "fresh")
        short = F.col("floor").isNotNull() & (F.size("items") < self.k)
        low = materialise(fresh.where(short).select("customer_id"), "low")
        refill = self._heaps(self._pairs_of(bought, low).join(self._in_stock(now), "item_id", "left_semi"),
                             low.withColumn("floor", F.lit(None).cast("long")))
        result = fresh.where(~short).unionByName(refill)
        same = mine.select("customer_id", F.col("floor").alias("f"), F.col("items").alias("i"))
        changed = (result.join(same, "customer_id", "left")
                   .where(~(F.col("floor").eqNullSafe(F.col("f")) & F.col("items").eqNullSafe(F.col("i")))).select("customer_id", "floor", "items"))
        out = materialise(changed, "heaps")
        release(*written, back, gone, still, entering, touched, fresh, low)
        return out

    def _differing(self, heaps: DataFrame) -> DataFrame:
        """Of all heaps those that aren't stored so; empty ones of customers who have none."""
        stored = self.heaps.read().select("customer_id", F.col("floor").alias("f"), F.col("items").alias("i"))
        both = heaps.join(stored, "customer_id", "full_outer").withColumn("items", F.coalesce("items", F.array().cast("array<bigint>")))
        return both.where(~(F.col("floor").eqNullSafe(F.col("f")) & F.col("items").eqNullSafe(F.col("i")))).select("customer_id", "floor", "items")

    def read(self) -> DataFrame:
        """The suggestions at the versions seen."""
        items = self.staging["items"]
        seen = items.versions.manifest(self.heaps.versions.current().applied["items"])
        ranked = self.heaps.read().select("customer_id", F.posexplode(F.slice("items", 1, self.k)).alias("pos", "item_id"))
        shown = dwh.LOADS["items"](items.read(seen)).select("item_id", "title", "price_ttc", "quantity")
        return ranked.join(shown, "item_id").select("item_id", "customer_id", "title", "price_ttc", "quantity", (F.col("pos") + 1).cast("int").alias("rank"))
