"""Stock allocation as a running job: escrowed shares in a ledger.

An item's units are dealt out to shares (one per stream of requests); a
stream allots from its own share alone, so streams don't wait for each other
and no unit can be allotted twice. The ledger is a table of signed movements
per (share, item) that add up to what is left (``plans.changes``, kind sum).

A batch reads the ledger rows of its share and items, allots by the batch
plan (``operators.orders.allocate_orders``: prefix sums over chunks of
arrivals, a hot item isn't one task), writes the order lines, and commits
lines and movements in one manifest: a replayed batch is skipped whole, a
batch that failed has left nothing behind. If the share has been changed since
it was read (``rebalance``, ``restock``, another stream of the same share),
the commit gives up and the batch is computed again.

With one share the lines equal the batch plan's over all requests in order,
wherever the batches are cut. ``rebalance`` deals all that is left anew: units
that one share holds and another lacks are moved, none is made or lost.

Defined results: requests of unknown items and quantities of 0 or less make
no line; an item without units makes lines of 0; negative units stay where
they are dealt and nothing is allotted from them.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import sequences
from ..operators.orders import allocate_orders
from ..plans.changes import ChangeTable
from ..plans.versions import Manifest
from ..session import checkpoint_dir, materialise, release
from .cdc_stream import stream_id


class StockLedger:
    """What is left of each item, by share, and the lines allotted from it."""

    def __init__(self, spark: SparkSession, name: str = "staging.stock", root: str | None = None, shares: int = 1,
                 width: int = sequences.DEFAULT_WIDTH):
        self.spark, self.shares, self.width = spark, shares, width
        self.table = ChangeTable(spark, name, root, keys=("share", "item_id"), kind="sum", public=False)

    def _turns(self, manifest: Manifest | None, shares) -> dict[str, int]:
        """How often each share has been changed."""
        return {f"share:{s}": manifest.applied.get(f"share:{s}", 0) if manifest else 0 for s in shares}

    def _commit(self, movements: DataFrame, turns: dict[str, int], source: str, batch: int, lines: str | None = None) -> bool:
        """Movements (and a folder of lines) in one version, unless the batch
        is there. False: a share has changed since ``turns``."""
        segment, late = self.table._segment(movements), []

        def add(m: Manifest):
            if m.applied.get(source, -1) >= batch:
                return False
            if any(m.applied.get(s, 0) != n for s, n in turns.items()):
                late.append(True)
                return False
            segment.seq, m.next_seq = m.next_seq, m.next_seq + 1
            m.segments.append(segment)
            m.attached += [lines] if lines else []
            m.applied |= {s: n + 1 for s, n in turns.items()} | {source: batch}

        if self.table.versions.commit(add) is None:
            for folder in filter(None, (segment.path, lines)):
                self.table.versions.files.delete(folder)
            return not late
        self.table.compact()
        self.table.versions.vacuum()
        return True

    def _taken(self, source: str, batch: int) -> bool:
        manifest = self.table.versions.current()
        return bool(manifest) and manifest.applied.get(source, -1) >= batch

    def _dealt(self, totals: DataFrame) -> DataFrame:
        """(item_id, units) over the shares, as evenly as whole units go."""
        numbered = totals.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(self.shares - 1))))
        return numbered.select("share", "item_id", F.floor((F.col("units") + F.col("share")) / self.shares).cast("long").alias("units"))

    # -- units --------------------------------------------------------------------

    def restock(self, units: DataFrame, source: str, batch: int = 0) -> None:
        """Add (item_id, units), negative for units taken away, dealt over the shares."""
        if self._taken(source, batch):
            return
        totals = units.filter(F.col("item_id").isNotNull()).groupBy("item_id").agg(F.coalesce(F.sum("units"), F.lit(0)).cast("long").alias("units"))
        while not self._commit(self._dealt(totals), self._turns(self.table.versions.current(), range(self.shares)), source, batch):
            pass

    def left(self, by_share: bool = False) -> DataFrame:
        """(item_id, units) left, also per share; items without any are absent."""
        if self.table.current() is None:
            return self.spark.createDataFrame([], "share int, item_id long, units long" if by_share else "item_id long, units long")
        rows = self.table.read().select("share", "item_id", "units")
        return rows if by_share else rows.groupBy("item_id").agg(F.sum("units").alias("units")).filter(F.col("units") != 0)

    def rebalance(self) -> None:
        """Deal what is left anew: movements that add up to 0 per item."""
        while True:
            current = self.table.current()
            if current is None:
                return
            with self.table.versions.lease() as manifest:
                held = self.table.read(manifest)
                target = self._dealt(held.groupBy("item_id").agg(F.sum("units").cast("long").alias("units")))
                moves = (target.unionByName(held.select("share", "item_id", (-F.col("units")).alias("units")))
                         .groupBy("share", "item_id").agg(F.sum("units").cast("long").alias("units")).filter(F.col("units") != 0))
                turns = self._turns(manifest, range(self.shares))
                number = manifest.applied.get("rebalance", -1) + 1
                if self._commit(moves, turns, "rebalance", number):
                    return

    # -- allotment ------------------------------------------------------------------

    def allot(self, requests: DataFrame, items: DataFrame, source: str, batch: int, share: int = 0) -> None:
        """Allot one batch of requests (as ``allocate_orders`` takes them) from
        a share; ``items`` (item_id, price_ht, price_ttc) are the known ones."""
        if not 0 <= share < self.shares:
            raise ValueError(f"share {share} of {self.shares}")
        if self._taken(source, batch):
            return
        wanted = materialise(requests.select("item_id").filter(F.col("item_id").isNotNull()).distinct(), "wanted")
        while not self._try(requests, items, wanted, source, batch, share):
            pass
        release(wanted)

    def _try(self, requests, items, wanted, source, batch, share) -> bool:
        known = items.select("item_id", "price_ht", "price_ttc")
        if self.table.current() is None:
            turns, stock = self._turns(None, [share]), known.withColumn("quantity", F.lit(0).cast("long"))
            return self._write(requests, stock, turns, source, batch, share)
        with self.table.versions.lease() as manifest:
            held = self.table.only(wanted, "item_id", manifest).filter(F.col("share") == share).select("item_id", "units")
            stock = known.join(wanted, "item_id", "left_semi").join(held, "item_id", "left").select(
                *known.columns, F.coalesce("units", F.lit(0).cast("long")).alias("quantity"))
            return self._write(requests, stock, self._turns(manifest, [share]), source, batch, share)

    def _write(self, requests, stock, turns, source, batch, share) -> bool:
        folder = self.table.versions.new_folder()
        allocate_orders(requests, stock, self.width).write.parquet(folder)
        lines = self.spark.read.parquet(folder)
        taken = lines.filter(F.col("quantity") > 0).groupBy(F.lit(share).alias("share"), "item_id").agg((-F.sum("quantity")).cast("long").alias("units"))
        return self._commit(taken, turns, source, batch, folder)

    def lines(self) -> DataFrame | None:
        """All order lines allotted; None before the first batch."""
        manifest = self.table.versions.current()
        return self.spark.read.parquet(*manifest.attached) if manifest and manifest.attached else None


def start_allocation(spark: SparkSession, requests: DataFrame, items: DataFrame, ledger: StockLedger, share: int = 0,
                     checkpoint: str | None = None, trigger: str = "10 seconds", available_now: bool = False) -> StreamingQuery:
    """Allot a stream of order requests from one share of ``ledger``."""
    ckpt = checkpoint or os.path.join(checkpoint_dir(spark), f"allocation-{share}")

    def each(batch: DataFrame, batch_id: int) -> None:
        ledger.allot(batch, items, stream_id(spark, ckpt), batch_id, share)

    writer = requests.writeStream.foreachBatch(each).option("checkpointLocation", ckpt)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)).start()
