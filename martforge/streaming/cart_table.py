"""Cart state kept as a table by a stream, without a per-row fold.

A micro-batch's actions become one map per cart and one per (cart, item)
(``operators.carts.batch_effects``: reset, replaced base, added units, cap).
Such maps compose, so the batch is aggregated in the JVM, combined map-side,
with a hot cart's actions spread over tasks; then each map is applied once to
the row that the state table holds.

The table has a row per cart (its last reset, last write) and a row per
(cart, item). A reset doesn't touch the entries: an entry counts if it was
written after its cart's last reset. So a batch writes only what it touches,
and reads only the rows of those keys. Cart and entry rows of a batch are one
segment: a replayed batch is skipped whole.

Carts expire when they are read (7 days after the last write, as the batch
fold has it), or before their next write. Batches take a cart's actions in
arrival order; stock is that of the ``items`` at each batch. NULL cart or
item ids: actions without a cart are dropped, those without an item act as
for an unknown item.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..fixed import CART_TTL_SECONDS
from ..operators import sequences
from ..operators.carts import batch_effects, live_cart, quantity_after
from ..plans.changes import ChangeTable
from ..session import checkpoint_dir, materialise, release
from .cdc_stream import stream_id

_SCHEMA = "key string, cart_id long, item_id long, quantity long, written long, reset_point long, last_ts timestamp, cleared boolean, batch long"


class CartTable:
    """Cart state in ``name``, a table of changes."""

    def __init__(self, spark: SparkSession, name: str = "staging.cart_state", root: str | None = None,
                 ttl_seconds: int = CART_TTL_SECONDS, width: int = sequences.DEFAULT_WIDTH):
        self.spark, self.ttl, self.width = spark, ttl_seconds, width
        self.table = ChangeTable(spark, name, root, keys=("key",), order=("batch",), public=False)

    @staticmethod
    def _key(item: Column | None = None) -> Column:
        return F.concat_ws(":", F.col("cart_id").cast("string"), F.lit("") if item is None else F.coalesce(item.cast("string"), F.lit("none")))

    def _held(self, keys: DataFrame) -> DataFrame:
        """The state rows of ``keys``."""
        return self.table.only(keys) if self.table.current() else self.spark.createDataFrame([], _SCHEMA)

    def take(self, actions: DataFrame, items: DataFrame, source: str, batch: int) -> None:
        """Apply one batch of actions (cart_id, item_id, action, quantity, ts, arrival)."""
        current = self.table.current()
        if current and current.applied.get(source, -1) >= batch:
            return
        carts, entries = (materialise(part, "cart-effects") for part in
                          batch_effects(actions.filter(F.col("cart_id").isNotNull()), items, self.ttl, self.width))
        keys = materialise(carts.select(self._key().alias("key")).unionByName(entries.select(self._key(F.col("item_id")).alias("key"))), "cart-keys")
        held = self._held(keys)
        old_carts = held.filter(F.col("item_id").isNull() & F.col("last_ts").isNotNull()).select(
            "cart_id", F.col("reset_point").alias("old_reset"), F.col("last_ts").alias("old_ts"))
        expired = F.unix_seconds("first_ts") - F.unix_seconds("old_ts") > self.ttl
        heads = materialise(carts.join(old_carts, "cart_id", "left").select(
            "cart_id", F.greatest("old_reset", "reset_point", F.when(expired, F.col("first_arrival") * 2 - 1)).alias("reset_point"),
            F.col("last.ts").alias("last_ts"), F.col("last.cleared").alias("cleared")), "cart-heads")
        old_entries = held.filter(F.col("last_ts").isNull()).select(
            "key", F.col("quantity").alias("old_quantity"), F.col("written").alias("old_written"))
        applied = (entries.withColumn("key", self._key(F.col("item_id"))).join(old_entries, "key", "left")
                   .join(heads.select("cart_id", "reset_point"), "cart_id"))
        stands = F.col("reset_point").isNull() | (F.col("old_written") * 2 > F.col("reset_point"))
        base = F.when(F.col("is_set"), F.col("base")).otherwise(F.when(stands, F.col("old_quantity")))
        void = lambda kind: F.lit(None).cast(kind)
        number = F.lit(batch).cast("long").alias("batch")
        rows = applied.select("key", "cart_id", "item_id", quantity_after(base).alias("quantity"), F.col("written").cast("long").alias("written"),
                              void("long").alias("reset_point"), void("timestamp").alias("last_ts"), void("boolean").alias("cleared"), number)
        tops = heads.select(self._key().alias("key"), "cart_id", void("long").alias("item_id"), void("long").alias("quantity"), void("long").alias("written"),
                            F.col("reset_point").cast("long").alias("reset_point"), "last_ts", "cleared", number)
        self.table.append(rows.unionByName(tops), source=source, batch=batch)
        release(carts, entries, keys, heads)
        self.table.compact()
        self.table.versions.vacuum()

    def read(self, as_of=None) -> DataFrame:
        """(cart_id, item_id, quantity) of every live cart at ``as_of``."""
        rows = self.table.read() if self.table.current() else self.spark.createDataFrame([], _SCHEMA)
        heads = rows.filter(live_cart(F.col("last_ts"), F.col("cleared"), as_of, self.ttl)).select("cart_id", F.col("reset_point").alias("at"))
        return (rows.filter(F.col("last_ts").isNull() & F.col("quantity").isNotNull()).select("cart_id", "item_id", "quantity", "written").join(heads, "cart_id")
                .filter(F.col("at").isNull() | (F.col("written") * 2 > F.col("at"))).select("cart_id", "item_id", "quantity"))


def start_cart_table(spark: SparkSession, actions: DataFrame, items: DataFrame, carts: CartTable, checkpoint: str | None = None,
                     trigger: str = "10 seconds", available_now: bool = False) -> StreamingQuery:
    """Keep ``carts`` up to date from a stream of cart actions."""
    ckpt = checkpoint or os.path.join(checkpoint_dir(spark), "cart_table")

    def each(batch: DataFrame, batch_id: int) -> None:
        carts.take(batch, items, stream_id(spark, ckpt), batch_id)

    writer = actions.writeStream.foreachBatch(each).option("checkpointLocation", ckpt)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)).start()
