"""Streaming cart state: ``groupBy(cart_id).transformWithState``.

State per cart: MapState item -> quantity, ValueState last cookie write
(epoch ms). Each micro-batch folds the cart's new actions in arrival order
(rules in ``operators.carts``) and emits the entries that changed
(``quantity`` NULL = entry removed). An event-time timer at last write + 7
days clears an idle cart when the watermark passes it.

Item stock comes from a stream-static join with the items table before the
fold. Per micro-batch a cart's actions are sorted in the task; the batch
size (``maxOffsetsPerTrigger`` / ``maxFilesPerTrigger``) bounds that list.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..fixed import CART_TTL_SECONDS

OUTPUT_SCHEMA = "cart_id long, item_id long, quantity long, ts timestamp"


class CartFold(StatefulProcessor):
    """Folds cart actions; emits changed (cart, item, quantity|NULL) rows."""

    def __init__(self, ttl_seconds: int = CART_TTL_SECONDS):
        self.ttl_s = ttl_seconds

    def _expired(self, now_ms: int, last_ms: int) -> bool:
        # whole seconds, like the batch fold
        return now_ms // 1000 - last_ms // 1000 > self.ttl_s

    @staticmethod
    def _ts(ms: int) -> dt.datetime:
        return dt.datetime.fromtimestamp(ms / 1000, dt.timezone.utc).replace(tzinfo=None)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "item_id long", "quantity long")
        self.last = handle.getValueState("last_write", "ts_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        """Fold this batch's actions of one cart on a local copy of its map
        (one state read), then write back only the entries that changed."""
        (cart,) = key
        cur = {k[0]: v[0] for k, v in self.entries.iterator()}
        changed: dict = {}  # item -> (quantity or None, ts_ms)

        def clear(ts):
            for item in cur:
                changed[item] = (None, ts)
            cur.clear()

        last = self.last.get()[0] if self.last.exists() else None
        for r in sorted(rows, key=lambda r: r["arrival"]):
            ts, act, item, q, stock = r["ts_ms"], r["action"], r["item_id"], r["quantity"], r["stock"]
            if act == "add" and not (stock is not None and stock > 0):
                continue  # no cookie write
            if last is not None and self._expired(ts, last):
                clear(ts)  # cookie expired before this action
            if act == "add":
                cur[item] = min(cur.get(item, 0) + max(1, q), stock)
                changed[item] = (cur[item], ts)
            elif act == "update":
                if q <= 0:
                    cur.pop(item, None)
                    changed[item] = (None, ts)
                elif stock is not None:
                    cur[item] = min(q, stock)
                    changed[item] = (cur[item], ts)
            elif act == "remove":
                cur.pop(item, None)
                changed[item] = (None, ts)
            elif act == "clear":
                clear(ts)
            last = ts
        for item, (qty, _) in changed.items():
            if qty is None:
                self.entries.removeKey((item,))
            else:
                self.entries.updateValue((item,), (qty,))
        if last is not None:
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            self.last.update((last,))
            self.handle.registerTimer((last // 1000 + self.ttl_s + 1) * 1000)
        for item, (qty, ts) in changed.items():
            yield Row(cart_id=cart, item_id=item, quantity=qty, ts=self._ts(ts))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        (cart,) = key
        expiry = expiredTimerInfo.getExpiryTimeInMs()
        items = [k[0] for k in self.entries.keys()]
        self.entries.clear()
        self.last.clear()
        for item in items:
            yield Row(cart_id=cart, item_id=item, quantity=None, ts=self._ts(expiry))

    def close(self) -> None:
        pass


def cart_state_stream(actions: DataFrame, items: DataFrame, watermark: str = "0 seconds",
                      ttl_seconds: int = CART_TTL_SECONDS) -> DataFrame:
    """Streaming (cart_id, item_id, quantity|NULL, ts of the change) from a
    stream of cart actions (cart_id, item_id, action, quantity, ts, arrival)."""
    stock = items.select("item_id", F.col("quantity").alias("stock"))
    enriched = (actions.withWatermark("ts", watermark).join(stock, "item_id", "left")
                .withColumn("ts_ms", F.unix_millis("ts")))
    return enriched.groupBy("cart_id").transformWithState(
        statefulProcessor=CartFold(ttl_seconds), outputStructType=OUTPUT_SCHEMA,
        outputMode="Update", timeMode="EventTime")
