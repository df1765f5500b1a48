"""Cart state from cart actions, as a batch fold (the streaming form lives in
``streaming.cart_state``).

Actions per (cart_id, item_id, action, quantity, ts, arrival):

* ``add``: ignored if the item is unknown or out of stock; else
  entry = min(entry + max(1, q), stock);
* ``update``: q <= 0 removes the entry; a known item gets min(q, stock); an
  unknown item is left as is (the cookie is still rewritten);
* ``remove``: removes the entry; ``clear`` (order confirmed) empties the cart;
* the cookie lives 7 days after its last write: an action after a longer
  gap starts from an empty cart, and a cart idle for 7 days at ``as_of`` is
  gone.

With stock fixed during the fold, successive adds after the last reset or
``update`` of an entry total min(base + sum(max(1, q)), stock), so the state
is a few aggregates per (cart, item) instead of a sequential loop. The only
sequential piece -- the gap to the previous write of a cart -- uses the
chunked ``previous_value``, so a hot cart is not one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import CART_TTL_SECONDS
from . import sequences


def batch_effects(actions: DataFrame, items: DataFrame, ttl_seconds: int = CART_TTL_SECONDS,
                  width: int = sequences.DEFAULT_WIDTH) -> tuple[DataFrame, DataFrame]:
    """What a batch of actions does to any cart state before it.

    Per cart: first_ts and first_arrival of its writes, ``reset_point`` (twice
    the arrival of the last reset within the batch, +1 if that action is a
    clear, -1 if the cart had expired before it), ``last`` (ts, cleared).
    Per (cart, item) after that reset: ``is_set`` with ``base`` (the entry is
    replaced; NULL: removed), ``added`` units up to ``stock`` on top, and
    ``written`` (last arrival). Both are aggregates, combined map-side."""
    stock = items.select("item_id", F.col("quantity").alias("stock"))
    a = actions.join(stock, "item_id", "left")
    act, q, s = F.col("action"), F.col("quantity"), F.col("stock")
    addable = s.isNotNull() & (s > 0)
    writes = (((act == "add") & addable) | act.isin("update", "remove", "clear"))
    eff = a.filter(writes)

    # cart-level resets: clear, or a gap longer than the cookie lifetime
    gaps = sequences.previous_value(eff, ["cart_id"], ["arrival"], "ts", out="prev_ts", width=width)
    expired_before = (F.unix_seconds("ts") - F.unix_seconds("prev_ts")) > ttl_seconds
    point = (F.when(act == "clear", F.col("arrival") * 2 + 1)
             .when(expired_before, F.col("arrival") * 2 - 1))
    per_cart = gaps.groupBy("cart_id").agg(
        F.max(point).alias("reset_point"), F.min("arrival").alias("first_arrival"), F.min_by("ts", "arrival").alias("first_ts"),
        F.max_by(F.struct("ts", (act == "clear").alias("cleared")), F.col("arrival")).alias("last"))

    # item events after the cart's last reset
    ev = eff.filter(act != "clear").join(per_cart.select("cart_id", "reset_point"), "cart_id")
    ev = ev.filter(F.col("reset_point").isNull() | (F.col("arrival") * 2 > F.col("reset_point")))
    is_set = (act == "remove") | ((act == "update") & ((q <= 0) | s.isNotNull()))
    set_val = F.when((act == "update") & (q > 0), F.least(q, s))  # NULL = entry removed
    bases = ev.filter(is_set).groupBy("cart_id", "item_id").agg(
        F.max("arrival").alias("base_arrival"),
        F.max_by(F.struct(set_val.alias("v")), F.col("arrival")).getField("v").alias("base"))
    adds = (ev.filter(act == "add").join(bases, ["cart_id", "item_id"], "left")
            .filter(F.col("base_arrival").isNull() | (F.col("arrival") > F.col("base_arrival")))
            .groupBy("cart_id", "item_id").agg(F.sum(F.greatest(F.lit(1), q)).alias("added"), F.max("arrival").alias("add_arrival"),
                                               F.first("stock").alias("stock")))
    entries = bases.join(adds, ["cart_id", "item_id"], "full_outer").select(
        "cart_id", "item_id", F.col("base_arrival").isNotNull().alias("is_set"), "base", "added", "stock",
        F.greatest("base_arrival", "add_arrival").alias("written"))
    return per_cart, entries


def quantity_after(base: Column) -> Column:
    """An entry's quantity after a batch's effects on ``base``; NULL: none."""
    return F.when(F.col("added").isNotNull(), F.least(F.coalesce(base, F.lit(0)) + F.col("added"), F.col("stock"))).otherwise(base).cast("bigint")


def cart_state(actions: DataFrame, items: DataFrame, as_of=None, ttl_seconds: int = CART_TTL_SECONDS,
               width: int = sequences.DEFAULT_WIDTH) -> DataFrame:
    """Final (cart_id, item_id, quantity) of every live cart at ``as_of``
    (a timestamp or its text; default: now)."""
    per_cart, entries = batch_effects(actions, items, ttl_seconds, width)
    state = entries.select("cart_id", "item_id", quantity_after(F.col("base")).alias("quantity"))
    live = per_cart.filter(live_cart(F.col("last.ts"), F.col("last.cleared"), as_of, ttl_seconds))
    return state.filter(F.col("quantity").isNotNull()).join(live.select("cart_id"), "cart_id", "left_semi")


def live_cart(last_ts: Column, cleared: Column, as_of=None, ttl_seconds: int = CART_TTL_SECONDS) -> Column:
    """Does the cookie still hold a cart at ``as_of``?"""
    now = F.current_timestamp() if as_of is None else F.lit(str(as_of)).cast("timestamp")
    return ~cleared & (F.unix_seconds(now) - F.unix_seconds(last_ts) <= ttl_seconds)
