"""Customer and catalogue writes, re-aimed as set-based jobs producing rows
(or change rows for the staging upsert) instead of per-request updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import blank_to_null, live_row, strip, ttc_from_ht_exact


def profile_normalise(profiles: DataFrame) -> DataFrame:
    """Profile edit: names stripped of white space; phone and address too,
    empty -> NULL."""
    out = profiles
    for c in ("first_name", "last_name"):
        out = out.withColumn(c, strip(c))
    for c in ("phone", "address"):
        out = out.withColumn(c, blank_to_null(c))
    return out


def register_new_customers(customers: DataFrame, candidates: DataFrame) -> DataFrame:
    """Accept sign-ups whose e-mail is not taken yet (anti join on e-mail);
    within the batch the first arrival per e-mail wins (a min_by aggregate,
    combined map-side, so a flood of sign-ups with one e-mail stays cheap).
    Registration does not trim: only an empty phone/address becomes NULL."""
    fresh = candidates.join(customers.select("email"), "email", "left_anti")
    rest = [c for c in fresh.columns if c not in ("email", "arrival")]
    first = fresh.groupBy("email").agg(
        F.min_by(F.struct(*rest, "arrival"), F.col("arrival")).alias("r"))
    out = first.select("email", *[F.col("r").getField(c).alias(c) for c in rest + ["arrival"]])
    for c in ("phone", "address"):
        if c in out.columns:
            out = out.withColumn(c, F.nullif(F.col(c), F.lit("")))
    return out


def item_changes(actions: DataFrame, current: DataFrame) -> DataFrame:
    """Admin create / edit / delete actions -> staging change rows for items.

    ``actions``: (action c|u|d, id, title, description, price_ht, tva_rate,
    quantity, ts_ms, offset). TTC is recomputed from HT and VAT, an empty
    description becomes NULL; a delete carries the current row image with
    ``__deleted='true'``. Edits and deletes of items that are not live in
    ``current`` are dropped (the admin page redirects). Actions of one batch
    are not chained: each is checked against ``current`` and the upsert keeps
    the latest. TTC uses exact decimals (half-up; Python's binary rounding
    can differ by a cent on ties).
    """
    cur = current.filter(live_row()).select(
        "id", F.lit(True).alias("cur_known"),
        *[F.col(c).alias(f"cur_{c}") for c in ("title", "description", "image_url", "price_ht", "tva_rate",
                                               "price_ttc", "quantity", "created_at")])
    a = actions.join(cur, "id", "left")
    known = F.col("cur_known").isNotNull()
    keep = (F.col("action") == "c") | known
    is_del = F.col("action") == "d"

    def pick(c, new):
        return F.when(is_del, F.col(f"cur_{c}")).otherwise(new).alias(c)

    return a.filter(keep).select(
        "id", pick("title", F.col("title")), pick("description", F.nullif(F.col("description"), F.lit(""))),
        pick("image_url", F.col("cur_image_url")),
        pick("price_ht", F.col("price_ht")), pick("tva_rate", F.col("tva_rate")),
        pick("price_ttc", ttc_from_ht_exact("price_ht", "tva_rate").cast("double")),
        pick("quantity", F.col("quantity").cast("int")),
        F.when(F.col("action") == "c", F.col("ts_ms")).otherwise(F.col("cur_created_at")).alias("created_at"),
        F.col("ts_ms").alias("updated_at"),
        F.col("action").alias("__op"), F.col("ts_ms").alias("__ts_ms"), F.col("ts_ms").alias("__source_ts_ms"),
        F.when(is_del, "true").otherwise("false").alias("__deleted"), "offset")
