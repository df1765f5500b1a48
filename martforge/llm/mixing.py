"""Mixing sources to target weights by iterative proportional fitting.

Token counts of the (source, lang, topic) cells are raked: sweep after sweep,
each margin's cells are scaled to its target. A cell's factor (raked over
counted tokens) then gives the probability with which its documents stay;
whether one does depends on a hash of its doc_id, so a second run chooses the
same.

DataFrame functions only. Documents are aggregated once, map side first, so a
hot source is a few partial rows; sweeps work on the table of cells with
grouped sums (no task holds a margin's cells) and their tables are written in
between. Cells are joined back as the planner sees fit: broadcast while they
are measured to be small, else a join that adaptive execution can split.

Defined results: null source or lang is a value of its own (the empty
string); a null text has no tokens; documents of cells without any token stay
(probability 1); rows that repeat a doc_id are drawn alike, null ones as the
empty string; an empty table gives no rows; other columns are ignored by
``sample`` and kept by ``mixed``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise, release
from . import words as W

MARGINS = ("source", "lang", "topic")


@dataclass(frozen=True)
class Mix:
    """``power``: a margin's target shares are its counted shares to this
    power, normalised (1 leaves it, 0 makes it even); ``shares`` names targets
    of values instead (values it doesn't name keep their tempered share)."""

    power: dict[str, float] = field(default_factory=lambda: {"source": 0.7, "lang": 0.8, "topic": 1.0})
    shares: dict[str, dict[str, float]] = field(default_factory=dict)
    #: Share of all tokens to keep, and the sweeps and steps of calibration.
    keep: float = 0.8
    sweeps: int = 8
    steps: int = 8
    seed: str = "mix"


#: What makes a document's topic, first match wins; the rest is prose.
TOPICS = (("legal", r"(?i)licen[cs]e|copyright"), ("contact", r"[\w.+-]+@[\w-]+\.\w"), ("table", r" \| "))


def topic(text: Column) -> Column:
    out = F.lit("prose")
    for name, pattern in reversed(TOPICS):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic and n_tokens (words) of each row."""
    return docs.select(
        "doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), topic(F.col("text")).alias("topic"),
        F.size(W.split_words(F.col("text"), r"[\x20\x09-\x0D]")).cast("long").alias("n_tokens"))


def draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on ``key`` and ``seed`` alone."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(":" + seed))), 1, 12), 16, 10).cast("double") / F.lit(float(16 ** 12))


def targets(cells: DataFrame, margin: str, mix: Mix) -> DataFrame:
    """(margin, target): tokens that each value of ``margin`` should have."""
    counted = cells.groupBy(margin).agg(F.sum("tokens").alias("n"))
    want = F.pow(F.col("n").cast("double"), F.lit(mix.power.get(margin, 1.0)))
    sums = counted.agg(F.sum("n").alias("all"), F.sum(want).alias("tempered")).first()
    share = want / F.lit(sums.tempered or 1.0)
    for value, given in mix.shares.get(margin, {}).items():
        share = F.when(F.col(margin) == value, F.lit(float(given))).otherwise(share)
    shares = counted.select(margin, share.alias("share"))
    whole = shares.agg(F.sum("share")).first()[0] or 1.0
    return shares.select(margin, (F.lit(float(sums["all"] or 0)) * F.col("share") / F.lit(whole)).alias("target"))


def rake(described: DataFrame, mix: Mix) -> DataFrame:
    """source, lang, topic, tokens, raked, p of each cell."""
    cells = described.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")).where(F.col("tokens") > 0)
    cells = materialise(cells.withColumn("raked", F.col("tokens").cast("double")), "cells")
    wanted = {m: materialise(targets(cells, m, mix), f"target-{m}") for m in MARGINS}
    for _ in range(mix.sweeps):
        for m in MARGINS:
            has = cells.groupBy(m).agg(F.sum("raked").alias("has")).join(wanted[m], m)
            factor = has.select(m, (F.col("target") / F.col("has")).alias("factor"))
            before = cells  # written anew each time: a plan over several margins reads it twice for each
            cells = materialise(cells.join(factor, m).select(*MARGINS, "tokens", (F.col("raked") * F.col("factor")).alias("raked")), "raked")
            release(before)
    # scale the factors until the probabilities keep the wanted share
    ratio = F.col("raked") / F.col("tokens")
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    rate = mix.keep
    for _ in range(mix.steps):
        kept = cells.agg(F.sum(F.least(F.lit(1.0), ratio * rate) * F.col("tokens"))).first()[0]
        if kept:
            rate *= mix.keep * total / kept
    return cells.withColumn("p", F.round(F.least(F.lit(1.0), ratio * rate), 6))


def sample(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, lang, topic, n_tokens, p,
    kept."""
    described = describe(docs)
    cells = materialise(rake(described, mix).select(*MARGINS, "p"), "probabilities")
    p = F.coalesce("p", F.lit(1.0))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return described.join(cells, list(MARGINS), "left").select(
        "doc_id", *MARGINS, "n_tokens", p.alias("p"), (draw(key, mix.seed) < p).alias("kept"))


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The rows of ``docs`` that the sample keeps."""
    cells = materialise(rake(describe(docs), mix).select(*[F.col(m).alias(f"__{m}") for m in MARGINS], F.col("p").alias("__p")), "probabilities")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    same = ((F.coalesce(F.col("source").cast("string"), F.lit("")) == F.col("__source"))
            & (F.coalesce(F.col("lang").cast("string"), F.lit("")) == F.col("__lang")) & (topic(F.col("text")) == F.col("__topic")))
    return docs.join(cells, same, "left").where(draw(key, mix.seed) < F.coalesce("__p", F.lit(1.0))).select(*docs.columns)
