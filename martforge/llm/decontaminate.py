"""Benchmark decontamination by winnowing.

Of the hashes of all k-grams in each window of w consecutive ones, the
smallest is a fingerprint. Texts that share a run of t = k + w - 1 words share
the window of that run and so its fingerprint: no shared run of t words is
missed. Fingerprints of documents and benchmark items are joined; only
documents with a common fingerprint are extended: their runs of t words are
compared, as text, with those of the items, and adjoining hits join up.

DataFrame functions only. The fingerprint join shuffles 64-bit hashes (about
2/(w+1) of the words), not texts; a fingerprint that many documents hold is
split by adaptive execution, and each document only once per fingerprint. Whole
texts are not shuffled to be picked out: the list of those concerned, two ids a
row, is broadcast up to BROADCAST_ROWS rows. Else no side is hinted as
broadcast: the planner does so where it measures a small one.

Defined results: a null text has no words and is clean; an item without words
never occurs; an item of fewer than ``t`` words counts as one run; items that
repeat an id are one item with all their runs, a null item_id is written as
the empty string; document rows that repeat doc_id and text give a row each;
other columns are ignored; empty tables give no rows, or clean ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, small
from . import words as W

#: Everything in ASCII but digits and a-z (texts are lower-cased before).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: Words of a shared run, and of a hashed k-gram in it.
RUN = 10
GRAM = 5
#: Rows of two ids up to which a list of texts is broadcast.
BROADCAST_ROWS = 1_000_000


def item_words(text: Column) -> Column:
    return W.split_words(W.lower_ascii(text), SEPARATORS)


def fingerprints(words: DataFrame, t: int, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``fp``: the distinct winnowed hashes of the array
    column ``words`` with guarantee length ``t``; a row each."""
    k = min(GRAM, t)
    out = words.select(*keep, W.hashes(F.col("words")).alias("word_hashes"))
    out = out.select(*keep, W.grams(F.col("word_hashes"), k).alias("gram_hashes"))
    out = W.with_sliding_min(out, "gram_hashes", "minima", t - k + 1)
    return out.select(*keep, F.explode_outer(F.array_distinct("minima")).alias("fp"))


def runs(words: DataFrame, t: int, keep: list[str]) -> DataFrame:
    """``keep`` columns, ``at`` (index of the first word) and ``run``: each
    run of ``t`` consecutive words as text."""
    n = F.size("words")
    starts = F.when(n >= t, F.sequence(F.lit(0), n - t))
    out = words.select(*keep, "words", F.explode_outer(starts).alias("at"))
    return out.select(*keep, "at", F.array_join(F.slice("words", F.col("at") + 1, F.lit(t)), " ").alias("run"))


def find(docs: DataFrame, benchmark: DataFrame, t: int = RUN) -> tuple[DataFrame, DataFrame]:
    """(hits, occurring items): hits has doc_id, h (hash of the text), at, t
    for each run of a document that is one of an item; the second has doc_id,
    h, item_id."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), item_words(F.col("text")).alias("words"))
    items = materialise(items.withColumn("t", F.least(F.size("words"), F.lit(t))), "items")
    lengths = sorted(r.t for r in items.select("t").distinct().collect() if r.t > 0)  # at most t of them
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    found = []
    for length in lengths:
        some = items.where(F.col("t") == length)
        of_items = fingerprints(some, length, ["t"]).select("fp").distinct()
        of_docs = fingerprints(texts.select("doc_id", "h", item_words(F.col("text")).alias("words")), length, ["doc_id", "h"])
        holders = of_docs.join(of_items, "fp", "left_semi").select("doc_id", "h").distinct()
        holders = materialise(holders, "holders")
        held = texts.alias("d").join(small(holders, BROADCAST_ROWS).alias("x"), F.col("d.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("d.h") == F.col("x.h")), "left_semi")
        held = held.select("doc_id", "h", item_words(F.col("text")).alias("words"))
        of_items = runs(some, length, ["item_id"]).select("item_id", "run").distinct()
        matched = runs(held, length, ["doc_id", "h"]).join(of_items.select("run").distinct(), "run")
        matched = materialise(matched.select("doc_id", "h", F.col("at").cast("long").alias("at"), F.lit(length).cast("long").alias("t"), "run"), "hits")
        found.append((matched.select("doc_id", "h", "at", "t").distinct(),
                      matched.select("doc_id", "h", "run").distinct().join(of_items, "run").select("doc_id", "h", "item_id")))
    if not found:
        none = docs.sparkSession.createDataFrame([], "doc_id long, h long, at long, t long, item_id string")
        return none.select("doc_id", "h", "at", "t"), none.select("doc_id", "h", "item_id")
    return (reduce(DataFrame.unionByName, [a for a, _ in found]).distinct(),
            reduce(DataFrame.unionByName, [b for _, b in found]).distinct())


def hit_words(hits: DataFrame) -> DataFrame:
    """doc_id, h, n_hit: words inside any run, by sweeping a document's runs."""
    before = Window.partitionBy("doc_id", "h").orderBy("at", "t").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("at") + F.col("t")
    new = F.greatest(end - F.greatest(F.coalesce(F.max(end).over(before), F.lit(0)), F.col("at")), F.lit(0))
    return hits.select("doc_id", "h", new.alias("new")).groupBy("doc_id", "h").agg(F.sum("new").alias("n_hit"))


def report(docs: DataFrame, benchmark: DataFrame, t: int = RUN) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items,
    items_sha256, contaminated."""
    hits, items = find(docs, benchmark, t)
    per_doc = items.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    found = hit_words(hits).alias("a").join(
        per_doc.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.h") == F.col("b.h"))).select("a.doc_id", "a.h", "n_hit", "ids")
    found = materialise(found, "found")
    every = docs.select("doc_id", F.xxhash64("text").alias("h"),
                        F.size(W.split_words(F.col("text"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")).cast("long").alias("n_words"))
    joined = every.alias("d").join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.h") == F.col("f.h")), "left")
    return joined.select(
        "d.doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.when(F.col("ids").isNull(), 0).otherwise(F.size("ids")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, t: int = RUN) -> DataFrame:
    """The rows of ``docs`` that hold no run of a benchmark item."""
    hits, _ = find(docs, benchmark, t)
    dirty = small(materialise(hits.select("doc_id", "h").distinct(), "dirty"), BROADCAST_ROWS)
    return docs.alias("d").join(dirty.alias("x"), F.col("d.doc_id").eqNullSafe(F.col("x.doc_id"))
                                & (F.xxhash64("d.text") == F.col("x.h")), "left_anti")
