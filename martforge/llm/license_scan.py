"""License scans: MinHash bands over overlapping windows, then containment.

A window is two consecutive five-word shingles; one starts at each shingle.
Each of ``BANDS`` hash functions gives a window's minimum; a band is one
minimum. A template (a license line or text) is cut the same way, and a
document window that shares a band with a template window is a candidate. A
text that holds two consecutive shingles of a template has its window, and so
all its bands. A template of one shingle has no window of its own: its
shingle's hash is looked up besides, as one band more. So none is missed. Candidates
are settled exactly: the share of the template's shingles that the document
holds around the window must reach ``CONTAINED``.

DataFrame functions only; one narrow pass over the texts. The templates are a
parameter (some hundred lines; their band values are literals of the plan),
so nothing is shuffled but the few windows found.

Defined results: a null text, or one of fewer than five words, has no
license; templates of fewer than five words are refused; rows that repeat
doc_id and text are reported once, rows of one doc_id (or none) and several
texts once for each text; a null doc_id stays null; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
SHINGLE = 5
WINDOW = 2
BANDS = 7
CONTAINED = 0.8
MAX_TEMPLATES = 1000

#: Lines by which public licenses are declared.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0",
    "GPL-3.0": "Licensed under the GNU General Public License, Version 3",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, Version 3",
    "AGPL-3.0": "Licensed under the GNU Affero General Public License, Version 3",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "All-rights-reserved": "Copyright by the authors. All rights reserved",
}


def words(text: Column) -> Column:
    return W.split_words(F.lower(text), SEPARATORS)


def miss_bound(n_shingles: int, bands: int = BANDS) -> float:
    """Probability that a template is not retrieved though CONTAINED of its
    shingles are there. Of two or more, two consecutive ones are: their window
    is the template's, in every band. A single one is looked up itself."""
    return 0.0 if n_shingles > 1 else float(n_shingles < 1)


def _nth_hash(b: int):
    return lambda x: F.xxhash64(x, F.lit(b))


def _minima(df: DataFrame, bands: int, keep: list[str]) -> DataFrame:
    """Adds ``m0``, ``m1``, ...: the window minima of each hash function; keeps the shingles' hashes."""
    df = df.select(*keep, "gram_hashes", *[F.transform("gram_hashes", _nth_hash(b)).alias(f"h{b}") for b in range(bands)])
    return df.select(*keep, "gram_hashes", *[F.zip_with(f"h{b}", F.slice(f"h{b}", F.lit(2), F.size(f"h{b}")), lambda x, y: F.least(x, y)).alias(f"m{b}")
                              for b in range(bands)])


def _shingled(df: DataFrame, keep: list[str]) -> DataFrame:
    df = df.select(*keep, "words", W.hashes(F.col("words")).alias("word_hashes"))
    return df.select(*keep, "words", W.grams(F.col("word_hashes"), SHINGLE).alias("gram_hashes"))


def _shingle_texts(w: Column) -> Column:
    """The distinct five-word shingles of an array of words, as text."""
    return F.when(F.size(w) >= SHINGLE, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - SHINGLE + 1),
                                                                     lambda i: F.array_join(F.slice(w, i, SHINGLE), " ")))).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, bands: int = BANDS) -> DataFrame:
    """doc_id, license, containment, at (first word of the first window that
    shows it): a row per document and template found in it."""
    templates = TEMPLATES if templates is None else templates
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates")
    spark = docs.sparkSession
    known = spark.createDataFrame(list(templates.items()), "license string, text string").select("license", words(F.col("text")).alias("words"))
    known = known.select("license", "words", _shingle_texts(F.col("words")).alias("shingles"))
    rows = _minima(_shingled(known, ["license"]), bands, ["license", "words"]).collect()
    if any(len(r.words) < SHINGLE for r in rows):
        raise ValueError(f"a template needs {SHINGLE} words")
    # beside the bands, as the last: the shingle itself of templates of one
    marks = [{r.license: set(r[f"m{b}"]) for r in rows} for b in range(bands)] + [{r.license: set(r.gram_hashes) for r in rows if len(r.gram_hashes) == 1}]
    values = [sorted(set().union(*m.values())) for m in marks]
    reach = max((len(r.words) for r in rows), default=0)
    if not rows:
        return spark.createDataFrame([], "doc_id long, license string, containment double, at long")
    bandings = spark.createDataFrame([(b, m, name) for b, mark in enumerate(marks) for name, found in mark.items() for m in found],
                                     "band int, minimum long, license string")

    def found(b: int) -> Column:
        marked = F.transform(f"m{b}" if b < bands else "gram_hashes", lambda x, j: F.when(x.isin(values[b]), F.struct(F.lit(b).alias("band"), x.alias("minimum"), j.alias("at"))))
        return F.filter(marked, lambda x: x.isNotNull())

    own = ["doc_id", "text_hash"]
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("words"))
    minima = _minima(_shingled(texts, own), bands, [*own, "words"])
    hits = minima.select(*own, "words", F.explode_outer(F.flatten(F.array(*[found(b) for b in range(len(marks)) if values[b]]))).alias("hit"))
    # what of the text a template that shows in this window can cover
    low = F.greatest(F.col("hit.at") - reach, F.lit(0))
    around = F.slice("words", low + 1, F.lit(2 * reach + WINDOW + SHINGLE))
    hits = hits.select(*own, F.col("hit.band").alias("band"), F.col("hit.minimum").alias("minimum"), F.col("hit.at").alias("at"), around.alias("around"))
    pairs = hits.join(bandings, ["band", "minimum"]).groupBy(*own, "license", "at").agg(F.first("around").alias("around"))
    pairs = pairs.join(known.select("license", "shingles"), "license")
    share = F.size(F.array_intersect("shingles", _shingle_texts(F.col("around")))) / F.size("shingles")
    exact = pairs.select(*own, "license", share.alias("containment"), F.col("at").cast("long").alias("at")).where(F.col("containment") >= CONTAINED)
    return exact.groupBy(*own, "license").agg(F.max("containment").alias("containment"), F.min("at").alias("at")).drop("text_hash")
