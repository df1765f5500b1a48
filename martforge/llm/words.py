"""Words and k-gram hashes of whole texts as array columns (JVM only).

Columns derived here are arrays of a whole text: explode them with the
``_outer`` generators only. A plain ``explode`` makes the optimiser add a
filter on the array, push it through the projections below and so evaluate
the word split again for each element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def split_words(text: Column, separators: str) -> Column:
    """The non-empty pieces between runs of ``separators`` (a regular
    expression class); a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{separators}+"), "")


def hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def grams(hashed: Column, k: int) -> Column:
    """64-bit hash of every run of ``k`` entries; empty if there are fewer."""
    empty = F.array().cast("array<bigint>")
    return F.when(F.size(hashed) >= k, F.transform(
        F.sequence(F.lit(0), F.size(hashed) - k),
        lambda i: F.xxhash64(*[F.get(hashed, i + j) for j in range(k)]))).otherwise(empty)


def with_sliding_min(df: DataFrame, values: str, out: str, width: int) -> DataFrame:
    """Adds ``out``: the minimum of each ``width`` consecutive entries of the
    array ``values``, by doubling (a projection per step, so that no step is
    evaluated twice); the last ``width - 1`` entries cover what is left."""
    def shifted_min(a: str, b: str, by: int) -> Column:
        return F.zip_with(F.col(a), F.slice(b, F.lit(by + 1), F.size(b)), lambda x, y: F.least(x, y))

    spans, keep = {1: values}, df.columns
    while max(spans) * 2 <= width:
        n = max(spans)
        df = df.withColumn(f"__span{2 * n}", shifted_min(spans[n], spans[n], n))
        spans[2 * n] = f"__span{2 * n}"
    name, done = spans[max(spans)], max(spans)
    while done < width:
        n = max(s for s in spans if s <= width - done)
        df = df.withColumn(f"__upto{done + n}", shifted_min(name, spans[n], done))
        name, done = f"__upto{done + n}", done + n
    return df.select(*keep, F.col(name).alias(out))
