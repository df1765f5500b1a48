"""Skew-safe running values per key (prefix sums, previous value).

A plain ``Window.partitionBy(key).orderBy(t)`` puts every row of a key in one
task; with a key holding a third of the data that task is the job. Here each
key's rows are cut into chunks of consecutive ordering values
(``floor(t / width)``): the window runs per (key, chunk), which bounds a task
by ``width`` ordering values, and only one row per chunk -- its total or its
last value -- goes through a per-key window to carry across chunks.

The first ordering column must be a numeric arrival sequence (offset,
event id); ``width`` is in its units.

Cost: the input is read twice -- once shuffled by (key, chunk) for the
windows, once reduced map-side to one partial total (or last value) per
(key, chunk) before a small shuffle. Reading the per-chunk values off the
windowed rows instead would shuffle every row twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_WIDTH = 1 << 20


def _chunk(df: DataFrame, by: list[str], first_order: str, width: int) -> DataFrame:
    """Adds ``__chunk`` and hash-partitions by (key, chunk) explicitly: if the
    input already happens to be partitioned by the key alone (after a join
    on it), Spark would otherwise accept that layout for the window and keep
    a hot key in one task."""
    return _with_chunk(df, first_order, width).repartition(*by, "__chunk")


def _with_chunk(df: DataFrame, first_order: str, width: int) -> DataFrame:
    """Rows whose first ordering column is NULL come first: their own chunk
    before all others."""
    chunk = F.floor(F.col(first_order) / F.lit(width)).cast("bigint")
    return df.withColumn("__chunk", F.coalesce(chunk, F.lit(-(1 << 63)).cast("bigint")))


def prior_sum(df: DataFrame, by: list[str], order: list[str], value: str | Column, out: str = "prior",
              width: int = DEFAULT_WIDTH) -> DataFrame:
    """Adds ``out`` = sum of ``value`` over earlier rows of the same key
    (rows unbounded preceding .. 1 preceding, by ``order``); 0 for the first."""
    val = F.col(value) if isinstance(value, str) else value
    rows = df.withColumn("__v", val)
    d = _chunk(rows, by, order[0], width)
    local = Window.partitionBy(*by, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("__local", F.coalesce(F.sum("__v").over(local), F.lit(0)))
    # from the rows as they come, not as dealt out above: totals are combined
    # map-side and only they are shuffled
    totals = _with_chunk(rows, order[0], width).groupBy(*by, "__chunk").agg(F.sum("__v").alias("__t"))
    carry = Window.partitionBy(*by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "__chunk", F.coalesce(F.sum("__t").over(carry), F.lit(0)).alias("__off"))
    return (d.join(offsets, [*by, "__chunk"])
            .withColumn(out, F.col("__off") + F.col("__local"))
            .drop("__chunk", "__local", "__off", "__v"))


def previous_value(df: DataFrame, by: list[str], order: list[str], value: str, out: str = "prev",
                   width: int = DEFAULT_WIDTH) -> DataFrame:
    """Adds ``out`` = ``value`` of the previous row of the same key (NULL for the first)."""
    d = _chunk(df, by, order[0], width)
    local = Window.partitionBy(*by, "__chunk").orderBy(*order)
    d = d.withColumn("__lag", F.lag(value).over(local)).withColumn("__first", F.row_number().over(local) == 1)
    last = _with_chunk(df, order[0], width).groupBy(*by, "__chunk").agg(
        F.max_by(F.col(value), F.struct(*[F.col(o) for o in order])).alias("__last"))
    carry = Window.partitionBy(*by).orderBy("__chunk")
    before = last.select(*by, "__chunk", F.lag("__last").over(carry).alias("__carry"))
    return (d.join(before, [*by, "__chunk"])
            .withColumn(out, F.when(F.col("__first"), F.col("__carry")).otherwise(F.col("__lag")))
            .drop("__chunk", "__lag", "__first", "__carry"))
