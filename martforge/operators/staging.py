"""Staging layer: keyed latest-state upsert with soft deletes and schema evolution.

``latest_per_key`` is one aggregate (``max_by`` over the ordering struct), so
Spark combines map-side: a key holding a third of all changes is reduced in
every map task before the shuffle, never gathered into one group.

``merge_latest`` folds a batch of changes into the current table with a
full outer join on the key instead of a union + regroup: when the current
table is bucketed by the key, only the (small) batch side is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_ORDER = ("__source_ts_ms", "offset")
# Numeric types, each holding the ones before it.
WIDTHS = ("tinyint", "smallint", "int", "bigint")


def wider(x: str, y: str, column: str) -> str:
    """The type that holds every value of both; whole numbers wider than 32
    bits don't fit a double, so with one they are an error, as are other
    types that differ."""
    if x == y:
        return x
    if "double" in (x, y) and (y if x == "double" else x) in WIDTHS[:3]:
        return "double"
    if x in WIDTHS and y in WIDTHS:
        return max(x, y, key=WIDTHS.index)
    raise TypeError(f"column {column} is {x} in the table and {y} in the batch")


def latest_per_key(changes: DataFrame, key: str = "id", order=DEFAULT_ORDER) -> DataFrame:
    """One row per key: the change with the greatest (order...) wins.

    A NULL in an ordering column sorts oldest. Deletes are kept as rows with
    ``__deleted='true'`` (soft delete); a later re-insert of the key wins over
    the delete like any later change.
    """
    rest = [c for c in changes.columns if c != key]
    best = F.max_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order]))
    return (changes.filter(F.col(key).isNotNull()).groupBy(key).agg(best.alias("__latest"))
            .select(key, *[F.col("__latest").getField(c).alias(c) for c in rest]))


def _lex_ge(a: list[Column], b: list[Column]) -> Column:
    """(a...) >= (b...) lexicographically, NULL smallest."""
    if not a:
        return F.lit(True)
    x, y = a[0], b[0]
    gt = (x.isNotNull() & y.isNull()) | (x > y)
    eq = (x.isNull() & y.isNull()) | (x == y)
    return F.coalesce(gt, F.lit(False)) | (F.coalesce(eq, F.lit(False)) & _lex_ge(a[1:], b[1:]))


def align(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Schema evolution: give both sides the union of columns (missing ->
    NULL). Numbers of different width take the wider type (``wider``); other
    types that differ are an error."""
    a_types = {f.name: f.dataType for f in a.schema}
    b_types = {f.name: f.dataType for f in b.schema}
    for name in a_types.keys() & b_types.keys():
        x, y = a_types[name].simpleString(), b_types[name].simpleString()
        if x == y:
            continue
        wide = wider(x, y, name)
        a, b = a.withColumn(name, F.col(name).cast(wide)), b.withColumn(name, F.col(name).cast(wide))
    cols = list(a.columns) + [c for c in b.columns if c not in a_types]

    def fill(df, own):
        return df.select(*[F.col(c) if c in own else F.lit(None).cast(a_types.get(c) or b_types[c]).alias(c)
                           for c in cols])
    return fill(a, a_types), fill(b, b_types)


def evolve(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Append a batch to a table whose schema may lack some of its columns."""
    return target.unionByName(batch, allowMissingColumns=True)


def merge_latest(current: DataFrame, changes: DataFrame, key: str = "id", order=DEFAULT_ORDER) -> DataFrame:
    """Upsert ``changes`` into ``current`` (one row per key each side after
    reduction). The newer row by ``order`` wins; on equal order the incoming
    row wins (a replayed batch rewrites the same values)."""
    incoming = latest_per_key(changes, key, order)
    cur, new = align(current, incoming)
    rest = [c for c in cur.columns if c != key]
    j = (cur.select(key, F.struct(*rest).alias("__c"))
         .join(new.select(key, F.struct(*rest).alias("__n")), key, "full_outer"))
    n_wins = F.col("__n").isNotNull() & (
        F.col("__c").isNull()
        | _lex_ge([F.col("__n").getField(o) for o in order], [F.col("__c").getField(o) for o in order]))
    return j.select(key, *[F.when(n_wins, F.col("__n").getField(c)).otherwise(F.col("__c").getField(c)).alias(c)
                           for c in rest])


def bootstrap(snapshot: DataFrame, changes: DataFrame, offset_col: str = "offset") -> DataFrame:
    """Initial copy first, then increments: snapshot rows become op ``r``
    changes ordered before every streamed change of the same source time."""
    snap = (snapshot.withColumn("__op", F.lit("r")).withColumn("__deleted", F.lit("false"))
            .withColumn(offset_col, F.lit(-1).cast("long")))
    return evolve(snap, changes)
