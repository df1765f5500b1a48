"""Connected components of a link table, by contraction to smaller neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, release


def components(links: DataFrame) -> DataFrame:
    """A written table (node, comp) for every node of ``links`` (a, b); comp is one node of
    the component. Each round every node moves to its smallest neighbour (or
    stays), which at least halves the nodes of a component; rounds end when no
    link between different nodes is left. Tables between rounds are written,
    so a hot node's rows are split by adaptive execution."""
    edges = links.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = materialise(edges, "edges")
    where = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to")), "moves")
        before = where
        if where is None:
            where = move.select("node", F.col("to").alias("comp"))
        else:
            where = (where.join(move.select(F.col("node").alias("comp"), "to"), "comp", "left")
                     .select("node", F.coalesce("to", "comp").alias("comp")))
        where = materialise(where, "labels")
        if before is not None:
            release(before)
        a = move.select(F.col("node").alias("a"), F.col("to").alias("x"))
        b = move.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = edges.join(a, "a").join(b, "b").where(F.col("x") != F.col("y"))
        done, edges = edges, materialise(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        release(done, move)
    release(edges)
    return materialise(links.select(F.col("a").alias("node"), F.col("a").alias("comp")).limit(0), "labels") if where is None else where
