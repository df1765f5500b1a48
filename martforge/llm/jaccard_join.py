"""Exact Jaccard join of word-n-gram sets with set-relation skipping.

Sets with at least ``share`` per cent of their union in common share one of
their first few elements in any common order (prefix filter). The order used:
elements whose hash falls in a fixed zone, rarest first, then the rest by
hash. Only the zone is counted, so the shuffle is a fifth of the elements.
Elements that no other set holds can't match; a set whose prefix has nothing
else is done.

Index lists are skipped by position: a pair counts only where the smaller set
has the element within its index prefix, sizes fit, and what both still have
after it can reach the overlap. Answers are derived by set relation: equal
sets are one set. Each other set is compared once, in full, with an anchor:
the leader of most of its lists. From then on it is known as what it lacks of
the anchor and what it has beside it, two short lists, and the overlap of any
two sets of one anchor follows exactly from their lists' overlaps. So a family
of near copies is settled in blocks of FAMILY sets, without a row per pair: the
sets that aren't linked to the anchor with each other and with the rest. Only pairs of lists
that cross anchors and components are left to compare in full.

Defined results: a null text, or one without words, is an empty set linked
with nothing; fewer words than ``n`` make one element; a null doc_id takes no
part in links and gets a null component; rows that repeat a doc_id with
different texts are separate sets, and both rows' components count; other
columns are ignored. Elements and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, release, small
from . import words as W
from .components import components

SEPARATORS = r"[\x20\x09-\x0D]"
#: Share of the hash space whose elements are counted and come first.
ZONE = 0.2
#: Sets of an anchor that one task settles among themselves (two such blocks).
FAMILY = 512
#: Entries of an element's list in a block; each two blocks of a longer list meet.
LIST = 1024
#: Rows of 16 bytes up to which a list of ids is broadcast.
BROADCAST_ROWS = 1_000_000
#: Rows of an Arrow batch of whole sets.
BATCH_ROWS = 1000
_ZONE_END = np.int64(-2 ** 63 + int(ZONE * 2 ** 64))


def prefix_length(n, share: int):
    """Elements of a set of size ``n`` that every larger partner meets."""
    return n - -(-share * n // 100) + 1


def index_length(n, share: int):
    """... that every partner of at least its own size meets."""
    return n - -(-2 * share * n // (100 + share)) + 1


def enough(common, size_a, size_b, share: int):
    """100 * intersection >= share * union."""
    return 100 * common >= share * (size_a + size_b - common)


def shingle_rows(docs: DataFrame, n: int, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``elements``: the n-gram hashes of ``text``."""
    rows = docs.select(*keep, W.split_words(W.lower_ascii(F.col("text")), SEPARATORS).alias("words"))
    rows = rows.select(*keep, F.size("words").alias("n_words"), W.hashes(F.col("words")).alias("word_hashes"))
    short = F.array(F.xxhash64("word_hashes", "n_words"))
    return rows.select(*keep, F.when(F.col("n_words").between(1, n - 1), short)
                       .otherwise(W.grams(F.col("word_hashes"), n)).alias("elements"))


def _lists(column: pa.Array):
    """The entries of an Arrow list column as numpy arrays."""
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _describe(share: int):
    """doc_id, size, node (hash of the set), the set's zone elements and, if
    they don't fill the prefix, the first others."""
    def describe(batches):
        for batch in batches:
            sets = [np.unique(x) for x in _lists(batch.column("elements"))]
            zone = [s[:np.searchsorted(s, _ZONE_END)] for s in sets]
            more = [s[len(z):max(len(z), int(prefix_length(len(s), share)))] if len(s) else s for s, z in zip(sets, zone)]
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "size": pa.array([len(s) for s in sets], pa.int64()),
                "node": pa.array([_node(s) for s in sets], pa.int64()),
                "zone": pa.array(zone, pa.list_(pa.int64())), "more": pa.array(more, pa.list_(pa.int64()))})
    return describe


def _node(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _set_rows(batches):
    for batch in batches:
        sets = [np.unique(x) for x in _lists(batch.column("elements"))]
        yield pa.record_batch({"node": batch.column("node"), "elements": pa.array([s.tobytes() for s in sets], pa.binary()),
                               "right": pa.array([_node(s) == node for s, node in zip(sets, batch.column("node").to_pylist())], pa.bool_())})


def _verify(share: int):
    """Which pairs of sets really reach the share."""
    def verify(batches):
        for batch in batches:
            a, b = ([np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(c)] for c in ("set_a", "set_b"))
            ok = [bool(enough(len(x) + len(y) - len(np.union1d(x, y)), len(x), len(y), share)) for x, y in zip(a, b)]
            yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b"), "linked": pa.array(ok, pa.bool_())})
    return verify


def _differences(share: int):
    """Each set (b) by its anchor (a): linked or not, and the elements it
    lacks and has beside the anchor's."""
    def compare(batches):
        for batch in batches:
            a, b = ([np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(c)] for c in ("set_a", "set_b"))
            lacks = [np.setdiff1d(x, y, assume_unique=True) for x, y in zip(a, b)]
            beside = [np.setdiff1d(y, x, assume_unique=True) for x, y in zip(a, b)]
            ok = [bool(enough(len(x) - len(d), len(x), len(y), share)) for x, y, d in zip(a, b, lacks)]
            yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b"), "linked": pa.array(ok, pa.bool_()),
                                   "size_a": pa.array([len(x) for x in a], pa.int64()), "size_b": pa.array([len(x) for x in b], pa.int64()),
                                   "lacks": pa.array([d.tobytes() for d in lacks], pa.binary()), "beside": pa.array([d.tobytes() for d in beside], pa.binary())})
    return compare


def _overlaps(lists: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the lists have in common."""
    out = np.zeros((len(lists), len(lists)), np.int32)
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    element = np.concatenate(lists) if lists else np.empty(0, np.int64)
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    starts = np.flatnonzero(np.r_[True, element[1:] != element[:-1]]) if len(element) else np.empty(0, np.int64)
    ends = np.r_[starts[1:], len(element)]
    for lo, hi in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
        out[np.ix_(owner[lo:hi], owner[lo:hi])] += 1
    return out


def _family(share: int):
    """Links among the sets of one anchor (two blocks of them): a star for each
    of their components."""
    def settle(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("node")
        lacks, beside = ([np.frombuffer(x, np.int64) for x in rows[c]] for c in ("lacks", "beside"))
        node, size = rows["node"].to_numpy(), rows["size"].to_numpy()
        d = np.array([len(x) for x in lacks])
        common = rows["anchor_size"].to_numpy()[:, None] - d[:, None] - d[None] + _overlaps(lacks) + _overlaps(beside)
        linked = enough(common, size[:, None], size[None], share)
        left, out = np.ones(len(node), bool), []
        while left.any():
            first = int(left.argmax())
            reached, edge = np.zeros(len(node), bool), [first]
            reached[first] = True
            while edge:
                new = linked[edge].any(axis=0) & ~reached
                reached |= new
                edge = np.flatnonzero(new).tolist()
            left &= ~reached
            out += [(node[first], node[i]) for i in np.flatnonzero(reached) if i != first]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")
    return settle


def _across(share: int):
    """Pairs of a part of a list that cross components and anchors, with what
    position and size rule out skipped. Rows come sorted by part; a part may span
    batches. In a part of two blocks only pairs across them count."""
    def pairs_of(node, comp, anchor, size, at, own):
        order = np.argsort(size, kind="stable")
        node, comp, anchor, size, at, own = node[order], comp[order], anchor[order], size[order], at[order], own[order]
        two = own.min() != own.max()
        left = size - at  # elements from this one on
        for lo in range(len(node)):
            if at[lo] >= index_length(size[lo], share):
                continue  # not in the smaller set's index prefix
            hi = np.searchsorted(size, 100 * size[lo] // share, side="right")
            x = np.arange(lo + 1, hi)
            # the same component, or settled by the anchor
            x = x[(comp[x] != comp[lo]) & (anchor[x] != anchor[lo]) & (anchor[x] != node[lo]) & (node[x] != anchor[lo])]
            x = x[enough(np.minimum(left[x], left[lo]), size[x], size[lo], share)]
            x = x[own[x] != own[lo]] if two else x
            if len(x):
                yield np.minimum(node[x], node[lo]), np.maximum(node[x], node[lo])

    def across(batches):
        held = None
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "node", "comp", "anchor", "size", "at", "own")]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            if not len(cols[0]):
                continue
            last = np.searchsorted(cols[0], cols[0][-1])
            held = [c[last:] for c in cols]
            yield from emit([c[:last] for c in cols])
        if held is not None:
            yield from emit(held)

    def emit(cols):
        starts = np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]]) if len(cols[0]) else []
        for lo, hi in zip(starts, [*starts[1:], len(cols[0])]):
            if hi - lo > 1:
                for a, b in pairs_of(*[c[lo:hi] for c in cols[1:]]):
                    yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return across


def links(docs: DataFrame, share: int = 90, n: int = 3) -> tuple[DataFrame, DataFrame]:
    """(described, where): doc_id, size and node of each row of ``docs``, and
    (node, comp) of each node that is linked with another."""
    described = shingle_rows(docs, n, ["doc_id"]).mapInArrow(_describe(share), "doc_id long, size long, node long, zone array<long>, more array<long>")
    described = materialise(described, "sets", BATCH_ROWS)
    rows = described.where((F.col("size") > 0) & F.col("doc_id").isNotNull())
    # equal sets are one
    one = rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first(F.size("zone")).alias("zoned"))
    one = materialise(one, "distinct-sets")
    # elements that different sets hold, in the zone and (after all of those) in the rest
    held = rows.select("node", F.explode_outer("zone").alias("element")).unionByName(rows.select("node", F.explode_outer("more").alias("element")))
    held = held.where(F.col("element").isNotNull())
    shared = held.groupBy("element").agg(F.count("*").alias("held"), F.min("node").alias("lo"), F.max("node").alias("hi"))
    shared = materialise(shared.where(F.col("lo") != F.col("hi")).select("element", "held"), "shared")
    held = materialise(held.join(shared, "element").distinct(), "held")
    release(shared)
    described, sets_written = materialise(described.select("doc_id", "size", "node"), "sizes"), described
    release(sets_written)
    # the late ones by hash alone, the order that cut them to the prefix
    late = F.col("element") >= int(_ZONE_END)
    mine = held.groupBy("node").agg(F.array_sort(F.collect_list(F.struct(late.alias("late"), F.when(late, 0).otherwise(F.col("held")).alias("held"), "element"))).alias("e"))
    sized = mine.join(one.select("node", "size", "zoned"), "node")
    # elements that only this set holds come first: they shorten what is left of the prefix
    alone = F.col("zoned") - F.size(F.filter("e", lambda x: ~x["late"]))
    sized = sized.select("node", "size", alone.alias("alone"), "e")
    p = F.expr(f"size - ((size * {share} + 99) div 100) + 1")
    listed = sized.select("node", "size", "alone", p.alias("p"), F.posexplode_outer("e").alias("pos", "x"))
    listed = listed.select(F.col("x.element").alias("element"), "node", "size", (F.col("alone") + F.col("pos")).alias("at"), "p").where(F.col("at") < F.col("p")).drop("p")
    listed = materialise(listed, "lists")
    release(held)

    # the anchor: leader of most of a set's lists
    fits = 100 * F.least("size", "leader_size") >= share * F.greatest("size", "leader_size")
    lead = listed.groupBy("element").agg(F.min(F.struct("node", "size")).alias("leader"), F.count("*").alias("members")).where(F.col("members") > 1)
    lead = materialise(lead.select("element", F.col("leader.node").alias("leader"), F.col("leader.size").alias("leader_size")), "leaders")
    near = listed.join(lead, "element").where(F.col("node") != F.col("leader")).withColumn("fits", fits.cast("int"))
    near = near.groupBy("node", "leader").agg(F.sum("fits").alias("n")).where(F.col("n") > 0)
    chosen = near.groupBy("node").agg(F.max(F.struct("n", "leader")).alias("x"))
    chosen = materialise(chosen.select("node", F.col("x.leader").alias("anchor"), F.col("x.n").alias("n")), "anchors")
    release(lead)
    # an anchor that is itself close to another hands its family on, once
    onward = chosen.select(F.col("node").alias("anchor"), F.col("anchor").alias("onward"), F.col("n").alias("onward_n"))
    anchored = chosen.join(onward, "anchor", "left")
    anchored = anchored.select("node", F.when((F.col("onward_n") * 2 >= F.col("n")) & (F.col("onward") != F.col("node")), F.col("onward"))
                               .otherwise(F.col("anchor")).alias("anchor"))
    anchored = materialise(anchored, "anchored")
    release(chosen)

    def sets_of(nodes: DataFrame) -> DataFrame:
        """The full sets of some nodes, from the text of one document each.
        Not written: what reads them shuffles them once, so they'd lie on disk twice."""
        which = materialise(one.join(nodes.distinct(), "node", "left_semi").select("node", "doc_id"), "wanted")
        texts = docs.select("doc_id", "text").join(small(which, BROADCAST_ROWS), "doc_id")
        rows = shingle_rows(texts, n, ["node"]).mapInArrow(_set_rows, "node long, elements binary, right boolean")
        # a doc_id that repeats with other texts gives their sets too; only the right one counts
        return rows.where("right").select("node", "elements")

    def with_sets(pairs: DataFrame) -> DataFrame:
        """Each pair (a, b) with both sets: b's goes to the place of a's, once."""
        sa = sets_of(pairs.select(F.col("a").alias("node"))).select(F.col("node").alias("a"), F.col("elements").alias("set_a"))
        sb = sets_of(pairs.select(F.col("b").alias("node")))
        sb = sb.join(small(pairs, BROADCAST_ROWS), F.col("node") == F.col("b")).select("a", "b", F.col("elements").alias("set_b"))
        return sb.join(sa, "a")

    pairs = materialise(anchored.select(F.col("anchor").alias("a"), F.col("node").alias("b")), "anchor-pairs")
    told = with_sets(pairs).mapInArrow(
        _differences(share), "a long, b long, linked boolean, size_a long, size_b long, lacks binary, beside binary")
    told = materialise(told, "differences", BATCH_ROWS)
    release(pairs)
    direct = materialise(told.where("linked").select("a", "b"), "direct")
    # families in which not every set is linked to the anchor: those sets meet
    # each other and the linked ones, which needn't meet among themselves
    apart = F.count_if(~F.col("linked"))
    families = told.groupBy("a").agg(F.count("*").alias("members"), apart.alias("apart")).where((F.col("apart") > 0) & (F.col("members") > 1))
    families = families.select("a", F.ceil((F.col("members") - F.col("apart")) / F.lit(FAMILY)).cast("int").alias("near"),
                               F.ceil(F.col("apart") / F.lit(FAMILY)).cast("int").alias("far"))
    near, far = F.col("near"), F.col("far")
    rows = told.join(materialise(families, "families"), "a")
    rows = rows.withColumn("block", F.when(F.col("linked"), F.pmod(F.xxhash64("b"), F.greatest(near, F.lit(1)))).otherwise(near + F.pmod(F.xxhash64("b"), far)).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.when(F.col("linked"), near).otherwise(F.lit(0)), near + far - 1)))
    rows = rows.select("a", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.col("b").alias("node"),
                       F.col("size_b").alias("size"), F.col("size_a").alias("anchor_size"), "lacks", "beside")
    inner = materialise(rows.groupBy("a", "i", "j").applyInPandas(_family(share), "a long, b long"), "family-links")
    release(told)
    where = components(direct.unionByName(inner))
    # what is left crosses anchors and components
    left = listed.join(where, "node", "left").join(anchored, "node", "left")
    left = left.select("element", "node", "size", "at", F.coalesce("comp", "node").alias("comp"), F.coalesce("anchor", "node").alias("anchor"))
    several = left.groupBy("element").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("anchor").alias("first"), F.max("anchor").alias("last"))
    several = materialise(several.where((F.col("lo") != F.col("hi")) & (F.col("first") != F.col("last"))).select("element"), "mixed")
    left = left.join(several, "element", "left_semi")
    # a long list is dealt out: each two of its blocks meet in a part of their own
    long = left.groupBy("element").agg(F.ceil(F.count("*") / F.lit(LIST)).cast("int").alias("blocks")).where(F.col("blocks") > 1)
    left = left.join(materialise(long, "long-lists"), "element", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    left = left.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.withColumn("part", F.xxhash64("element", F.least("own", "other"), F.greatest("own", "other")))
    rest = (left.repartition("part").sortWithinPartitions("part").select("part", "node", "comp", "anchor", "size", "at", "own")
            .mapInArrow(_across(share), "a long, b long").distinct())
    rest = materialise(rest, "candidates")
    release(listed, several, where, anchored)
    got = materialise(with_sets(rest).mapInArrow(_verify(share), "a long, b long, linked boolean"), "checked", BATCH_ROWS)
    release(rest, one)
    return described, components(direct.unionByName(inner).unionByName(got.where("linked").select("a", "b")))


def join(docs: DataFrame, share: int = 90, n: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the
    smallest doc_id that links reach, itself included)."""
    described, where = links(docs, share, n)
    named = described.where((F.col("size") > 0) & F.col("doc_id").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("first"))
    named = named.join(where, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), "first")
    named = materialise(named, "named")
    smallest = materialise(named.groupBy("comp").agg(F.min("first").alias("component_id")), "smallest")
    by_node = materialise(named.join(smallest, "comp").select("node", "component_id"), "by-node")
    release(named, smallest)
    out = described.join(by_node, "node", "left")
    own = F.when((F.col("size") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("size").alias("n_shingles"), own.alias("component_id"))


def keep_first(docs: DataFrame, share: int = 90, n: int = 3) -> DataFrame:
    """The rows of ``docs`` but those of linked documents whose doc_id isn't
    the smallest of its component; null doc_ids stay."""
    groups = join(docs, share, n)
    drop = groups.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(small(materialise(drop, "dropped"), BROADCAST_ROWS), "doc_id", "left_anti")
