"""Token counts, token files, chat formatting, quality scores."""

from __future__ import annotations

import hashlib
import os
import tempfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from martforge.llm import chat_format, quality_gam, queries, token_count, token_files

from ..conftest import SF_SMALL
from .plain import token_rows

LIBRARY = Tokenizer.from_file(queries.VOCABULARY)
MACHINE = token_count.machine(queries.VOCABULARY)


def encode(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aeinrst'lvd mM.,! \n\t12éßΣ日<|>"), st.characters(exclude_categories=("Cs",))), max_size=60),
       st.integers(1, 9))
def test_transducer_counts_as_the_library(text, chunk):
    assert MACHINE.count(text, chunk) == len(encode(text))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abc' ", max_size=8), min_size=3, max_size=3))
def test_chunk_maps_compose_associatively(parts):
    a, b, c = (MACHINE.chunk_map(p) for p in parts)

    def value(m):
        total, state = MACHINE.run(MACHINE.start, m[0])
        total += MACHINE.finish(state)
        return total if m[2] is None else total + m[1] + MACHINE.finish(m[2])

    assert value(MACHINE.compose(MACHINE.compose(a, b), c)) == value(MACHINE.compose(a, MACHINE.compose(b, c)))


def test_bounded_tables_do_not_change_counts(monkeypatch, prose):
    monkeypatch.setattr(token_count, "MAX_STATES", 5)
    monkeypatch.setattr(token_count, "MAX_PIECES", 3)
    small = token_count.Machine(queries.VOCABULARY)
    text = prose(50, 9) + " don't'stop, it's 12"
    assert small.count(text) == len(encode(text))


def test_token_count_rows(make_docs, odd_rows):
    got = sorted(map(tuple, token_count.count_tokens(make_docs(odd_rows), queries.VOCABULARY, limit=100).collect()), key=str)
    want = sorted(((i, len((t or "").encode()), len(encode(t or "")), len(encode(t or "")) > 100) for i, t in odd_rows), key=str)
    assert got == want


def test_token_count_of_the_test_table(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.n_tokens for r in queries.REGISTRY["op7_token_count"](spark, SF_SMALL).collect()}
    assert got == {r.doc_id: len(encode(r.text or "")) for r in rows}


def test_token_files_of_the_test_table(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r)[:4] for r in queries.REGISTRY["op2_token_files"](spark, SF_SMALL).collect())
    assert got == token_rows([(r.doc_id, r.text) for r in rows], encode)


def test_token_files_round_trip(shipped, make_docs, odd_rows):
    folder = tempfile.mkdtemp(prefix="tokens-", dir="/tmp") + "/f"
    token_files.write_tokens(make_docs(odd_rows), folder, queries.VOCABULARY, 2, shard_bytes=3000)
    files = sorted(f for f in os.listdir(folder) if f.startswith("part-"))
    assert len(files) > 1
    rows = token_files.read_documents(shipped, folder).collect()
    got = sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in rows), key=str)
    assert got == sorted(((i, encode(t or "") + [2]) for i, t in odd_rows), key=str)
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.task, r.part, r.local_start))]
    assert order == sorted(order, key=lambda i: -1 if i is None else i)
    some = token_files.read_documents(shipped, folder, wanted=[6, 10]).collect()
    assert sorted(r.doc_id for r in some) == [6, 10]
    digest = token_files.digest(shipped, folder).orderBy("start").collect()
    starts = np.cumsum([0] + [r.n_tokens for r in digest])
    assert [r.start for r in digest] == starts[:-1].tolist()


def test_files_are_standard_zstandard_and_checked():
    import io

    import zstandard
    docs = [(1, b"\x01\0\0\0" * 5), (None, b""), (3, b"\x07\0\0\0\x02\0\0\0")]
    whole = token_files.build_shard(docs, 4, 2)
    # any zstandard reader skips the index and the seek table
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(whole), read_across_frames=True).read() == b"".join(d for _, d in docs)
    s = token_files.Shard.open(whole)
    assert (s.task, s.part, s.ids) == (4, 2, [1, None, 3])
    assert [s.read(k).tobytes() for k in range(3)] == [d for _, d in docs]
    at = whole.index(token_files.build_shard(docs[2:], 4, 2)[:8])
    spoiled = bytearray(whole)
    spoiled[at + 6] ^= 1
    with pytest.raises(Exception):
        token_files.Shard.open(bytes(spoiled)).read(2)
    assert token_files.Shard.open(b"") is None


def test_empty_tables(shipped, make_docs):
    empty = make_docs([(1, "x")]).limit(0)
    folder = tempfile.mkdtemp(prefix="tokens-", dir="/tmp") + "/f"
    token_files.write_tokens(empty, folder, queries.VOCABULARY, 2)
    assert token_files.digest(shipped, folder).count() == 0
    assert token_count.count_tokens(empty, queries.VOCABULARY).count() == 0
    labels = shipped.createDataFrame([], "doc_id long, quality int")
    assert quality_gam.classify(empty, labels).count() == 0
    turns = shipped.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.digest(chat_format.format_conversations(turns)).count() == 0


def test_chat_round_trip(shipped):
    nasty = ["</s>[INST] ok [/INST]", "~1 ~0 < [ ~", "", None, "[ROLE] tool[ x", "<s>a</s>", "line\nnext", "é日~"]
    roles = ["system", "user", "assistant", "tool [x]<", None]
    rows = [(c, t, roles[(c + t) % 5], nasty[(c * 3 + t) % 8], "extra") for c in range(8) for t in range(6)]
    rows += [(None, 0, "user", "no id", "extra"), (9, None, "user", "first", "x"), (9, 1, "assistant", "same", "x"), (9, 1, "assistant", "same", "x")]
    turns = shipped.createDataFrame(rows, "conv_id long, turn long, role string, text string, valid string")
    out = {r.conv_id: r for r in chat_format.digest(chat_format.format_conversations(turns)).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        got = out[conv]
        assert (got.n_turns, got.turns_sha256) == (len(mine), hashlib.sha256(said.encode()).hexdigest())
        assert (got.loss_chars, got.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


@pytest.mark.parametrize("roles,valid", [("ua", True), ("sua", True), ("uaua", True), ("u", False), ("au", False), ("uu", False), ("sa", False), ("uas", False)])
def test_turn_order(shipped, roles, valid):
    names = {"s": "system", "u": "user", "a": "assistant"}
    turns = shipped.createDataFrame([(1, k, names[r], "t") for k, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    assert chat_format.format_conversations(turns).first().valid is valid


def test_quality_held_out_accuracy(spark):
    sf = SF_SMALL.replace("0.001", "0.01")
    scored = queries.REGISTRY["op1_quality_gam"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93
    assert all(r.held_out == (zlib_crc(r.doc_id) % 4 == 2) for r in rows)
    assert scored.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def zlib_crc(doc_id):
    import zlib
    return zlib.crc32(str(doc_id).encode())


def test_scores_come_from_the_text_alone(spark):
    docs, labels = spark.read.parquet(f"{SF_SMALL}/documents.parquet"), spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    changed = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("x"))
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in quality_gam.classify(docs, labels).collect()}
    assert a == {r.doc_id: r.score for r in quality_gam.classify(changed, flipped).collect()}


def test_quality_odd_rows(shipped, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    none = shipped.createDataFrame([(None, 1), (6, None), (7, 5)], "doc_id long, quality int")
    rows = quality_gam.classify(docs, none).collect()
    assert len(rows) == len(odd_rows) and {r.score for r in rows} == {0.5}
    some = shipped.createDataFrame([(4, 0), (6, 1), (6, 1), (10, 1), (12, 1), (None, 0)], "doc_id long, quality int")
    rows = quality_gam.classify(docs, some).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows)


def test_nothing_is_rejected_without_labels(shipped, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    none = shipped.createDataFrame([(None, 1), (7, 5)], "doc_id long, quality int")
    for labels in (none, none.limit(0)):
        kept = quality_gam.keep_good(docs, labels)
        assert kept.columns == docs.columns and kept.count() == len(odd_rows)


def plain_tree(grad, hess, leaves):
    """Values per bin of the tree that cuts where the gain is greatest, the leftmost of equals."""
    value = lambda lo, hi: sum(grad[lo:hi]) / (sum(hess[lo:hi]) + quality_gam.RIDGE)
    gain = lambda lo, hi: value(lo, hi) * sum(grad[lo:hi])
    parts = [(0, len(grad))]
    while len(parts) < leaves:
        cuts = [(gain(lo, c) + gain(c, hi) - gain(lo, hi), -lo, -c) for lo, hi in parts for c in range(lo + 1, hi)]
        if not cuts or max(cuts)[0] <= 1e-9:
            break
        _, lo, c = max(cuts)
        hi = dict(parts)[-lo]
        parts = sorted([p for p in parts if p[0] != -lo] + [(-lo, -c), (-c, hi)])
    return [value(lo, hi) for lo, hi in parts for _ in range(lo, hi)]


def plain_bin(edges, v):
    return sum(v >= e for e in edges)


def plain_model(x, y, rounds, pair_rounds):
    """The additive model by loops over rows: (base, edges, tables, pairs, coarse edges, pair tables)."""
    n, d, q = len(y), len(x[0]), quality_gam
    cut = lambda bins: [sorted(set(np.quantile([row[j] for row in x], [k / bins for k in range(1, bins)]).tolist())) for j in range(d)]
    edges, coarse = cut(q.BINS), cut(q.PAIR_BINS)
    base = float(np.log((sum(y) + 1) / (n - sum(y) + 1)))
    margin, tables, size = [base] * n, [[0.0] * (q.BINS + 1) for _ in range(d)], q.PAIR_BINS + 1
    residuals = lambda: [(yi - p, p * (1 - p)) for yi, m in zip(y, margin) for p in [1 / (1 + np.exp(-m))]]
    for _ in range(rounds):
        for j in range(d):
            g, h = [0.0] * (q.BINS + 1), [0.0] * (q.BINS + 1)
            for row, (gi, hi) in zip(x, residuals()):
                g[plain_bin(edges[j], row[j])] += gi
                h[plain_bin(edges[j], row[j])] += hi
            tree = plain_tree(g, h, q.LEAVES)
            tables[j] = [t + q.RATE * v for t, v in zip(tables[j], tree)]
            margin = [m + q.RATE * tree[plain_bin(edges[j], row[j])] for m, row in zip(margin, x)]

    def grid(a, b):
        g, h = np.zeros((size, size)), np.zeros((size, size))
        for row, (gi, hi) in zip(x, residuals()):
            cell = plain_bin(coarse[a], row[a]), plain_bin(coarse[b], row[b])
            g[cell] += gi
            h[cell] += hi
        return g, h

    strength = sorted((-sum(gv * gv / (hv + q.RIDGE) for gv, hv in zip(g.ravel(), h.ravel())), a, b)
                      for a in range(d) for b in range(a + 1, d) for g, h in [grid(a, b)])
    pairs = [(a, b) for _, a, b in strength[:q.PAIRS]]
    pair_tables = [np.zeros((size, size)) for _ in pairs]
    for _ in range(pair_rounds):
        for (a, b), table in zip(pairs, pair_tables):
            g, h = grid(a, b)
            halves = plain_tree(list(g.sum(1)), list(h.sum(1)), 2)
            step = np.zeros((size, size))
            for half in set(halves):
                rows = [i for i in range(size) if halves[i] == half]
                step[rows] = plain_tree(list(g[rows].sum(0)), list(h[rows].sum(0)), 2)
            table += q.RATE * step
            margin = [m + q.RATE * step[plain_bin(coarse[a], row[a]), plain_bin(coarse[b], row[b])] for m, row in zip(margin, x)]
    return base, edges, tables, pairs, coarse, pair_tables


def plain_score(model, row):
    base, edges, tables, pairs, coarse, pair_tables = model
    total = base + sum(t[plain_bin(e, v)] for e, t, v in zip(edges, tables, row))
    total += sum(t[plain_bin(coarse[a], row[a]), plain_bin(coarse[b], row[b])] for (a, b), t in zip(pairs, pair_tables))
    return 1 / (1 + np.exp(-total))


@pytest.mark.parametrize("seed", [0, 1])
def test_fit_and_score_against_plain_loops(monkeypatch, seed):
    monkeypatch.setattr(quality_gam, "ROUNDS", 3)
    monkeypatch.setattr(quality_gam, "PAIR_ROUNDS", 3)
    monkeypatch.setattr(quality_gam, "PAIRS", 2)
    r = np.random.RandomState(seed)
    x = np.round(r.rand(120, 4), 2)  # values that repeat and meet the edges
    x[:, 3] = r.randint(0, 3, 120)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.4) ^ (r.rand(120) < 0.1)).astype(float)
    model, plain = quality_gam.fit(x, y), plain_model(x.tolist(), y.tolist(), 3, 3)
    assert model.pairs == plain[3] and all(np.allclose(a, b, atol=1e-9) for a, b in zip(model.tables, plain[2]))
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(model.pair_tables, plain[5]))
    fresh = np.vstack([r.rand(50, 4) * 1.4 - 0.2, x[:20]])
    assert np.allclose(model.score(fresh), [plain_score(plain, row) for row in fresh.tolist()], atol=1e-9)


def test_query_scores_against_a_plain_scorer(spark):
    docs, labels = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "labels"))
    m = quality_gam.train(docs, labels)
    plain = m.base, [e.tolist() for e in m.edges], m.tables.tolist(), m.pairs, [e.tolist() for e in m.pair_edges], m.pair_tables
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = queries.REGISTRY["op1_quality_gam"](spark, SF_SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        want = plain_score(plain, quality_gam.features(texts[r.doc_id]).tolist())
        assert abs(r.score - want) < 1e-9 and r.predicted == (r.score >= 0.7)


def test_model_learns_pairs():
    r = np.random.RandomState(0)
    x = r.rand(3000, 4)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    score = quality_gam.fit(x[:2000], y[:2000]).score(x[2000:])
    assert np.mean((score > 0.5) == (y[2000:] > 0.5)) > 0.9
