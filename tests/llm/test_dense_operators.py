"""Packing, whitening, centroid clustering and the encoder, against plain code."""

from __future__ import annotations

import hashlib
import math
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from martforge.llm import centroids, encoding, packing, queries, whitening

from ..conftest import SF_SMALL

LIBRARY = Tokenizer.from_file(queries.VOCABULARY)


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


# -- encoder ------------------------------------------------------------------

ODD = ["<|endoftext|>", "<|", "İ;", "H̱", "'s", "don't", "K", "é", "é.", "\x1c", "\x0b", " ", "日本", "ẞ!", "\U0001f600"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from(ODD), st.text(alphabet="aeinrstIK'.,;!& \n\t12", max_size=6),
                                   st.characters(exclude_categories=("Cs",))), max_size=12).map("".join), min_size=1, max_size=5))
def test_encoder_gives_the_library_ids(texts):
    got = [ids.tolist() for ids in encoding.Encoder(queries.VOCABULARY).encode(pa.array(texts, pa.string()))]
    assert got == [library(t) for t in texts]


def test_encoder_with_a_small_table_and_odd_rows(monkeypatch, odd_rows):
    monkeypatch.setattr(encoding, "KEPT_CHARS", 50)
    monkeypatch.setattr(encoding, "SPLIT_BYTES", 200)
    texts = [t for _, t in odd_rows] * 2
    encoder = encoding.Encoder(queries.VOCABULARY)
    assert [ids.tolist() for ids in encoder.encode(pa.array(texts, pa.string()))] == [library(t) for t in texts]


# -- packing ------------------------------------------------------------------

def check_packed(rows, docs, end_id, size):
    """Every token in one piece, sequences gapless; returns the sequence lengths."""
    want = sorted(((i, tuple(library(t) + [end_id])) for i, t in docs), key=str)
    pieces, sequences = {}, {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], len(ids)))
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], ids))
    for spans in sequences.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= size
    got = []
    for (doc_id, n), parts in pieces.items():
        copies = sum(1 for start, _ in parts if start == 0)
        assert sum(len(ids) for _, ids in parts) == copies * n
        if copies == 1:
            whole = []
            for start, ids in sorted(parts):
                assert start == len(whole)
                whole += ids
            got.append((doc_id, tuple(whole)))
        else:  # repeated rows: equal in number and tokens, checked above
            got += [w for w in want if w[0] == doc_id and len(w[1]) == n]
    assert sorted(got, key=str) == want
    return [sum(n for _, n in spans) for spans in sequences.values()]


@pytest.mark.parametrize("size, windows, merge", [(2048, 64, 64), (64, 3, 1), (16, 1, 64), (1, 2, 2)])
def test_packing_of_odd_rows(make_docs, odd_rows, monkeypatch, size, windows, merge):
    monkeypatch.setattr(packing, "MERGE", merge)
    docs = make_docs(odd_rows).repartition(3)
    rows = packing.pack(docs, queries.VOCABULARY, 1, size=size, windows=windows).collect()
    lengths = check_packed(rows, odd_rows, 1, size)
    assert sum(n & (n - 1) != 0 for n in lengths) == 0  # full or a power of two: no padding


def test_packing_of_nothing(make_docs):
    out = packing.digest(packing.pack(make_docs([]), queries.VOCABULARY, 1))
    assert out.collect() == [] and out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_packing_query(spark):
    got = queries.REGISTRY["op11_packing"](spark, SF_SMALL).collect()
    docs = {r["doc_id"]: library(r["text"]) + [1] for r in queries.table(spark, SF_SMALL, "documents").select("doc_id", "text").collect()}
    assert {r["doc_id"] for r in got} == set(docs)
    for r in got:
        ids = docs[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert len(ids) == r["length"] and r["doc_tokens"] == len(docs[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60), st.integers(1, 5))
def test_windows_place_every_token_once(sizes, windows):
    held, out = packing.Windows(16, windows), []
    for doc, n in enumerate(sizes):
        out += held.add(doc, np.arange(n, dtype=np.uint32))
        assert len(held.pieces) <= windows
    assert all(sum(len(p[2]) for p in w) == 16 for w in out)
    out += packing.joined(held.rest(), 16)
    tokens = sorted((p[0], int(t)) for w in out for p in w for t in p[2])
    assert tokens == [(doc, t) for doc, n in enumerate(sizes) for t in range(n)]


def test_best_fit_before_the_fullest():
    held = packing.Windows(16, 2)
    assert list(held.add("a", np.zeros(9, np.uint32))) == [] and list(held.add("b", np.zeros(12, np.uint32))) == []
    assert list(held.add("c", np.zeros(4, np.uint32))) == [[("b", 0, pytest.approx(np.zeros(12)), 12), ("c", 0, pytest.approx(np.zeros(4)), 4)]]
    list(held.add("d", np.zeros(10, np.uint32)))
    (full,) = held.add("e", np.zeros(8, np.uint32))  # fits nowhere: tops up d's window, the fullest
    assert [(p[0], p[1], len(p[2])) for p in full] == [("d", 0, 10), ("e", 0, 6)]


# -- embeddings ---------------------------------------------------------------

@pytest.fixture(scope="module")
def make_vectors(shipped):
    def make(rows):
        full = [(i, v, 1, [1], 2, "x", 0.5) for i, v in rows]
        return shipped.createDataFrame(full, "vec_id long, embedding array<float>, cluster int, t array<int>, n int, x string, distance double").repartition(3)
    return make


def odd_vectors(dims, seed=5, n=60):
    r = np.random.default_rng(seed)
    good = [(k, [float(np.float32(x)) for x in r.standard_normal(dims) * 0.3]) for k in range(n)]
    nan, inf = float("nan"), float("inf")
    bad = [(100, None), (101, [None] + [0.5] * (dims - 1)), (102, [nan] * dims), (103, [inf] + [0.0] * (dims - 1)), (104, []),
           (105, [0.25] * (dims - 1)), (106, [0.25] * (dims + 1))]
    return good + good[:3] + [(200, good[0][1]), (None, good[1][1]), (201, [0.0] * dims), (202, [0.0] * dims)], bad


def plain_clusters(rows, k=8, rounds=10, seed=3, dims=64, scale=1024):
    kept = [(i, [math.floor(scale * float(np.float32(c))) for c in v]) for i, v in rows]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)
    means = [x for _, x in order[:k]]

    def closest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, m)), c) for c, m in enumerate(means))

    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(closest(x)[1], []).append(x)
        for c, xs in groups.items():
            means[c] = [sum(col) // len(xs) for col in zip(*xs)]
    out = [(i, *closest(x)) for i, x in kept]
    return [(i, c, d, sum(e for _, e, g in out if g == c), sum(e for _, e, _ in out),
             hashlib.sha256(",".join(map(str, means[c])).encode()).hexdigest()) for i, d, c in out]


@pytest.mark.parametrize("dims, scale", [(64, 1024), (4, 8), (1, 3)])
def test_clusters_of_odd_vectors(make_vectors, dims, scale):
    good, bad = odd_vectors(dims)
    got = centroids.digest(centroids.cluster(make_vectors(good + bad), dims=dims, scale=scale)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_clusters(good, dims=dims, scale=scale), key=str)


def test_clusters_of_few_or_no_vectors(make_vectors):
    few = [(k, [float(k)] * 64) for k in range(3)]
    got = centroids.digest(centroids.cluster(make_vectors(few))).collect()
    assert sorted(map(tuple, got)) == sorted(plain_clusters(few))
    empty = centroids.digest(centroids.cluster(make_vectors([(1, None)])))
    assert empty.collect() == [] and empty.columns[-1] == "centroid_sha256"


def test_clusters_of_large_components(make_vectors):
    big = [(k, [float(np.float32((-1) ** (k + j) * 10.0 ** (k % 6))) for j in range(64)]) for k in range(24)]
    got = centroids.digest(centroids.cluster(make_vectors(big))).collect()
    assert sorted(map(tuple, got)) == sorted(plain_clusters(big))


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10 ** 6), st.sampled_from([2, 5, 1 << 24, 1 << 30]))
def test_progressive_search_is_exact_and_skips(seed, spread):
    r = np.random.default_rng(seed)
    h = centroids.walsh(64)
    x, c = r.integers(-spread, spread, (40, 64)), r.integers(-spread, spread, (7, 64))
    x[:7], c[3] = c + (np.arange(64) == 5), c[1]
    number, total, taken = centroids.nearest(centroids._exact(x @ h.T), centroids._exact(c @ h.T))
    full = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, m)) for m in c] for v in x]
    assert [(int(n), int(t)) for n, t in zip(number, total)] == [(row.index(min(row)), 64 * min(row)) for row in full]
    assert taken <= x.size * (len(c) + 1)


def test_walsh_rows_go_from_coarse_to_fine():
    h = centroids.walsh(64)
    assert ((np.diff(h, axis=1) != 0).sum(1) == np.arange(64)).all() and (h @ h.T == 64 * np.eye(64)).all()


def plain_whitening(rows, components):
    x = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows]
    fit = sorted({tuple(v) for _, v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = [[Fraction(a) - Fraction(s, n) for a, s in zip(v, sums)] for v in fit]
    cov = np.array([[float(sum(r[i] * r[j] for r in centred) / n) for j in range(len(sums))] for i in range(len(sums))])
    values, unit = np.linalg.eigh(cov)
    keep = [k for k in range(len(values) - 1, -1, -1) if values[k] > 1e-10 * values[-1]][:components]
    out = {}
    for k, v in enumerate(x):
        away = np.array([float(Fraction(a) - Fraction(s, n)) for a, s in zip(v[1], sums)])
        deviation = sum((n * a - s) ** 2 for a, s in zip(v[1], sums))
        for number, e in enumerate(keep, 1):
            out.setdefault((v[0], number), []).append((n, deviation, away @ unit[:, e] / math.sqrt(values[e]), values[e] / np.trace(cov)))
    return out


@pytest.mark.parametrize("dims, n, components", [(12, 60, 16), (12, 5, 16), (6, 60, 4), (1, 10, 16)])
def test_whitening_against_exact_fractions(make_vectors, dims, n, components):
    good, bad = odd_vectors(dims, n=n)
    got = whitening.whiten(make_vectors(good + bad), components).collect()
    want = plain_whitening(good, components)
    assert len(got) == sum(map(len, want.values()))
    sign = {}
    for r in got:
        rows = want[r["vec_id"], r["component"]]
        count, deviation, value, explained = min(rows, key=lambda w: abs(int(r["deviation"]) - w[1]))
        assert (r["n"], int(r["deviation"])) == (count, deviation)
        assert r["explained"] == pytest.approx(explained, rel=1e-9) and r["identity_error"] < 1e-9
        if abs(value) > 1e-6:
            s = sign.setdefault(r["component"], math.copysign(1, value * r["whitened"]))
            assert s * r["whitened"] == pytest.approx(value, rel=1e-6)


def test_whitening_without_variance_or_rows(make_vectors):
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "eigenvalue", "identity_error"]
    for rows in ([], [(1, None)], [(1, [])], [(1, [0.5, 0.5]), (2, [0.5, 0.5])]):
        out = whitening.whiten(make_vectors(rows))
        assert out.collect() == [] and out.columns == columns


def test_whitening_keeps_wide_numbers_exact(make_vectors):
    rows = [(k, [float(2.0 ** (k % 40)), float(k), -3e12]) for k in range(50)]
    got = whitening.whiten(make_vectors(rows)).collect()
    want = plain_whitening(rows, 16)
    assert {(r["vec_id"], int(r["deviation"])) for r in got} == {(i, w[0][1]) for (i, _), w in want.items()}


@pytest.mark.parametrize("values", [[5, 5, 5, 4, 1, 1, 1, 1], [9, 1e-3, 1e-6, 0, 0, 0, 0, 0], [3.0] * 8, [1, 1 + 1e-7, 1 + 2e-7, 0, 0, 0, 0, 0], [0] * 8])
def test_contour_solver_on_equal_close_and_missing_eigenvalues(values):
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((8, 8)))
    matrix = q @ np.diag(np.array(values, float)) @ q.T
    matrix = (matrix + matrix.T) / 2
    got, unit = whitening.leading_pairs(matrix, 4)
    want = sorted((v for v in values if v > 1e-9 * max(values)), reverse=True)[:4]
    assert got == pytest.approx(want, rel=1e-9)
    assert np.abs(matrix @ unit - unit * got).max(initial=0) < 1e-12 * max(values + [1]) and np.abs(unit.T @ unit - np.eye(len(got))).max(initial=0) < 1e-12


def test_inertia_counts_find_a_missed_pair():
    matrix = np.diag([4.0, 3.0, 2.0, 1.0])
    with pytest.raises(ArithmeticError):
        whitening.interval_pairs(matrix, 1.5, 4.5, 4, 4.0, np.random.default_rng(0))
