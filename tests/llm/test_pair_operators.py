"""Set joins, passages, decontamination, licenses, mixing, vector search."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from martforge.llm import components, decontaminate, jaccard_join, license_scan, mixing, queries, substring_dedup, topk_search

from ..conftest import SF_SMALL
from .plain import decontaminated, item_words, jaccard_components, shingle_set, verbatim


def by_id(rows):
    return [(i, t) for i, t in dict((r for r in rows if r[0] is not None)).items()]


@pytest.mark.parametrize("share,n", [(90, 3), (80, 5)])
def test_jaccard_components_of_the_test_table(spark, share, n):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs, share, n).collect()}
    assert got == jaccard_components(rows, share, n)


def test_jaccard_groups_of_near_copies(make_docs, prose):
    """Chains and stars of edits, so that leaders don't meet every member."""
    r, rows = random.Random(5), []
    for group in range(6):
        words = prose(90, 100 + group, 900).split()
        for k in range(25):
            copy = list(words)
            for _ in range(r.randrange(4)):
                copy[r.randrange(len(copy))] = f"e{r.randrange(50)}"
            if k % 5 == 0:
                words = copy
            rows.append((group * 100 + k, " ".join(copy)))
    want = jaccard_components(rows, 90, 3)
    assert len({c for _, c in want.values()}) < len(rows) - 20
    r.shuffle(rows)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.join(make_docs(rows), 90, 3).collect()}
    assert got == want


@pytest.mark.parametrize("share,n", [(90, 3), (80, 5)])
def test_jaccard_of_short_texts_with_common_phrases(make_docs, share, n):
    """Prefixes that the zone doesn't fill: the rest of their order counts."""
    r = random.Random(8)
    phrases = [[f"p{k}x{i}" for i in range(r.randrange(3, 9))] for k in range(30)]
    rows = []
    for k in range(3000):
        words = [w for _ in range(2) for w in r.choice(phrases)] + [f"u{k // 2}x{i}" for i in range(r.randrange(3))]
        rows.append((k, " ".join(words + [f"z{r.randrange(9)}"] * r.randrange(2))))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.join(make_docs(rows), share, n).collect()}
    assert got == jaccard_components(rows, share, n)


def test_jaccard_odd_rows(make_docs, odd_rows):
    rows = jaccard_join.join(make_docs(odd_rows), 90, 3).collect()
    assert len(rows) == len(odd_rows)
    want = jaccard_components(by_id(odd_rows), 90, 3)
    for r in rows:
        assert (r.n_shingles, r.component_id) == ((len(shingle_set("no id here at all", 3)), None) if r.doc_id is None else want[r.doc_id])
    kept = [r.doc_id for r in jaccard_join.keep_first(make_docs(odd_rows), 80, 5).collect()]
    assert 6 in kept and 7 not in kept and 8 not in kept and None in kept and 2 in kept


def test_components_of_chains_and_stars(shipped):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    got = {r.node: r.comp for r in components.components(shipped.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(41)} == {0} and {got[100 + k] for k in range(30)} == {100}
    assert components.components(shipped.createDataFrame([], "a long, b long")).count() == 0


def test_decontamination_with_short_items(shipped, make_docs, prose):
    long = prose(25, 50, 200)
    items = [(1, long), (2, "three little words"), (3, "One!"), (4, None), (5, ""), (6, long.upper()), (None, prose(12, 51, 200)), (1, prose(14, 52, 200))]
    docs = [(1, f"start {long} end"), (2, "x three, little WORDS one y"), (3, None), (4, ""), (5, prose(60, 53, 200)), (6, " ".join(long.split()[3:14])),
            (7, " ".join(long.split()[3:12])), (8, prose(12, 51, 200)), (9, long + " " + long), (9, long + " " + long), (None, long), (10, prose(14, 52, 200))]
    benchmark = shipped.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, run string")
    got = sorted((tuple(r) for r in decontaminate.report(make_docs(docs), benchmark).collect()), key=str)
    known = [("" if i is None else i, t) for i, t in items]
    want = []
    for i, t in docs:
        n, hit, ids = decontaminated(t, known)
        want.append((i, n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0))
    assert got == sorted(want, key=str)
    clean = sorted((r.doc_id for r in decontaminate.clean(make_docs(docs), benchmark).collect()), key=str)
    assert clean == sorted((w[0] for w in want if not w[5]), key=str)


def test_decontamination_of_empty_tables(shipped, make_docs, odd_rows):
    none = shipped.createDataFrame([], "item_id long, text string")
    rows = decontaminate.report(make_docs(odd_rows), none).collect()
    assert len(rows) == len(odd_rows) and not any(r.contaminated for r in rows)
    assert {r.doc_id: r.n_words for r in rows if r.doc_id is not None} == {i: len(item_words(t)) for i, t in by_id(odd_rows)}
    some = shipped.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.report(make_docs(odd_rows).limit(0), some).count() == 0


def test_passages(make_docs, prose, odd_rows):
    passages = [prose(52, 70 + k) for k in range(4)]
    rows = [(k, prose(40 + 13 * k, 200 + k) + " " + passages[k % 4] + " " + prose(30 + 7 * k, 300 + k)) for k in range(24)]
    rows += [(100 + k, prose(120, 400 + k)) for k in range(10)]  # clean
    part = passages[0].split()
    rows += [(200 + k, prose(60, 500 + k) + " " + " ".join(part[k:k + 30]) + " " + prose(60, 600 + k)) for k in range(8)]  # too short to count
    got = {r.doc_id: r for r in substring_dedup.repeated(make_docs(rows)).collect()}
    assert set(got) == verbatim(rows) == set(range(24))
    assert {got[k].class_id for k in range(24)} == {0, 1, 2, 3}
    for k in range(24):
        first, last = got[k].spans[0]
        assert first <= 40 + 13 * k + 1 and last >= 40 + 13 * k + 50 and got[k].n_repeated <= 60
    odd = {r.doc_id: r for r in substring_dedup.repeated(make_docs(odd_rows)).collect()}
    assert verbatim(by_id(odd_rows)) <= set(odd) and None not in odd and 10 not in odd
    assert substring_dedup.repeated(make_docs(rows).limit(0)).count() == 0


def test_near_passages(make_docs, prose):
    """Passages of 300 words, an edit each 60 words: similarity above 0.8."""
    rows = []
    for k in range(10):
        base = prose(300, 900 + k).split()
        edited = [w if (i + 31) % 60 else "changed" for i, w in enumerate(base)]
        rows += [(2 * k, prose(50, 1000 + k) + " " + " ".join(base)), (2 * k + 1, " ".join(edited) + " " + prose(50, 1100 + k))]
    got = {r.doc_id for r in substring_dedup.repeated(make_docs(rows)).collect()}
    assert len(got) == 20


def test_compact_windows_cover_every_run():
    h = np.random.RandomState(1).randint(0, 40, 60).astype(np.uint64)
    windows = substring_dedup.compact_windows(h, 5)
    for i in range(60):
        for j in range(i + 4, 60):
            cover = [c for lo, c, hi in windows if lo <= i <= c <= j <= hi]
            assert len(cover) == 1 and h[cover[0]] == h[i:j + 1].min()


def test_licenses_against_plain_containment(spark, make_docs, odd_rows, prose):
    def shingles(text):
        w = [x for x in item_words((text or "").lower())]
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    rows = list(odd_rows) + [(50 + k, prose(30 + k, 800 + k) + ". " + line + "\n" + prose(40, 850 + k)) for k, line in enumerate(license_scan.TEMPLATES.values())]
    rows += [(90, "Licensed under the Apache"), (91, license_scan.TEMPLATES["MIT-text"].upper()), (92, license_scan.TEMPLATES["MIT-text"] + " and more")]
    want = set()
    for i, t in rows:
        for name, line in license_scan.TEMPLATES.items():
            if len(shingles(line) & shingles(t)) >= 0.8 * len(shingles(line)):
                want.add((i, name))
    got = license_scan.scan(make_docs(rows)).collect()
    assert {(r.doc_id, r.license) for r in got} == want and len(got) == len(want)
    assert license_scan.scan(make_docs(rows).limit(0)).count() == 0
    assert license_scan.miss_bound(1) < 0.002 and license_scan.miss_bound(3) < 0.002
    with pytest.raises(ValueError):
        license_scan.scan(make_docs(rows), {"short": "too short"})


def test_a_license_of_one_shingle_is_found_everywhere(make_docs, prose):
    rows = [(k, prose(3, 5000 + k) + " released under the MIT license " + prose(3, 6000 + k)) for k in range(4000)]
    rows += [(9000 + k, prose(20, 7000 + k)) for k in range(50)]
    found = license_scan.scan(make_docs(rows)).collect()
    assert sorted((r.doc_id, r.license, r.containment) for r in found) == [(k, "MIT", 1.0) for k in range(4000)]
    assert {r["at"] for r in found} <= {2, 3}  # a window is two shingles: the one before may show the line


def test_licenses_of_rows_that_share_an_id(make_docs, prose):
    texts = ["x " + license_scan.TEMPLATES["CC-BY-4.0"], prose(30, 1) + " " + license_scan.TEMPLATES["CC-BY-4.0"], prose(9, 2), None]
    seen = []
    for order in (texts, texts[::-1]):
        rows = [(i, t) for t in order for i in (None, 5, 5)]
        seen.append(sorted((str(r.doc_id), r.license, r.containment, r["at"]) for r in license_scan.scan(make_docs(rows)).collect()))
    assert seen[0] == seen[1] and len(seen[0]) == 4 and {s[0] for s in seen[0]} == {"5", "None"}


def test_mix_reaches_its_margins(make_docs, prose, shipped):
    rows = [(i, prose(20 + i % 7, i) + (" Licensed x" if i % 4 == 0 else "")) for i in range(300)]
    mix = mixing.Mix(power={"source": 0.0, "lang": 1.0, "topic": 1.0}, shares={"lang": {"en": 0.5}}, keep=0.5)
    described = mixing.describe(make_docs(rows))
    cells = mixing.rake(described, mix).collect()
    total = sum(c.raked for c in cells)
    sources = {s: sum(c.raked for c in cells if c.source == s) / total for s in {c.source for c in cells}}
    assert max(sources.values()) - min(sources.values()) < 1e-3  # power 0: even
    assert abs(sum(min(1, c.p) * c.tokens for c in cells) / sum(c.tokens for c in cells) - 0.5) < 1e-3
    out = mixing.sample(make_docs(rows), mix).collect()
    assert len(out) == 300 and 0.3 < sum(r.n_tokens for r in out if r.kept) / sum(r.n_tokens for r in out) < 0.7
    kept = mixing.mixed(make_docs(rows), mix)
    assert kept.columns == make_docs(rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in out if r.kept)


def test_mix_odd_rows(make_docs, odd_rows):
    out = mixing.sample(make_docs(odd_rows)).collect()
    assert len(out) == len(odd_rows) and all(0 <= r.p <= 1 for r in out)
    assert mixing.sample(make_docs(odd_rows).limit(0)).count() == 0
    assert mixing.mixed(make_docs(odd_rows).limit(0)).count() == 0


def test_search_with_ties_copies_and_bad_rows(shipped):
    r = random.Random(3)
    rows = [(i, [r.choice([-1.0, 0.25, 0.5, 1.0]) for _ in range(4)]) for i in range(400)]
    rows += [(1000 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(200)]  # copies
    rows += [(50, None), (None, [1.0] * 4), (2000, [1.0, None, 1.0, 1.0]), (2050, [float("nan")] * 4), (2100, [float("inf")] * 4), (2150, []), (2200, [2.0, 1.0])]
    rows += [rows[3], rows[100]]
    frame = shipped.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good.setdefault(i, set()).add(tuple(int(np.floor(256 * x)) for x in v))
    good = {(i, v) for i, vs in good.items() for v in vs}
    want = set()
    for q, v in good:
        if q % 50 == 0:
            every = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:5]
            want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(every)}
    got = {tuple(x) for x in topk_search.top_k(frame).collect()}
    assert got == want
    assert topk_search.top_k(frame.limit(0)).count() == 0
    assert topk_search.top_k(frame.where("vec_id in (0, 1, 2)")).count() == 2


def test_search_prunes(shipped, monkeypatch):
    """With small blocks many annuli exist, and the result is the same."""
    monkeypatch.setattr(topk_search, "BLOCK", 32)
    from ..oracle_compare import compare, duck
    got = compare(shipped, "op9", SF_SMALL, queries.REGISTRY["op9_topk_search"], queries.ORACLES["op9_topk_search"], duck(SF_SMALL))
    assert got["values_match"], got


@pytest.mark.parametrize("share, n", [(90, 3), (80, 5)])
def test_jaccard_family_with_stragglers_and_long_lists(make_docs, monkeypatch, share, n):
    """Many near copies of which few aren't linked to the anchor, and elements
    in more lists than a block holds: equal to brute force."""
    monkeypatch.setattr(jaccard_join, "FAMILY", 4)
    monkeypatch.setattr(jaccard_join, "LIST", 3)
    r, rows = random.Random(11), []
    base = [f"b{k}" for k in range(60)]
    for k in range(30):
        text = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 5])):
            text[r.randrange(len(text))] = f"x{r.randrange(9)}"
        rows.append((k, " ".join(text)))
    common = [f"c{k}" for k in range(8)]
    rows += [(100 + k, " ".join(common[:r.randrange(5, 9)] + [f"t{r.randrange(3)}" for _ in range(r.randrange(0, 4))])) for k in range(60)]
    want = jaccard_components(rows, share, n)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(make_docs(rows), share, n).collect()}
    assert got == want
