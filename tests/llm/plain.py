"""Plain versions of the operators' results, for small tables."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def blank_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", (text or "").translate(ASCII)) if w]


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))


def shingle_set(text, n):
    w = blank_words(text)
    if len(w) < n:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1))


def jaccard_components(rows, share, n):
    """rows: (doc_id, text) with distinct ids -> {doc_id: (size, component)}"""
    sets = {i: shingle_set(t, n) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            a, b = sets[i], sets[j]
            common = len(a & b)
            if common and 100 * common >= share * (len(a) + len(b) - common):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def decontaminated(text, items, t=10):
    """(n_words, n_hit, occurring item ids)"""
    w = item_words(text)
    hit, occurring = set(), set()
    for item_id, item in items:
        v = item_words(item)
        m = min(t, len(v))
        if not m:
            continue
        runs = {tuple(v[i:i + m]) for i in range(len(v) - m + 1)}
        for i in range(len(w) - m + 1):
            if tuple(w[i:i + m]) in runs:
                hit.update(range(i, i + m))
                occurring.add(str(item_id))
    return len(w), len(hit), sorted(occurring)


def verbatim(rows, n=50):
    """doc_ids that share n consecutive words with another document."""
    holders = defaultdict(set)
    for i, text in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", (text or "").lower()) if x]
        for k in range(len(w) - n + 1):
            holders[tuple(w[k:k + n])].add(i)
    return set().union(*(h for h in holders.values() if len(h) > 1)) if holders else set()


def token_rows(rows, encode, end_id=2):
    """[(doc_id, start, n_tokens, crc)] in ascending doc_id."""
    out, start = [], 0
    for i, text in sorted(rows):
        ids = encode(text or "") + [end_id]
        out.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    return out
