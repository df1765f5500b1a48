from __future__ import annotations

import random

import pytest


@pytest.fixture(scope="session")
def shipped(spark):
    from martforge.session import ship_package
    ship_package(spark)
    return spark


@pytest.fixture(scope="session")
def make_docs(shipped):
    """Documents with extra columns whose names clash with inner ones."""
    def make(rows):
        full = [(i, t, "en" if (i or 0) % 2 else None, f"s{(i or 0) % 3}" if (i or 0) % 5 else None, len(t or ""), 7, "x", [1], 0.5) for i, t in rows]
        return shipped.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, h long, words string, element array<int>, p double").coalesce(2)
    return make


@pytest.fixture(scope="session")
def prose():
    """Deterministic invented text of n words."""
    def words(n, seed, size=4000):
        r = random.Random(seed)
        return " ".join(f"w{r.randrange(size):x}" for _ in range(n))
    return words


@pytest.fixture(scope="session")
def odd_rows(prose):
    """Nulls, empty, short, long, repeated, Unicode, copies and near copies."""
    base = prose(120, 1)
    near = base.replace(base.split()[60], "edited", 1)
    return [(None, "no id here at all"), (1, None), (2, ""), (3, "   \n\t "), (4, "One"), (5, "two words"), (6, base), (7, base), (8, near),
            (8, near), (9, "ÀÉ Ünïcode — “quotes” 日本語 it's we'll"), (10, prose(30_000, 2)), (11, base.upper()), (12, prose(200, 3) + "\n" + prose(60, 4)),
            (13, prose(150, 5) + "\n" + prose(60, 4) + "\n" + prose(80, 6)), (14, "<|endoftext|> ok \x00 \x1c control")]
