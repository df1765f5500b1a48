"""Token ids of whole texts by the tokenizers library, a batch at a time.

White space separates tokens in this kind of vocabulary (lower case, white
space dropped), so a text's ids are those of its pieces between blanks, one
after another; so does the change from a letter or digit to a run of signs
that ends a piece. A batch is split and its distinct pieces are found by
Arrow; the library encodes a piece once while it is kept, and the ids of the
batch are gathered from the kept ones.

Texts that hold ``<|`` may hold the vocabulary's special strings, which don't
end at blanks: the library encodes each of them whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters (and 8 for each) of the pieces a worker keeps; beyond, its table starts anew (bounds memory only).
KEPT_CHARS = 12_000_000
#: UTF-8 bytes of texts split at once; a longer text is split alone.
SPLIT_BYTES = 4 << 20
#: Pieces the library encodes in one call.
ASK = 20_000

#: Signs that are cut off a piece's end where they follow a letter or digit.
SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
#: Letters and digits of one code point in lower case. U+0130 isn't among
#: them: it becomes two, and the second, no letter, would join the signs.
SINGLE = frozenset(c for c in map(chr, range(0x250)) if c.isalnum() and len(c.lower()) == 1 and (c.isalpha() or c.isascii()))
#: Pieces of these letters alone are one word each, to the vocabulary's model.
WORD = re.compile("[a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u024f]+")
#: Pieces of other characters aren't lower-cased before the library does it.
PLAIN = re.compile("[\x00-\u012f\u0131-\u024f]*")


def ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches (start, size) of ``values`` one after another, and their bounds."""
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return values[np.repeat(starts - bounds[:-1], sizes) + np.arange(bounds[-1])], bounds


class Encoder:
    """Ids of texts, with a table of the pieces seen."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        spell = self.library.pre_tokenizer.pre_tokenize_str  # the model's spelling of a letter's bytes
        self.spelling = {ord(c): spell(c)[0][0] for c in map(chr, range(0xDF, 0x250)) if WORD.fullmatch(c)}
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[str, int] = {"": 0}  # piece -> row of the table
        self.bounds = np.zeros(2, np.int64)  # a row's ids: pool[bounds[row]:bounds[row + 1]]
        self.pool = np.zeros(0, np.uint32)
        self.chars = 0

    def whole(self, text: str) -> np.ndarray:
        """The library's ids of one text."""
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of single words, one after another, and where each one's end."""
        ids, ends = [], []
        for word in words:
            ids += [t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.spelling))]
            ends.append(len(ids))
        return np.array(ids, np.uint32), np.array(ends, np.int64)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of any pieces, by one call: a token belongs to the piece in which it starts."""
        answer = self.library.encode(" ".join(pieces), add_special_tokens=False)
        begins = np.fromiter((o[0] for o in answer.offsets), np.int64)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1)
        return np.array(answer.ids, np.uint32), np.searchsorted(begins, ends)

    def _learn(self, pieces: list[str]) -> None:
        """Enter pieces that aren't in the table yet."""
        words = list(filter(WORD.fullmatch, pieces))
        others = [p for p in pieces if not WORD.fullmatch(p)] if len(words) < len(pieces) else []
        pools, bounds, n = [self.pool], [self.bounds], len(self.pool)
        for known, encode in ((words, self._words), (others, self._pieces)):
            for lo in range(0, len(known), ASK):
                ids, ends = encode(known[lo:lo + ASK])
                pools.append(ids)
                bounds.append(n + ends)
                n += len(ids)
            self.rows.update(zip(known, range(len(self.rows), len(self.rows) + len(known))))
        self.chars += sum(map(len, pieces)) + 8 * len(pieces)
        self.pool, self.bounds = np.concatenate(pools), np.concatenate(bounds)

    def _rows(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each piece's row, and the row of the signs cut off its end (0: none)."""
        rows = np.fromiter(map(self.rows.get, pieces, repeat(-1)), np.int64, len(pieces))
        tails = np.zeros(len(pieces), np.int64)
        new = np.flatnonzero(rows < 0)
        first, last = [], []
        for k in new.tolist():
            piece = pieces[k]
            if piece.isascii() or PLAIN.fullmatch(piece):
                piece = piece.lower()
            stem = piece.rstrip(SIGNS)
            cut = stem if stem and stem[-1] in SINGLE else piece
            first.append(cut)
            last.append(piece[len(cut):])
        self._learn([p for p in dict.fromkeys(chain(first, last)) if p not in self.rows])
        rows[new] = np.fromiter(map(self.rows.__getitem__, first), np.int64, len(first))
        tails[new] = np.fromiter(map(self.rows.__getitem__, last), np.int64, len(last))
        return rows, tails

    def _split_encoded(self, texts: pa.Array) -> Iterator[np.ndarray]:
        if self.chars > KEPT_CHARS:
            self._clear()
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        rows = np.stack(self._rows(coded.dictionary.to_pylist()), axis=1).ravel()
        pool, bounds = ragged(self.pool, self.bounds[rows], self.bounds[rows + 1] - self.bounds[rows])
        bounds = bounds[::2]  # of the distinct pieces of this batch
        at = coded.indices.to_numpy()
        ids, ends = ragged(pool, bounds[at], bounds[at + 1] - bounds[at])
        offsets = ends[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        for a, b in zip(offsets[:-1], offsets[1:]):
            yield ids[a:b]

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order; a null text has none."""
        texts = texts.cast(pa.large_string()).fill_null("")
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        size = pc.binary_length(texts).to_numpy()
        lo = 0
        while lo < len(texts):
            if special[lo]:
                yield self.whole(texts[lo].as_py())
                lo += 1
                continue
            hi, n = lo + 1, int(size[lo])
            while hi < len(texts) and not special[hi] and n + int(size[hi]) <= SPLIT_BYTES:
                n += int(size[hi])
                hi += 1
            yield from self._split_encoded(texts.slice(lo, hi - lo))
            lo = hi
        pa.default_memory_pool().release_unused()  # the worker stays, other stages need the memory


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    return Encoder(path)
