"""Token counts by a finite-state tokenizer.

The merges of a word-level BPE file are compiled into a deterministic
transducer over characters. Each transition carries how many tokens more (or
fewer) the text read so far has; the sum along a path is the token count. A
state is what the future can depend on: the lexer's state and, inside a word,
the live suffixes (those that may still become part of a vocabulary entry),
each with the token before it and its count relative to the current one.
States and transitions are compiled when a text first needs them.

A text is cut into chunks. A chunk's state map is what it does from *any*
state: white space resets the transducer, so the map is the characters before
the first reset (to be run from whatever state comes in), the count from
there on, and the state at the end. Maps compose associatively; a tree of
compositions gives the count of the whole text.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

#: Characters of a chunk. Only bounds the working set; counts don't depend on it.
CHUNK_CHARS = 1 << 16
#: States that one worker keeps; what is needed beyond them is compiled each
#: time. Bounds memory only, like the two numbers after it.
MAX_STATES = 40_000
#: Pieces between white space whose state map one worker keeps (then anew).
MAX_PIECES = 400_000
LONGEST_PIECE = 64

#: Fixed values of the pre-token pattern of the vocabulary file.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
SPACE, LETTER, NUMBER, OTHER = range(4)


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies:
    visible Latin-1 characters stand for themselves, the rest follow 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """The BPE model: which tokens are stable, which pairs may be neighbours.

    A token's merge tree tells when (at which rank) its pieces exist. Along
    the boundary of two tokens only the right spine of the first and the left
    spine of the second matter: the pair is stable if no two pieces that exist
    at the same time would merge before one of them grows."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        self.rank = {pair: i for i, pair in enumerate(pairs)}
        self.vocab = model["vocab"]
        cut = len(self.end)
        bodies = {t[:-cut] if t.endswith(self.end) and len(t) > cut else t for t in self.vocab}
        #: proper prefixes of tokens, and bodies that an end of word completes
        self.live = {b[:i] for b in bodies for i in range(1, len(b))} | {
            t[:-cut] for t in self.vocab if t.endswith(self.end) and len(t) > cut}
        self.trees: dict[str, tuple | None] = {}
        self.spines: dict[tuple[str, int], list] = {}

    def symbols(self, token: str) -> list[str]:
        if token.endswith(self.end) and len(token) > len(self.end):
            body = token[:-len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def tree(self, token: str):
        """(left, right, rank) of the last merge that makes ``token`` out of
        its own symbols, () for a symbol, None if the merges don't make it."""
        if token not in self.trees:
            parts, last = self.symbols(token), ()
            while len(parts) > 1:
                rank, i = min((self.rank.get(pair, 1 << 60), i) for i, pair in enumerate(zip(parts, parts[1:])))
                if rank == 1 << 60:
                    break
                last = (parts[i], parts[i + 1], rank)
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
            self.trees[token] = last if parts == [token] and token in self.vocab else None
        return self.trees[token]

    def spine(self, token: str, side: int) -> list[tuple[str, int]]:
        """Pieces along one side of the tree, small to large, each with the
        rank at which it is merged into the next."""
        if (token, side) not in self.spines:
            out, until, piece = [], 1 << 60, token
            while True:
                out.append((piece, until))
                node = self.tree(piece)
                if not node:
                    break
                piece, until = node[side], node[2]
            self.spines[token, side] = out[::-1]
        return self.spines[token, side]

    def follows(self, before: str | None, token: str) -> bool:
        """Is ``token`` stable after ``before`` (None: at a word's start)?"""
        if self.tree(token) is None:
            return False
        if before is None:
            return True
        left, right = self.spine(before, 1), self.spine(token, 0)
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            rank = self.rank.get((x, y))
            # of equal pairs the left one merges first
            if rank is not None and rank < x_until and rank <= y_until:
                return False
            if x_until <= y_until and i + 1 < len(left):
                i += 1
            elif j + 1 < len(right):
                j += 1
            elif i + 1 < len(left):
                i += 1
            else:
                return True


class State(dict):
    """Character -> (tokens more, next state); filled when first needed."""

    __slots__ = ("machine", "lexer", "tail")

    def __init__(self, machine, lexer, tail):
        super().__init__()
        self.machine, self.lexer, self.tail = machine, lexer, tail

    def __missing__(self, char):
        step = self.machine.compile(self, char)
        if self.machine.room():
            self[char] = step
        return step


class Pieces(dict):
    """Piece without white space -> its token count from the start state."""

    __slots__ = ("machine",)

    def __missing__(self, piece):
        machine = self.machine
        if len(piece) > 1 and piece[-1] != "'" and machine.kind(piece[-1]) == OTHER and machine.kind(piece[-2]) == LETTER:
            return self[piece[:-1]] + self[piece[-1]]  # the word closes before the sign
        count, state = machine.run(machine.start, piece)
        count += machine.finish(state)
        if len(piece) <= LONGEST_PIECE:
            if len(self) >= MAX_PIECES:
                self.clear()
            self[piece] = count
        return count


class Machine:
    """The transducer. ``lexer`` is None (between words), LETTER or OTHER (in
    a run of such characters), or the start of a possible contraction."""

    #: the tail at a word's start: one live suffix, empty, no token before it
    FRESH = (("", None, 0),)

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.merges = Merges(spec)
        self.library = Tokenizer.from_file(path)
        self.bytes = byte_symbols()
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_pattern = re.compile("|".join(map(re.escape, longest_first))) if longest_first else None
        self.classes: dict[str, int] = {}
        self.states: dict[tuple, State] = {}
        self.start = self.state(None, ())
        self.pieces = Pieces()
        self.pieces.machine = self

    # -- text ---------------------------------------------------------------

    def normalise(self, text: str) -> str:
        """As the file's normaliser does (white space is left as it is: it
        only separates)."""
        if text.isascii():
            return text.lower()
        if not unicodedata.is_normalized("NFC", text):
            return self.library.normalizer.normalize_str(text)
        return text.replace("Σ", "σ").lower()

    def kind(self, char: str) -> int:
        """The class of a character, asked of the library's own pre-tokenizer."""
        if char not in self.classes:
            if len(self.classes) > 200_000:
                self.classes.clear()
            pieces = len(self.library.pre_tokenizer.pre_tokenize_str(f"a{char}{char}a"))
            self.classes[char] = {1: LETTER, 2: SPACE, 3: OTHER, 4: NUMBER}[pieces]
        return self.classes[char]

    # -- states -------------------------------------------------------------

    def state(self, lexer, tail) -> State:
        key = lexer, tail
        found = self.states.get(key)
        if found is None:
            found = State(self, lexer, tail)
            if self.room():
                self.states[key] = found
        return found

    def room(self) -> bool:
        return len(self.states) < MAX_STATES

    def extend(self, tail, char: str):
        """The tail after the bytes of one more character of a word, and the
        change of the count."""
        change = 0
        for symbol in (self.bytes[b] for b in char.encode("utf-8", "replace")):
            token = more = None
            longer = [(suffix + symbol, before, count) for suffix, before, count in tail]
            for body, before, count in longer:
                if self.merges.follows(before, body):
                    token, more = body, count + 1
                    break
            tail = (*((body, before, count - more) for body, before, count in longer if body in self.merges.live),
                    ("", token, 0))
            change += more
        return change, tail

    def close(self, tail) -> int:
        """The change of the count when the word ends here."""
        if not tail:
            return 0
        for body, before, count in tail:
            if body and self.merges.follows(before, body + self.merges.end):
                return count + 1
        raise ValueError("no token ends this word")

    def word(self, text: str) -> int:
        tail, total = self.FRESH, 0
        for char in text:
            change, tail = self.extend(tail, char)
            total += change
        return total + self.close(tail)

    def compile(self, state: State, char: str):
        kind, lexer, tail = self.kind(char), state.lexer, state.tail
        if isinstance(lexer, str):  # an open contraction, e.g. "'" or "'r"
            if lexer + char in CONTRACTIONS:
                return self.word(lexer + char), self.start
            if any(c.startswith(lexer + char) for c in CONTRACTIONS):
                return 0, self.state(lexer + char, ())
            # no contraction: the quote is a run of its own kind, the rest a word
            change, tail = self.extend(self.FRESH, "'")
            after = self.state(OTHER, tail)
            for c in lexer[1:] + char:
                more, after = after[c]
                change += more
            return change, after
        if kind == SPACE:
            return self.close(tail), self.start
        if kind == NUMBER:
            return self.close(tail) + self.word(char), self.start
        if lexer == kind:
            change, tail = self.extend(tail, char)
            return change, self.state(kind, tail)
        closed = self.close(tail)
        if char == "'":
            return closed, self.state("'", ())
        change, tail = self.extend(self.FRESH, char)
        return closed + change, self.state(kind, tail)

    def finish(self, state: State) -> int:
        """Tokens that the end of the text adds (as white space would)."""
        return state[" "][0]

    # -- runs ---------------------------------------------------------------

    def run(self, state: State, text: str):
        total = 0
        for char in text:
            change, state = state[char]
            total += change
        return total, state

    def chunk_map(self, chunk: str):
        """(characters before the first reset, count after it, state at the
        end); the state is None if the chunk holds no reset."""
        first, last = chunk.find(" "), chunk.rfind(" ")
        if first < 0:
            return chunk, 0, None
        middle = sum(map(self.pieces.__getitem__, chunk[first + 1:last].split(" "))) if last > first else 0
        tail, state = self.run(self.start, chunk[last + 1:])
        return chunk[:first], middle + tail, state

    def compose(self, a, b):
        """First ``a``, then ``b``; associative."""
        if a[2] is None:
            return a[0] + b[0], b[1], b[2]
        more, state = self.run(a[2], b[0])
        if b[2] is None:
            return a[0], a[1] + more, state
        return a[0], a[1] + more + self.finish(state) + b[1], b[2]

    def segment(self, text: str, chunk: int) -> int:
        """Token count of a normalised text: chunk maps, composed by a tree."""
        for space in "\n\t\r":  # all of them reset, as the blank does
            text = text.replace(space, " ")
        maps = [self.chunk_map(text[i:i + chunk]) for i in range(0, len(text), chunk)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        if not maps:
            return 0
        head, count, end = maps[0]
        total, state = self.run(self.start, head)
        total += self.finish(state)
        return total if end is None else total + count + self.finish(end)

    def count(self, text: str | None, chunk: int = CHUNK_CHARS) -> int:
        if not text:
            return 0
        if self.special_pattern is None or not self.special_pattern.search(text):
            return self.segment(self.normalise(text), chunk)
        parts = self.special_pattern.split(text)
        return len(parts) - 1 + sum(self.segment(self.normalise(p), chunk) for p in parts)


@lru_cache(maxsize=2)
def machine(path: str) -> Machine:
    """One transducer per worker process and file."""
    return Machine(path)


def n_tokens(text: Column, path: str, chunk: int = CHUNK_CHARS) -> Column:
    """Tokens of a text as the tokenizer file ``path`` gives them."""
    @F.pandas_udf("long")
    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = machine(path)
        for part in texts:
            yield pd.Series([counter.count(t, chunk) for t in part], dtype="int64")
    return counted(text)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens,
    over_limit (n_tokens > ``limit``). A null text is empty: 0 bytes, 0
    tokens. Nothing is shuffled; repeated rows stay; a null doc_id stays
    null; other columns are ignored."""
    ship_package(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    return (docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(text, path).alias("n_tokens"))
            .withColumn("over_limit", F.col("n_tokens") > limit))
