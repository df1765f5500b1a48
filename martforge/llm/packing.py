"""Packing of tokenised documents into sequences of a fixed size.

Bounded-space online packing: each task reads its documents in order and
keeps a fixed number of open windows. A document's whole windows leave at
once; what remains of it goes into the open window where it fits best (the
least room that holds it), else into a new window; where no more may be
opened and none fits, the fullest window is topped up with the remainder's
head and leaves, and the rest is placed again. The windows that a task still
holds at its end are joined into full ones and one last stretch shorter than
a window; the last stretches of neighbouring tasks are merged alike.

A sequence that is neither full nor a power of two long would need padding.
Only the very end of a merge group could be such a one; it is cut into
stretches whose lengths are powers of two, so nothing is padded.

Memory: a task holds ``windows`` windows and one document; a merge group holds
``MERGE`` stretches, each shorter than a window. No step depends on the order
of rows: a task that runs again packs its rows anew, and its output replaces
the former one as a whole (Spark's commit protocol).

Defined results: a null or empty text is its end id alone; rows that repeat a
doc_id are separate documents; a null doc_id stays null; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .encoding import encoder

#: Tokens of a full sequence.
SIZE = 2048
#: Open windows of a task.
WINDOWS = 64
#: Tasks whose last stretches are merged together.
MERGE = 64
#: Pieces sent to Spark at once.
BATCH = 4096

#: (doc_id, first token in its document, ids, tokens of the document)
Piece = tuple[int | None, int, np.ndarray, int]


class Windows:
    """The open windows of one task."""

    def __init__(self, size: int = SIZE, windows: int = WINDOWS):
        self.size, self.windows = size, windows
        self.room: list[tuple[int, int]] = []  # (room left, window), ascending
        self.pieces: dict[int, list[Piece]] = {}
        self.opened = 0

    def _put(self, at: int, piece: Piece) -> list[Piece] | None:
        """Append to the window at a place of ``room``; the window if it is full now."""
        room, window = self.room.pop(at)
        self.pieces[window].append(piece)
        if room == len(piece[2]):
            return self.pieces.pop(window)
        insort(self.room, (room - len(piece[2]), window))
        return None

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[list[Piece]]:
        """Place a document; yields the windows that leave."""
        n, start = len(ids), 0
        while n - start >= self.size:
            yield [(doc_id, start, ids[start:start + self.size], n)]
            start += self.size
        while start < n:
            best = bisect_left(self.room, (n - start, -1))
            take = n - start
            if best == len(self.room):
                if len(self.room) < self.windows:
                    insort(self.room, (self.size, self.opened))
                    self.pieces[self.opened] = []
                    self.opened += 1
                    best = len(self.room) - 1
                else:
                    best, take = 0, self.room[0][0]
            if (full := self._put(best, (doc_id, start, ids[start:start + take], n))) is not None:
                yield full
            start += take

    def rest(self) -> Iterator[Piece]:
        """The pieces of the windows still open, the fullest window first."""
        for _, window in self.room:
            yield from self.pieces[window]


def joined(pieces: Iterable[Piece], size: int = SIZE) -> Iterator[list[Piece]]:
    """The pieces one after another, cut into full windows and a shorter end."""
    window, room = [], size
    for doc_id, start, ids, n in pieces:
        while len(ids):
            head = ids[:room]
            window.append((doc_id, start, head, n))
            start, ids, room = start + len(head), ids[room:], room - len(head)
            if not room:
                yield window
                window, room = [], size
    if window:
        yield window


def power_parts(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """A window cut into stretches whose lengths are powers of two."""
    left = sum(len(p[2]) for p in pieces)
    while left:
        part = 1 << (left.bit_length() - 1)
        first, *rest = joined(pieces, part)
        yield first
        pieces, left = [p for window in rest for p in window], left - part


COLUMNS = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long"


class _Rows:
    """Collects sequences as Arrow batches; ``open`` marks a task's last stretch."""

    def __init__(self, first_id: int):
        self.next, self.rows = first_id, []

    def sequence(self, pieces: list[Piece], is_open: bool = False) -> None:
        offset = 0
        for doc_id, start, ids, n in pieces:
            self.rows.append((doc_id, start, ids.astype("<u4", copy=False).tobytes(), n, self.next, offset, is_open))
            offset += len(ids)
        self.next += 1

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * 7
        self.rows = []
        types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        names = ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset", "open"]
        return pa.record_batch({name: pa.array(c, t) for name, c, t in zip(names, columns, types)})


def _pack_task(path: str, end_id: int, size: int, windows: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, out = Windows(size, windows), _Rows(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder(path).encode(batch.column("text"))):
                for window in held.add(doc_id, np.append(ids, np.uint32(end_id))):
                    out.sequence(window)
                    if len(out.rows) >= BATCH:
                        yield out.take()
        for window in joined(held.rest(), size):
            out.sequence(window, is_open=sum(len(p[2]) for p in window) < size)
        yield out.take()
    return pack


def _merge_group(size: int):
    def merge(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist()
        pieces = ((r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"]) for r in rows)
        out = _Rows(1 << 62 | key[0].as_py() << 32)
        for window in joined(pieces, size):
            for part in power_parts(window):
                out.sequence(part)
        return pa.Table.from_batches([out.take()]).drop_columns(["open"])
    return merge


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = SIZE, windows: int = WINDOWS) -> DataFrame:
    """One row per piece: doc_id, ``start`` in its document, ``ids`` (little-
    endian unsigned 32-bit), ``doc_tokens`` with the end id, ``sequence_id``
    and ``offset`` in that sequence."""
    if size & (size - 1):
        raise ValueError("the size of a sequence must be a power of two")
    packed = materialise(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .mapInArrow(_pack_task(tokenizer, end_id, size, windows), COLUMNS + ", open boolean"), "packed")
    task = F.shiftright("sequence_id", 32)
    merged = (packed.where("open").withColumn("group", task - task % MERGE).groupBy("group")
              .applyInArrow(_merge_group(size), COLUMNS))
    return packed.where("NOT open").drop("open").unionByName(merged)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with their length and checksum in place of their ids."""
    return pieces.select("doc_id", "start", F.expr("octet_length(ids) div 4").cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")
