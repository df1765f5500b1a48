"""Token-ID files: one zstandard frame per document, a trailing seek table.

A shard file follows the public Zstandard Seekable Format: independent frames
(here one per document: its ids as little-endian unsigned 32-bit integers),
then a skippable frame with the document ids, then the seek table (a skippable
frame with each frame's compressed size, plain size and XXH64 checksum). A
reader takes the table from the file's end and decompresses only the frames
it wants.

The files go through Spark's own writer (one row of the text sink is one
file; its "line separator" is the four closing magic bytes of the seek table),
so they land on any file system Spark can write, by its commit protocol: a
lost executor or a second attempt leaves no half file.

Defined results: a null text is empty (only the end id); an empty table gives
no shard; rows that repeat a doc_id are separate documents, in the order of
their texts' hashes; a null doc_id comes first and reads back as null; other
columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from .encoding import encoder

# Fixed values of the Zstandard Seekable Format.
SEEK_TABLE_MAGIC = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

#: A skippable frame of ours with the index of documents.
INDEX_MAGIC = 0x184D2A5D
#: Compressed bytes at which a shard is closed; one document may exceed it.
SHARD_BYTES = 8 << 20
SEPARATOR = struct.pack("<I", FOOTER_MAGIC).decode("latin-1")


# -- one file ---------------------------------------------------------------

def build_shard(docs: Iterable[tuple[int | None, bytes]], task: int, part: int, level: int = 3) -> bytes:
    """A whole file from (doc_id, plain bytes)."""
    import xxhash
    import zstandard

    packer = zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=False)
    frames, entries, ids = [], [], []
    for doc_id, plain in docs:
        frames.append(packer.compress(plain))
        entries.append((len(frames[-1]), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        ids.append(doc_id)
    index = struct.pack("<IIQ", task, part, len(ids)) + np.array([i or 0 for i in ids], "<i8").tobytes() + bytes(i is None for i in ids)
    frames.append(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
    entries.append((len(frames[-1]), 0, 0))
    table = b"".join(struct.pack("<III", *e) for e in entries)
    frames.append(struct.pack("<II", SEEK_TABLE_MAGIC, len(table) + 9) + table
                  + struct.pack("<IB", len(entries), CHECKSUM_FLAG) + struct.pack("<I", FOOTER_MAGIC))
    return b"".join(frames)


@dataclass
class Shard:
    """The directory of a file; no frame is decompressed to get it."""

    data: bytes
    task: int
    part: int
    ids: list[int | None]
    starts: np.ndarray
    sizes: np.ndarray  # compressed, plain, checksum per frame

    @classmethod
    def open(cls, data: bytes) -> Shard | None:
        if len(data) < 17:
            return None  # a task without rows leaves an empty file
        n, flags, magic = struct.unpack("<IBI", data[-9:])
        if magic != FOOTER_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError("no seek table at the end of the file")
        sizes = np.frombuffer(data, "<u4", n * 3, len(data) - 9 - n * 12).reshape(n, 3).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes[:, 0])])
        at = int(starts[n - 1])
        task, part, count = struct.unpack("<IIQ", data[at + 8:at + 24])
        ids = np.frombuffer(data, "<i8", count, at + 24).tolist()
        null = data[at + 24 + 8 * count:at + 24 + 9 * count]
        return cls(data, task, part, [None if m else i for i, m in zip(ids, null)], starts, sizes[:-1])

    def read(self, k: int) -> np.ndarray:
        """The ids of the k-th document; its checksum is checked."""
        import xxhash
        import zstandard

        lo, hi = int(self.starts[k]), int(self.starts[k + 1])
        plain = zstandard.ZstdDecompressor().decompress(self.data[lo:hi], max_output_size=max(1, int(self.sizes[k, 1])))
        if len(plain) != self.sizes[k, 1] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.sizes[k, 2]:
            raise ValueError(f"damaged frame {k}")
        return np.frombuffer(plain, "<u4")


# -- writing ----------------------------------------------------------------

def _shards(path: str, end_id: int, shard_bytes: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, part, size, docs = TaskContext.get().partitionId(), 0, 0, []
        end = struct.pack("<I", end_id)

        def file():
            whole = build_shard(docs, task, part)  # the sink writes the last four bytes as its separator
            return pa.record_batch({"value": pa.array([whole[:-len(SEPARATOR)]], pa.binary())})

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder(path).encode(batch.column("text"))):
                plain = ids.astype("<u4", copy=False).tobytes() + end
                docs.append((doc_id, plain))
                size += len(plain) // 3  # about what it takes compressed
                if size >= shard_bytes:
                    yield file()
                    part, size, docs = part + 1, 0, []
        if docs:
            yield file()
    return build


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, shard_bytes: int = SHARD_BYTES) -> None:
    """Encode every document and write the shards, doc_ids ascending over the
    files in the order of (task, part). The range split is by (doc_id, hash of
    the text), so one repeated doc_id can't fill a task."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    (rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
     .select("doc_id", "text")
     .mapInArrow(_shards(tokenizer, end_id, shard_bytes), "value binary")
     .select(F.col("value").cast("string").alias("value"))
     .write.option("maxRecordsPerFile", 1).option("lineSep", SEPARATOR).option("encoding", "ISO-8859-1")
     .text(folder))


# -- reading ----------------------------------------------------------------

def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")


def _first(shards: DataFrame) -> DataFrame:
    """Adds the ids in all shards before each (one row per shard)."""
    return shards.withColumn("first", F.expr("coalesce(sum(n_ids) OVER (ORDER BY task, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"))


def read_directory(spark: SparkSession, folder: str) -> DataFrame:
    """One row per shard, from the seek tables alone: task, part, n_docs,
    n_ids, and ``first``: ids in all shards before it."""
    def summarise(batches):
        for batch in batches:
            for data in batch.column(0):
                if (s := Shard.open(data.as_py())) is not None:
                    yield pa.record_batch({"task": pa.array([s.task], pa.int32()), "part": pa.array([s.part], pa.int32()),
                                           "n_docs": pa.array([len(s.ids)], pa.int64()), "n_ids": pa.array([int(s.sizes[:, 1].sum()) // 4], pa.int64())})

    shards = _files(spark, folder).mapInArrow(summarise, "task int, part int, n_docs long, n_ids long")
    return _first(shards)


def read_documents(spark: SparkSession, folder: str, wanted: list[int] | None = None) -> DataFrame:
    """One row per document (or only the ``wanted`` doc_ids, whose frames
    alone are decompressed): doc_id, task, part, local_start, ids binary."""
    chosen = None if wanted is None else set(wanted)

    def read(batches):
        for batch in batches:
            for data in batch.column(0):
                if (s := Shard.open(data.as_py())) is None:
                    continue
                starts = np.concatenate([[0], np.cumsum(s.sizes[:, 1] // 4)])
                ks = [k for k, i in enumerate(s.ids) if chosen is None or i in chosen]
                for lo in range(0, len(ks), 512):
                    some = ks[lo:lo + 512]
                    yield pa.record_batch({
                        "doc_id": pa.array([s.ids[k] for k in some], pa.int64()),
                        "task": pa.array([s.task] * len(some), pa.int32()), "part": pa.array([s.part] * len(some), pa.int32()),
                        "local_start": pa.array([int(starts[k]) for k in some], pa.int64()),
                        "ids": pa.array([s.read(k).tobytes() for k in some], pa.binary())})

    return _files(spark, folder).mapInArrow(read, "doc_id long, task int, part int, local_start long, ids binary")


def digest(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files,
    which are read once."""
    docs = materialise(read_documents(spark, folder).select(
        "doc_id", "task", "part", "local_start",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")), "read-back")
    first = _first(docs.groupBy("task", "part").agg(F.sum("n_tokens").alias("n_ids"))).select("task", "part", "first")
    return docs.join(first, ["task", "part"]).select(
        "doc_id", (F.col("first") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
