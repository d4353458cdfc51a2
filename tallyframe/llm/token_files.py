"""Token ids in binary files: every id in the fewest bits that hold the vocabulary.

A file is a magic, blocks of ``BLOCK`` packed ids (most significant bit first, a block
starts on a byte), and a footer: offsets of the blocks, ids and lengths of the
documents, and a fixed trailer. Any range of ids is read from the blocks that hold it.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.llm.chunks import library_encoder, vocabulary_path
from tallyframe.llm.common import bounded_arrow, fresh_path, written

MAGIC = b"TFTOKEN1"
BLOCK = 4096
#: bits, ids, documents, blocks, offset of the footer.
_TRAILER = struct.Struct("<QQQQQ8s")


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI that every executor reaches, and the path in it. A path
    without a scheme, or with ``file``, is on a disk that all machines mount."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    flat = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - bits :]
    return np.packbits(flat).tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, 32 - bits :] = flat
    return np.packbits(wide, axis=1).view(">u4").ravel().astype(np.uint32)


class TokenWriter:
    """Appends documents; holds at most one block of ids and the footer's columns."""

    def __init__(self, path: str, vocabulary: int):
        store, at = filesystem(path)
        store.create_dir(at.rsplit("/", 1)[0], recursive=True)
        self.out = store.open_output_stream(at)
        self.bits, self.offset, self.n = bits_for(vocabulary), len(MAGIC), 0
        self.offsets: list[int] = []
        self.names, self.known, self.lengths = [], [], []
        self.pending = np.empty(0, np.uint32)
        self.out.write(MAGIC)

    def add(self, name: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError("an id exceeds the vocabulary")
        self.names.append(name or 0)
        self.known.append(name is not None)
        self.lengths.append(len(ids))
        self.n += len(ids)
        self.pending = np.concatenate([self.pending, ids])
        whole = len(self.pending) // BLOCK * BLOCK
        if whole:
            self._blocks(self.pending[:whole])
            self.pending = self.pending[whole:]

    def _blocks(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)  # BLOCK is a multiple of 8, so each whole block ends on a byte
        size = BLOCK * self.bits // 8
        self.offsets += range(self.offset, self.offset + len(data), size)
        self.out.write(data)
        self.offset += len(data)

    def close(self) -> None:
        if len(self.pending):
            self._blocks(self.pending)
        for column, kind in ((self.offsets, "<u8"), (self.names, "<i8"), (self.known, "u1"), (self.lengths, "<u8")):
            self.out.write(np.array(column, kind).tobytes())
        self.out.write(_TRAILER.pack(self.bits, self.n, len(self.names), len(self.offsets), self.offset, MAGIC))
        self.out.close()


class TokenReader:
    def __init__(self, path: str):
        store, at = filesystem(path)
        self.file = store.open_input_file(at)
        size = self.file.size()
        self.bits, self.n, docs, blocks, footer, magic = _TRAILER.unpack(self.file.read_at(_TRAILER.size, size - _TRAILER.size))
        if magic != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{path} is no token file")
        data = self.file.read_at(size - footer - _TRAILER.size, footer)
        self.ends = np.append(np.frombuffer(data, "<u8", blocks), footer).astype(np.int64)
        self.names = np.frombuffer(data, "<i8", docs, 8 * blocks)
        self.known = np.frombuffer(data, "u1", docs, 8 * (blocks + docs))
        self.lengths = np.frombuffer(data, "<u8", docs, 8 * blocks + 9 * docs).astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the file, from the blocks that hold them."""
        if stop <= start:
            return np.empty(0, np.uint32)
        first, last = start // BLOCK, (stop - 1) // BLOCK
        data = self.file.read_at(int(self.ends[last + 1] - self.ends[first]), int(self.ends[first]))
        n = min((last + 1) * BLOCK, self.n) - first * BLOCK
        return unpack(data, self.bits, n)[start - first * BLOCK : stop - first * BLOCK]

    def documents(self, at_once: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, first place, ids) of each document; reads about ``at_once`` ids at a time."""
        ends = np.cumsum(self.lengths)
        k = 0
        while k < len(ends):
            begin = int(ends[k] - self.lengths[k])
            stop = max(k + 1, int(np.searchsorted(ends, begin + at_once, "right")))
            some = self.ids(begin, int(ends[stop - 1]))
            for j in range(k, stop):
                at = int(ends[j] - self.lengths[j])
                yield (int(self.names[j]) if self.known[j] else None), at, some[at - begin : int(ends[j]) - begin]
            k = stop


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, path: str, files: int | None = None) -> DataFrame:
    """Writes the ids of all texts, each followed by ``end_id``, in ascending doc_id order
    (null ids first, equal ids by text) and returns the manifest (file, path, n_docs,
    n_tokens, start).

    A text that is null counts as empty, one of any length is encoded whole, an empty table
    gives no file. A task writes a file of its own name and the
    manifest lists the files of the tasks that ended well, so a lost executor leaves no
    wrong file behind. Columns besides doc_id and text are not written.
    """
    spark = docs.sparkSession
    bounded_arrow(spark)
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        encoder, out = library_encoder(tokenizer), None
        part = TaskContext.get().partitionId()
        at = f"{path}/part-{part:06d}-{uuid.uuid4().hex}.tok"
        for batch in batches:
            out = out or TokenWriter(at, Tokenizer.from_file(tokenizer).get_vocab_size())
            texts = (t.as_py() for t in batch.column(1))
            for name, ids in zip(batch.column(0).to_pylist(), encoder.encode_many(texts), strict=True):
                out.add(name, np.append(ids, np.uint32(end_id)))
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [part], "path": [at], "n_docs": [len(out.names)], "n_tokens": [out.n]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    in_order = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = written(in_order.mapInArrow(write, "file long, path string, n_docs long, n_tokens long"), "manifest")
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows = []
                for name, at, ids in TokenReader(row["path"]).documents():
                    rows.append((name, row["start"] + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == 10_000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    def _batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "start").repartition(n, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(docs: DataFrame) -> DataFrame:
    manifest = write_tokens(docs, vocabulary_path("word_bpe_49k.json"), 2, fresh_path(docs.sparkSession, "tokens"))
    return read_tokens(manifest)
