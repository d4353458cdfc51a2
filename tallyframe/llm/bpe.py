"""Byte-level BPE by a table of ranks, with a segment tree over byte positions.

A leaf holds the rank of the pair that starts at its part and the leaf's place, so the
root is the leftmost pair of least rank. A merge changes three leaves at most, each by a
walk to the root; a piece of n bytes takes O(n log n) however long it is.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.chunks import ChunkEncoder, vocabulary_path
from tallyframe.llm.common import bounded_arrow

#: Distinct chunks whose ids a worker keeps: more than elsewhere, as they are merged in Python here.
CACHED_CHUNKS = 900_000


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece; every single byte must have a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    width = 1 << (n - 1).bit_length()
    none = 1 << 62
    tree = [none] * (2 * width)
    after = list(range(1, n + 1))  # where a part ends
    before = list(range(-1, n - 1))
    rank_of = ranks.get
    for i in range(n - 1):
        r = rank_of(piece[i : i + 2])
        if r is not None:
            tree[width + i] = r * width + i
    for i in range(width - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    def put(i: int, value: int) -> None:
        k = width + i
        if tree[k] == value:
            return
        tree[k] = value
        while k > 1:
            k >>= 1
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a < b else b
            if tree[k] == low:
                return
            tree[k] = low

    while (best := tree[1]) < none:
        i = best % width
        j = after[i]  # the part that goes into part i
        end = after[j]
        put(j, none)
        after[i] = end
        if end < n:
            before[end] = i
            r = rank_of(piece[i : after[end]])
            put(i, none if r is None else r * width + i)
        else:
            put(i, none)
        h = before[i]
        if h >= 0:
            r = rank_of(piece[h:end])
            put(h, none if r is None else r * width + h)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Codec:
    """Encodes whole texts by ``ranks``, each match of ``pattern`` on its own, and decodes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.vocabulary = {r: b for b, r in ranks.items()}
        self.chunks = ChunkEncoder(lambda texts: [self._pieces(t) for t in texts], cached=CACHED_CHUNKS)

    def _pieces(self, text: str) -> list[int]:
        if text[:1] == " " and text[1:].isalpha() or text.isalpha():  # letters are one match
            return merge_piece(text.encode(), self.ranks)
        return [x for m in self.pattern.findall(text) for x in merge_piece(m.encode("utf-8", "surrogatepass"), self.ranks)]

    def encode(self, text: str | None) -> np.ndarray:
        return self.chunks.encode(text)

    def encode_many(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        return self.chunks.encode_many(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids.tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for a file of base64 tokens and ranks."""
    if (path, pattern) not in _codecs:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        _codecs[path, pattern] = Codec(ranks, pattern)
    return _codecs[path, pattern]


def encoded(docs: DataFrame, path: str, pattern: str, keep: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), with ``keep`` also ids (binary,
    little-endian unsigned 32-bit) and decoded (binary), for every whole text.

    A null text counts as empty, one of any length is encoded whole. Null ids and repeated
    rows give a row each, an empty table an empty one; other columns are not carried.
    """
    bounded_arrow(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded binary" * keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            rows = []
            for ids in c.encode_many(t.as_py() for t in batch.column(1)):
                ids = ids.astype("<u4")
                flat, back = ids.tobytes(), c.decode(ids)
                rows.append((len(ids), hashlib.sha256(flat).hexdigest(), hashlib.sha256(back).hexdigest(), *((flat, back) if keep else ())))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary()]
            columns = list(zip(*rows, strict=True)) or [()] * (5 if keep else 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=False))], [f.split()[0] for f in schema.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return encoded(docs, vocabulary_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
