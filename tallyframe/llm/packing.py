"""Best-fit packing planned on the histogram of lengths.

The plan looks at counts of lengths only: runs of equal pieces take runs of sequences
at one offset. Pieces are then ranked within their length and take the planned slots by
a join on (length, rank). The plan's size depends on the sequence length, not the data.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.chunks import library_encoder, vocabulary_path
from tallyframe.llm.common import bounded_arrow, ranked, shuffled, written

#: About how many pieces of one length a task numbers.
BUCKET = 50_000


def plan(histogram: dict[int, int], room: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first, over counts: (length, first rank, how many, first
    sequence, offset), a run of pieces each.

    Sequences with the same room left stand in runs; a length fills the run of the least
    room that fits, sequence by sequence, splits the last run, and opens new sequences for
    the rest: what best fit does piece by piece.
    """
    out, runs, mask, opened = [], {}, 0, 0

    def put(left: int, first: int, n: int) -> None:
        nonlocal mask
        if left and n:
            runs.setdefault(left, []).append((first, n))
            mask |= 1 << left

    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        if not 0 < length <= room:
            raise ValueError(f"a piece of {length} does not fit {room}")
        rank, todo = 0, histogram[length]
        while todo:
            if fits := mask >> length:
                left = length + (fits & -fits).bit_length() - 1
                first, n = runs[left].pop()
                if not runs[left]:
                    del runs[left]
                    mask &= ~(1 << left)
            else:
                left, first, n = room, opened, todo  # new sequences, as many as it takes
            # One sequence is filled as far as the length goes before the next is begun.
            each = left // length
            whole, over = divmod(min(todo, n * each), each)
            for k in range(each):
                many = whole + (k < over)
                if many:
                    out.append((length, rank, many, first, room - left + k * length))
                    rank, todo = rank + many, todo - many
            used = whole + (over > 0)
            put(left - each * length, first, whole)
            put(left - over * length, first + whole, used - whole)
            if fits:
                put(left, first + used, n - used)
            else:
                opened += used
    return out


def packed(pieces: DataFrame, room: int, order: list[str], length: str = "length") -> DataFrame:
    """``pieces`` with sequence_id and offset (longs). ``order`` names columns that tell
    pieces apart; wholly equal rows are interchangeable. Lengths run from 1 to ``room``. Columns
    named sequence_id, offset or pk_* are replaced; an empty table gives an empty one."""
    spark = pieces.sparkSession
    own = {"sequence_id", "offset", "pk_length", "pk_rank", "pk_n", "pk_first", "pk_offset", "pk_from", "pk_k", "pk_place", "pk_own"}
    pieces = pieces.drop(*(c for c in pieces.columns if c.lower() in own))
    counts = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}  # at most `room` rows
    runs = plan(counts, room)
    names = "pk_length pk_rank pk_n pk_first pk_offset".split()
    planned = pa.Table.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*runs, strict=True)) or [()] * 5], names)
    step = 1 << 16
    at = F.explode(F.expr(f"sequence(0, pk_n - 1, {step})"))
    table = spark.createDataFrame(planned).select("*", at.alias("pk_from")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    slots = table.select("*", F.explode(F.expr(f"sequence(pk_from, least(pk_from + {step - 1}, pk_n - 1))")).alias("pk_k"))
    slots = slots.select("pk_length", (F.col("pk_rank") + F.col("pk_k")).alias("pk_place"), (F.col("pk_first") + F.col("pk_k")).alias("sequence_id"), F.col("pk_offset").alias("offset"))
    spread = F.xxhash64(*order)
    buckets = max(64, -(-max(counts.values(), default=0) // BUCKET))
    numbered = ranked(pieces, [length], [spread, *(F.col(c) for c in order)], F.shiftright(spread, 24), buckets, "pk_own")
    return numbered.join(shuffled(slots), (F.col(length) == F.col("pk_length")) & (F.col("pk_own") == F.col("pk_place"))).drop("pk_own", "pk_length", "pk_place")


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, room: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every text's ids and ``end_id`` (null:
    ``end_id`` alone), cut only where longer than ``room``; then the first piece takes
    what the full ones leave."""
    bounded_arrow(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer)
        for batch in batches:
            rows = []
            texts = (t.as_py() for t in batch.column(1))
            for name, ids in zip(batch.column(0).to_pylist(), encoder.encode_many(texts), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                start, end = 0, (len(ids) - 1) % room + 1
                k = 0
                while start < len(ids):
                    rows.append((name, k, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                    k, start, end = k + 1, end, end + room
            if rows:
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), *(pa.array(x, pa.int64()) for x in c[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, room: int = 2048) -> DataFrame:
    """Every piece of ``docs`` in its place: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset. Null ids, equal ids and repeated rows are packed like any other,
    texts of any length are cut into as many pieces as they need; an empty table gives an empty one; columns besides doc_id and text are not carried."""
    pieces = written(pieces_of(docs, tokenizer or vocabulary_path("byte_bpe_50k.json"), end_id, room), "pieces")
    return packed(pieces, room, ["doc_id", "piece", "ids_crc32"])


def query(docs: DataFrame) -> DataFrame:
    return best_fit(docs)
