"""Exact removal of repeated strings of bytes, by merging shard Burrows-Wheeler transforms.

A byte goes if a string of ``length`` bytes that covers it also starts earlier in the
corpus. Only places where that can happen are brought together: strings are grouped by a
content-chosen anchor (``anchors``), whole segments that repeat are found by one join, and
what is left, distinct segments that share an anchor, is compared through the transforms.

In a task the segments are split into shards, each shard gets its suffix order and its
transform, and the transforms are merged by refining their interleave: one step sorts all
suffixes by a few bytes more, stably by the bytes before each suffix in the order so far.
A step splits the intervals of equal prefixes, and so gives common prefixes and repeated
intervals; suffixes whose interval holds them alone leave the merge. No suffix is
compared with another and the union is never sorted again.

The segments of an anchor are dealt to shares of bounded size, and a share goes through
one task. What is first in its share meets the other shares' firsts by a digest.

Collisions: whole texts are told by MD5. Segments of one anchor, whose anchor bytes are equal
anyhow, are told by 64 bits of content: with k distinct segments on an anchor two are taken
for one with a probability of about k^2 / 2^65, summed over the anchors (under 1e-7 for a
million anchors of a thousand segments each). Strings of several shares are told by two
hashes of 64 bits of unlike constructions.

What a text repeats of its own is put together before the shuffle, a mebibyte at a time: a
text of one short period has a segment for each byte, all with one anchor and content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.anchors import joined_segments, pieces, string_hashes
from tallyframe.llm.common import bounded_arrow, free_name, partitions, shuffled, text_or_empty, written
from tallyframe.llm.shingles import mix

#: A byte that UTF-8 never has ends each segment.
END = 0xFF
#: Bytes of a shard, and of the shards merged at a time.
SHARD, MERGED = 1 << 15, 1 << 18
#: Distinct segments of an anchor in a share. An anchor has as many shares as it needs.
SHARE = 2048
#: Bytes of short texts whose anchors are found in one pass.
JOINED = 1 << 16
#: Text digests that a worker remembers, to send the segments of equal texts once.
REMEMBERED = 1 << 18


def grams(shard: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of a shard on, read in a circle, as one number."""
    v = np.resize(shard, len(shard) + 7).astype(np.uint64)
    for k in (1, 2, 4):
        v = v[: len(v) - k] << np.uint64(8 * k) | v[k:]
    return v


def suffix_order(gram: np.ndarray, depth: int) -> np.ndarray:
    """The rotations of a shard, given its ``grams``, in the order of their first ``depth``
    bytes (or more), by doubling."""
    rank, have, n = np.unique(gram, return_inverse=True)[1], 8, len(gram)
    while True:
        order = np.argsort(rank)
        in_order = rank[order]
        fresh = np.append(0, (in_order[1:] != in_order[:-1]).astype(np.int64)).cumsum()
        if have >= depth or fresh[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        rank, have = rank * n + np.roll(rank, -have % n), 2 * have


def _symbols(gram: np.ndarray, k: int) -> tuple[int, np.ndarray]:
    """How many distinct strings of ``k`` bytes there are, and the rank of each place's."""
    if k <= 2:
        return 256**k, gram >> np.uint64(64 - 8 * k)
    distinct, rank = np.unique(gram >> np.uint64(64 - 8 * k), return_inverse=True)
    return len(distinct), rank


def refined(shards: list[np.ndarray], length: int, widest: int = 8) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, interval, place in the joined shards) after each step of the merge, for all
    suffixes that share their first ``depth`` bytes with another, in sorted order.

    The transform of a shard holds, for each suffix in order, the bytes before it. A step
    sorts the interleave of all transforms by the most of these bytes (up to ``widest``)
    whose distinct values fit 16 bits.
    """
    each = [grams(s) for s in shards]
    joint = np.concatenate(each)
    begins = np.cumsum([0, *(len(s) for s in shards[:-1])])
    orders = [suffix_order(g, length) for g in each]
    start = np.concatenate([o + b for o, b in zip(orders, begins, strict=True)])

    def transform(k: int, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        before, longer = [], []  # the suffix k bytes longer: where it starts, where it stands
        for order, b in zip(orders, begins, strict=True):
            stands = np.empty(len(order), np.int32)
            stands[order] = np.arange(b, b + len(order), dtype=np.int32)
            at = (order - k) % len(order)
            before.append(at + b)
            longer.append(stands[at])
        return symbols[np.concatenate(before)].astype(np.uint16), np.concatenate(longer)

    k = min(widest, 1 << (length.bit_length() - 1))
    while (found := _symbols(joint, k))[0] > 1 << 16:
        k //= 2
    steps, depth = [], 0
    if length % k:
        steps += [(w, transform(w, _symbols(joint, w)[1])) for w in (4, 2, 1) if w < k and length % k & w]
    steps += [(k, transform(k, found[1]))] * (length // k)
    # The interleave at depth 0: shard after shard, all in one interval.
    at, interval = np.arange(len(start), dtype=np.int32), np.zeros(len(start), np.int32)
    for width, (before, longer) in steps:
        key = before[at]
        order = np.argsort(key, kind="stable")
        key, interval, at = key[order], interval[order], longer[at[order]]
        new = np.append(True, (key[1:] != key[:-1]) | (interval[1:] != interval[:-1]))
        alone = new & np.append(new[1:], True)
        if alone.any():
            keep = ~alone
            new, at = new[keep], at[keep]
        interval = new.cumsum(dtype=np.int32)
        depth += width
        yield depth, interval, start[at]
        if not len(at):
            return


def repeated_intervals(shards: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(interval, place in the joined shards) of all suffixes that share their first
    ``length`` bytes with another; shards are joined in the order given."""
    for _, interval, place in refined(shards, length):
        last = interval, place
    return last


def common_prefixes(shards: list[np.ndarray], length: int) -> np.ndarray:
    """For each place of the joined shards the bytes, ``length`` at most, that its suffix
    shares with the one it shares most with."""
    out = np.zeros(sum(map(len, shards)), np.int32)
    for depth, _, place in refined(shards, length, widest=1):
        out[place] = depth
    return out


def _later_strings(parts: list[tuple[int, int, bytes]], length: int) -> Iterator[tuple[int, int, int]]:
    """(document, start, count) runs of strings in ``parts`` (document, start, bytes) that
    also stand in an earlier place among them."""
    sizes = np.array([len(b) + 1 for _, _, b in parts])
    ends = sizes.cumsum()
    joined = np.frombuffer(b"".join(b + bytes([END]) for _, _, b in parts), np.uint8)
    cuts, last = [0], 0
    for e in ends.tolist():
        if e - last >= SHARD:
            cuts.append(e)
            last = e
    if cuts[-1] != ends[-1]:
        cuts.append(int(ends[-1]))
    interval, place = repeated_intervals([joined[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], length)
    part = np.searchsorted(ends, place, "right")
    inside = place - (ends - sizes)[part]
    whole = inside + length < sizes[part]  # not over the end of its segment
    part, inside, interval = part[whole], inside[whole], interval[whole]
    doc = np.array([d for d, _, _ in parts], np.int64)[part]
    start = np.array([s for _, s, _ in parts], np.int64)[part] + inside
    order = np.lexsort((start, doc, interval))
    doc, start, interval = doc[order], start[order], interval[order]
    first = np.append(True, interval[1:] != interval[:-1])[: len(interval)]
    run = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    later = (doc != doc[run]) | (start != start[run])
    doc, start = doc[later], start[later]
    order = np.lexsort((start, doc))
    yield from _runs(doc[order], start[order])


def _runs(doc: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, int, int]]:
    if not len(doc):
        return
    cut = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)))
    stop = np.append(cut[1:], len(doc)) - 1
    yield from zip(doc[cut].tolist(), start[cut].tolist(), (start[stop] - start[cut] + 1).tolist(), strict=True)


def _own_repeats(a: np.ndarray, s: np.ndarray, doc: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, ...]:
    """The segments (a, s, doc, p) without those that stand earlier in the same document;
    these are put together to runs, a row each, with the number of strings as ``s`` and
    ``-1 - start`` as ``p``."""
    key = mix(s.view(np.uint64) + mix(doc.view(np.uint64)))
    order = np.lexsort((p, key))
    x, y, d, place = a[order], s[order], doc[order], p[order]
    fresh = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (d[1:] != d[:-1]))
    again = order[place != place[np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))]]
    if not len(again):
        return a, s, doc, p
    keep = np.ones(len(a), bool)
    keep[again] = False
    again = again[np.lexsort((p[again], doc[again]))]
    start, count = np.divmod(p[again], 256)
    d = doc[again]
    cut = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (start[1:] != start[:-1] + count[:-1])))
    runs = a[again[cut]], np.add.reduceat(count, cut), d[cut], -1 - start[cut]
    return tuple(np.concatenate([c[keep], r]) for c, r in zip((a, s, doc, p), runs, strict=True))


def _anchored(length: int):
    """(a, s, doc, p): anchor, content and place (256 * start + strings) of the segments, and
    what a document repeats of its own, as ``_own_repeats`` puts it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in batches:
            out, rows, held, size = [], 0, [], 0
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = value.as_py().encode("utf-8", "surrogatepass")
                if len(data) < length:
                    continue
                digest = xxhash.xxh3_128_digest(data)
                if seen.get(digest, doc) < doc:  # an equal text with a smaller id has gone out
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen[digest] = doc
                if len(data) < JOINED:
                    held.append((doc, data))
                    size += len(data)
                    if size < JOINED:
                        continue
                    parts, held, size = [_joined(held)], [], 0
                else:
                    parts = (_columns(np.int64(doc), *x) for x in pieces(np.frombuffer(data, np.uint8), length))
                for part in parts:
                    out.append(part)
                    rows += len(part[0])
                    if rows > 100_000:
                        yield _rows(out)
                        out, rows = [], 0
            if held:
                out.append(_joined(held))
            if out:
                yield _rows(out)

    def _joined(held: list[tuple[int, bytes]]) -> tuple[np.ndarray, ...]:
        docs, texts = zip(*held, strict=True)
        text, *rest = joined_segments(list(texts), length)
        return _columns(np.array(docs, np.int64)[text], *rest)

    def _columns(doc: np.ndarray, anchor: np.ndarray, content: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
        return _own_repeats(anchor.view(np.int64), content.view(np.int64), np.full(start.shape, doc), start * 256 + count)

    def _rows(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["a", "s", "doc", "p"])

    return run


def _cut_out(length: int):
    """The bytes of the segments that a document's list names."""
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, value, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data = value.as_py().encode("utf-8", "surrogatepass")
                for w in wanted.as_py():
                    start, count = divmod(w["p"], 256)
                    rows.append((w["a"], w["share"], w["shared"], doc, start, data[start : start + count + length - 1]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["a", "share", "shared", "doc", "start", "piece"])

    return run


def _merged(length: int):
    """Segments sorted by anchor and share in. Out: runs of strings that stand earlier in
    the task too; and of shared anchors every other string, with its digest (x, y)."""

    def flush(parts: list[tuple[int, int, bytes]], shared: list[bool]) -> pa.RecordBatch:
        runs = [*_later_strings(parts, length)]
        rows = [(doc, start, count, None, None) for doc, start, count in runs]
        if any(shared):
            later = {(doc, start + k) for doc, start, count in runs for k in range(count)}
            for (doc, start, piece), wide in zip(parts, shared, strict=True):
                if wide and len(piece) >= length:
                    x, y = (h.view(np.int64).tolist() for h in string_hashes(np.frombuffer(piece, np.uint8), length))
                    rows += [(doc, start + k, 1, x[k], y[k]) for k in range(len(x)) if (doc, start + k) not in later]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc", "start", "count", "x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, wide, size, last = [], [], 0, None
        for batch in batches:
            for a, share, shared, doc, start, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, share) != last and size >= MERGED:
                    yield flush(parts, wide)
                    parts, wide, size = [], [], 0
                last = a, share
                parts.append((doc, start, piece))
                wide.append(shared)
                size += len(piece)
        if parts:
            yield flush(parts, wide)

    return run


def repeated_strings(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc, start, count): runs of strings of ``length`` bytes of ``docs`` (doc, text) that
    also start earlier (in a smaller doc, or the same at a smaller start)."""
    spark = docs.sparkSession
    bounded_arrow(spark)
    digests = docs.select("doc", F.md5(F.col("text").cast("binary")).alias("digest"), F.octet_length("text").alias("n")).filter(F.col("n") >= length)
    copies = written(digests.groupBy("digest").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m"), "copies")
    whole = digests.join(shuffled(copies), "digest").filter("doc <> first").select("doc", F.lit(0).cast("long").alias("start"), (F.col("n") - (length - 1)).cast("long").alias("count"))

    strings = docs.mapInArrow(_anchored(length), "a long, s long, doc long, p long")
    often = strings.groupBy("a").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("a")
    shared = written(strings.join(shuffled(written(often, "anchors")), "a"), "shared")
    own = shared.filter("p < 0").select("doc", (-1 - F.col("p")).alias("start"), F.col("s").alias("count"))
    shared = shared.filter("p >= 0")
    firsts = written(shared.groupBy("a", "s").agg(F.min(F.struct("doc", "p")).alias("f"), F.count(F.lit(1)).alias("m")), "firsts")
    again = firsts.filter("m > 1").select("a", "s", "f")
    later = shared.join(shuffled(again), ["a", "s"]).filter(F.struct("doc", "p") != F.col("f"))
    later = later.select("doc", F.expr("p div 256").alias("start"), F.expr("p % 256").alias("count"))

    groups = firsts.groupBy("a").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    shares = F.ceil(F.col("k") / F.lit(SHARE))
    wanted = firsts.join(shuffled(groups), "a").select(F.col("f.doc").alias("doc"), "a", F.col("f.p").alias("p"), F.pmod(F.xxhash64("f"), shares).alias("share"), (shares > 1).alias("shared"))
    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct("a", "share", "shared", "p")).alias("wanted"))  # no more than a text has segments
    pieces = docs.join(shuffled(lists), "doc").select("doc", "text", "wanted").mapInArrow(_cut_out(length), "a long, share long, shared boolean, doc long, start long, piece binary")
    dealt = pieces.repartition(partitions(spark), "a", "share").sortWithinPartitions("a", "share", "doc", "start")
    merged = written(dealt.mapInArrow(_merged(length), "doc long, start long, count long, x long, y long"), "runs")
    inner = merged.filter("x is null").select("doc", "start", "count")
    # The shares of one anchor have each string once by now, so no string has many rows here.
    across = merged.filter("x is not null")
    heads = across.groupBy("x", "y").agg(F.min(F.struct("doc", "start")).alias("f"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    outer = across.join(shuffled(heads), ["x", "y"]).filter(F.struct("doc", "start") != F.col("f")).select("doc", "start", "count")
    return whole.unionByName(own).unionByName(later).unionByName(inner).unionByName(outer)


def removed_ranges(runs: list[tuple[int, int]], n: int, length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges (from, to) that runs (start, count) of strings cover in ``n`` bytes."""
    out: list[list[int]] = []
    for start, count in sorted(runs):
        a, b = start, min(n, start + count + length - 1)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        elif a < b:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _kept(length: int, fields: list[str], keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value, runs in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1), strict=True):
                data = value.as_py().encode("utf-8", "surrogatepass")
                ranges = removed_ranges([(r["start"], r["count"]) for r in runs.as_py() or []], len(data), length)
                parts, at = [], 0
                for a, b in ranges:
                    parts.append(data[at:a])
                    at = b
                left = b"".join([*parts, data[at:]])
                row = (len(data), len(data) - len(left), len(ranges), hashlib.sha256(left).hexdigest())
                # A range may end inside a character: what is left of one goes too.
                rows.append((*row, left.decode("utf-8", "ignore")) if keep else row)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [()] * (4 + keep)
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *made], fields)

    return run


def without_repeats(docs: DataFrame, length: int = 100, keep: bool = True, prefix: str = "") -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans, kept_sha256 and, with ``keep``, kept_text,
    each name after ``prefix``.

    Null texts count as empty; texts shorter than ``length`` stay whole; a text of any
    length is worked through whole, a mebibyte at a time. Null ids come before all others.
    Rows that share an id are one document: equal rows are treated alike, and ranges
    removed in one hold for the other, as far as it reaches. An empty table gives an empty
    one. A column of ``docs`` with the name of a new one is replaced, others stay.
    """
    new = [prefix + x for x in ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * keep]
    names = [c for c in docs.columns if c.lower() not in {x.lower() for x in new}]
    doc, text, runs = (free_name([*docs.columns, *new], f"sx_{x}") for x in ("doc", "text", "runs"))
    keyed = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")), text: text_or_empty()})
    rows = keyed.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    found = repeated_strings(rows, length).groupBy("doc").agg(F.collect_list(F.struct("start", "count")).alias(runs)).withColumnRenamed("doc", f"{doc}_r")
    joined = keyed.join(shuffled(found), F.col(doc) == F.col(f"{doc}_r"), "left").select(*(f"`{c}`" for c in names), text, runs)
    kinds = [F.lit(0).cast("long")] * 3 + [F.lit("")] * (1 + keep)
    schema = docs.select(*(f"`{c}`" for c in names), *(k.alias(x) for k, x in zip(kinds, new, strict=True))).schema
    return joined.mapInArrow(_kept(length, [*names, *new], keep), schema)


def dedup_texts(docs: DataFrame, length: int = 100) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text``, and ``n_chars``, where there
    is one, counted anew. Every row and every column stays, null texts stay null; other
    cases as in ``without_repeats``."""
    prefix = "sx_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    out = without_repeats(docs, length, prefix=prefix)
    left = F.when(F.col("text").isNotNull(), F.col(f"{prefix}kept_text"))
    swap = {"text": left}
    for c in docs.columns:
        if c.lower() == "n_chars":
            swap[c] = F.when(F.col("text").isNotNull(), F.length(left).cast(docs.schema[c].dataType)).otherwise(F.col(c))
    return out.withColumns(swap).select(*(f"`{c}`" for c in docs.columns))


def query(docs: DataFrame) -> DataFrame:
    return without_repeats(docs.select("doc_id", "text"), 100, keep=False).drop("text")
