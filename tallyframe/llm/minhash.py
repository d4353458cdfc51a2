"""Near-duplicate documents: one-permutation MinHash with optimal densification, banded
buckets, star-shaped candidates, and links confirmed on the full shingle sets.

One hash of every shingle fills all bins of a signature; an empty bin borrows from the
first filled bin in a random order of its own. Bands of bins make buckets. In a bucket
of m documents only the m - 1 pairs with its centre are candidates. Where links do not
tie a bucket together, its members are compared exactly: prefixes of their sets, rarest
shingles first, must share a shingle, and a set's shingles that nobody shares bound what
it can have in common with any other. Near copies that differ too much from all others
consist of such shingles, so this rest costs few pairs however large the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import bounded_arrow, free_name, shuffled, written
from tallyframe.llm.components import connected_components
from tallyframe.llm.shingles import mix, shingle_set

BANDS, ROWS = 40, 6
#: Rows of one shingle that one task of the exact comparison holds against all of them.
SHARE = 512
_rng = np.random.default_rng(7)
#: For each bin, the order in which it asks the others for a value.
_ASKED = np.array([_rng.permutation(BANDS * ROWS) for _ in range(BANDS * ROWS)])
_COEFFICIENTS = _rng.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The densified one-permutation signature of sorted distinct hashes, at least one."""
    bins = BANDS * ROWS
    place = ((shingles >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    filled, first = np.unique(place, return_index=True)  # sorted hashes: the first of a bin is its minimum
    if len(filled) == bins:
        return shingles[first]
    value = np.zeros(bins, np.uint64)
    full = np.zeros(bins, bool)
    value[filled.astype(np.int64)] = shingles[first]
    full[filled.astype(np.int64)] = True
    lender = _ASKED[np.arange(bins), full[_ASKED].argmax(axis=1)]
    return np.where(full, value, value[lender])


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = mix(sig.reshape(BANDS, ROWS)) * _COEFFICIENTS
    return mix(rows.sum(axis=1) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _signed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, digests, keys = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), k)
                ns.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                keys.append(band_keys(signature(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(ns, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["id", "n", "digest", "keys"]
            )

    return run


def _confirmed(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, centre = None, None  # pairs come sorted by centre
        for batch in batches:
            keep = []
            for i, (a, b) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                if last is None or not a.equals(last):
                    last, centre = a, shingle_set(a.as_py(), k)
                s = shingle_set(b.as_py(), k)
                both = np.intersect1d(centre, s, assume_unique=True).size
                if 100 * both >= percent * (len(centre) + len(s) - both):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return run


def _links(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) whose full sets are similar enough."""
    one, two = (texts.select(F.col("id").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
    full = pairs.join(shuffled(two), "b").join(shuffled(one), "a").select("a", "b", "ta", "tb")
    return written(full.mapInArrow(_confirmed(k, percent), "a long, b long"), "linked")


def _exploded(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                sets = [shingle_set(t.as_py(), k).view(np.int64) for t in some.column(2)]
                lengths = np.array([len(x) for x in sets])
                ids, roots = (np.repeat(some.column(c).to_numpy(), lengths) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(roots), pa.array(np.concatenate(sets))], ["id", "root", "h"])

    return run


def _rest_pairs(texts: DataFrame, roots: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of ``texts`` in different components that may be similar enough; no
    pair that is, is missing."""
    known = texts.join(shuffled(roots), "id", "left").select("id", F.coalesce("root", "id").alias("root"), "text")
    each = known.mapInArrow(_exploded(k), "id long, root long, h long")
    often = each.groupBy("h").agg(F.count("id").alias("f"))
    sets = each.join(shuffled(often), "h").groupBy("id", "root").agg(F.sort_array(F.collect_list(F.struct("f", "h"))).alias("s"))
    n = F.size("s")
    prefix = n - F.ceil(n * percent / F.lit(100.0)).cast("int") + 1
    shared = F.size(F.filter("s", lambda x: x["f"] > 1))
    # Of a set whose unshared shingles alone rule every partner out nothing is left.
    sets = sets.select("id", "root", n.alias("n"), shared.alias("c"), F.slice("s", 1, prefix).alias("s")).filter(F.lit(100) * F.col("c") >= F.lit(percent) * F.col("n"))
    heads = sets.select("id", "root", "n", "c", F.posexplode(F.filter("s", lambda x: x["f"] > 1)["h"]).alias("i", "h"))
    # A frequent shingle is dealt to shares of about SHARE heads; each meets all of them.
    shares = F.ceil(F.count("id") / SHARE).cast("int").alias("shares")
    mixed = heads.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), shares).filter("lo < hi").select("h", "shares")
    heads = written(heads.join(shuffled(mixed), "h"), "heads")
    x = heads.withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int")).alias("x")
    y = heads.withColumn("share", F.explode(F.expr("sequence(0, shares - 1)"))).alias("y")
    # With i shareable shingles of a set before the first common one, c - i can be common.
    left = F.least(F.col("x.c") - F.col("x.i"), F.col("y.c") - F.col("y.i"))
    enough = F.lit(100 + percent) * left >= F.lit(percent) * (F.col("x.n") + F.col("y.n"))
    pairs = x.join(shuffled(y), (F.col("x.h") == F.col("y.h")) & (F.col("x.share") == F.col("y.share")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.root") != F.col("y.root")) & enough)
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``.

    Documents are linked where 100 * intersection >= ``percent`` * union of their sets of
    ``k``-word shingles; component_id is the smallest id reachable. Texts that are null or
    without words have an empty set and no link. Rows with equal sets are one class from
    the start (copies cost no pairs); rows that share an id count as one document. A row
    with a null id keeps a null component. Texts of any length are read whole, an empty
    table gives an empty one, columns besides the two named are not read. A link at a similarity of 0.8 shares no bucket
    with probability 5e-6 (6e-9 at 0.85); of those that share one none is lost.
    """
    bounded_arrow(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    signed = written(rows.mapInArrow(_signed(k), "id long, n long, digest binary, keys array<long>"), "signed")
    usable = signed.filter("n > 0 and id is not null")
    copies = written(usable.groupBy("digest").agg(F.min("id").alias("first"), F.count("id").alias("m")).filter("m > 1").drop("m"), "copies")
    first = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("first", "id")).otherwise(F.col("id"))
    classed = signed.join(shuffled(copies), "digest", "left").select("id", "n", "keys", first.alias("first"))

    bands = classed.filter("keys is not null and id = first").select("id", "n", F.explode("keys").alias("key"))
    sizes = written(bands.groupBy("key").agg(F.count("id").alias("m")).filter("m > 1"), "sizes")
    shared = written(bands.join(shuffled(sizes), "key"), "shared")
    # The centre of a bucket is its member that meets most others in all its buckets: of
    # copies with changes of their own, the one with the fewest.
    met = shared.groupBy("id").agg(F.sum("m").alias("met"))
    placed = shared.join(shuffled(met), "id")
    centres = placed.groupBy("key").agg(F.max(F.struct("met", (-F.col("id")).alias("id"), "n")).alias("c")).select("key", (-F.col("c.id")).alias("a"), F.col("c.n").alias("na"))
    members = written(shared.join(shuffled(centres), "key"), "members")
    like = F.lit(100) * F.least("n", "na") >= F.lit(percent) * F.greatest("n", "na")  # no similarity exceeds the ratio of sizes
    pairs = members.filter((F.col("id") != F.col("a")) & like).select("a", F.col("id").alias("b")).distinct()
    # The texts of all members are taken out once; the joins below move these alone.
    texts = written(rows.join(shuffled(members.select("id").distinct()), "id", "left_semi"), "texts")
    links = _links(pairs, texts, k, percent)
    roots = connected_components(links)

    of = members.filter("m > 2").join(shuffled(roots), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    loose = of.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
    rest = members.filter("m > 2").join(shuffled(loose), "key", "left_semi").select("id").distinct()
    rest_texts = written(texts.join(shuffled(rest), "id", "left_semi"), "rest")
    found = _links(_rest_pairs(rest_texts, roots, k, percent), rest_texts, k, percent)
    if not found.isEmpty():
        roots = connected_components(links.unionByName(found))
    lowest = roots.groupBy("root").agg(F.min("id").alias("component_id"))
    mapped = roots.join(shuffled(lowest), "root").select(F.col("id").alias("first"), "component_id")
    return classed.join(shuffled(mapped), "first", "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "first").alias("component_id"))


def dedup_filter(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component stays: the one with the smallest id. All columns of
    ``docs`` stay; rows that share the smallest id with equal sets are kept together."""
    c, i = (free_name(docs.columns, x) for x in ("nd_component", "nd_id"))
    gone = near_duplicates(docs, k, percent).filter("id <> component_id").select(F.col("id").alias(i)).distinct()
    return docs.join(shuffled(gone), F.col("doc_id") == F.col(i), "left_anti")


def query(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs, k=3, percent=85)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
