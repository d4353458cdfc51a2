"""Large JSON arrays read in parallel (survey A08): one top-level array a file, whatever its
size, split at any place.

Files are read as text between commas, which Spark splits and reads from any store. A piece
between commas changes two things: whether the text stands inside a string, and how deep it
stands; what it does depends only on whether it begins inside one. So every block of a file
sums its pieces up for both cases, the sums are put together block by block, and then each
block knows where it begins: a comma outside strings at depth one ends an element.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_SUMS = "file string, block long, size long, bytes long, ends array<int>, depths array<long>, levels array<array<long>>, counts array<array<long>>"
_STATES = "file string, block long, inside int, depth long, element long, last boolean, only boolean"


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, place, value, size of the file): the text between commas, in order within a block."""
    text = spark.read.option("lineSep", ",").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value", F.col("_metadata.file_size").alias("size"))


def effects(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each piece: whether it changes sides of a string, and by how much it goes deeper if
    it begins outside and inside one."""
    numbers = lambda x: x.to_numpy(zero_copy_only=False).astype(np.int64)
    bare = pc.replace_substring_regex(values, r"(?s)\\.", "")
    strings = r'"[^"]*("|$)'

    def deeper(text: pa.Array) -> np.ndarray:
        text = pc.replace_substring_regex(text, strings, "")
        return sum(sign * numbers(pc.count_substring(text, c)) for c, sign in (("[", 1), ("{", 1), ("]", -1), ("}", -1)))

    begun_inside = pc.replace_substring_regex(bare, r'^[^"]*("|$)', "", max_replacements=1)
    return numbers(pc.count_substring(bare, '"')) % 2, deeper(bare), deeper(begun_inside)


def _walk(inside: int, depth: int, odd: np.ndarray, outer: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Side and depth after each piece of a run that begins as given."""
    after = (inside + np.cumsum(odd)) % 2
    before = np.concatenate([[inside], after[:-1]])
    return after, depth + np.cumsum(np.where(before == 0, outer, inner))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """The rows of a batch by block; a block's rows lie side by side."""
    files, blocks = batch.column(0).to_pylist(), batch.column(1).to_numpy()
    ends = [i for i in range(1, len(files)) if blocks[i] != blocks[i - 1] or files[i] != files[i - 1]]
    for a, b in zip([0, *ends], [*ends, len(files)], strict=True):
        if a < b:
            yield files[a], int(blocks[a]), batch.slice(a, b - a)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, size, length, sides, depths, levels = None, 0, 0, [0, 1], [0, 0], [{}, {}]

    def row() -> pa.RecordBatch:
        kinds = [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64())), pa.list_(pa.list_(pa.int64()))]
        lists = [sides, depths, [list(x) for x in levels], [list(x.values()) for x in levels]]
        return pa.RecordBatch.from_arrays([pa.array([at[0]]), *(pa.array([x], pa.int64()) for x in (at[1], size, length)), *(pa.array([x], k) for x, k in zip(lists, kinds, strict=True))], ["file", "block", "size", "bytes", "ends", "depths", "levels", "counts"])

    for batch in batches:
        for file, block, run in _runs(batch):
            if (file, block) != at:
                if at:
                    yield row()
                at, size, length, sides, depths, levels = (file, block), run.column(3)[0].as_py(), 0, [0, 1], [0, 0], [{}, {}]
            length += run.num_rows + pc.sum(pc.binary_length(run.column(2))).as_py()
            e = effects(run.column(2))
            for h in (0, 1):
                after, depth = _walk(sides[h], depths[h], *e)
                for level, n in zip(*np.unique(depth[after == 0], return_counts=True), strict=True):
                    levels[h][int(level)] = levels[h].get(int(level), 0) + int(n)
                sides[h], depths[h] = int(after[-1]), int(depth[-1])
    if at:
        yield row()


def _composed(blocks: pd.DataFrame) -> pd.DataFrame:
    """Where each block of a file begins; a row a block. A file that ends inside its array
    raises."""
    inside, depth, element, out = 0, 0, 0, []
    for b in blocks.sort_values("block").itertuples():
        out.append((b.file, b.block, inside, depth, element, False))
        found = dict(zip(b.levels[inside], b.counts[inside], strict=True))
        element += int(found.get(1 - depth, 0))
        inside, depth = int(b.ends[inside]), depth + int(b.depths[inside])
    if inside or depth:
        raise ValueError(f"{out[0][0]}: the array does not end" if inside or depth > 0 else f"{out[0][0]}: brackets close that never opened")
    if blocks["bytes"].sum() == blocks["size"].iloc[0]:  # as if a comma stood after each piece
        raise ValueError(f"{out[0][0]}: text stands after the array")
    out[-1] = (*out[-1][:-1], True)
    return pd.DataFrame(out, columns=["file", "block", "inside", "depth", "element", "last"]).assign(only=element == 0)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements that end in a block, whole if they begin there too, and what is left at its
    end. Columns: file, block, value, place, inside, depth, element, last."""
    names = ["file", "element", "block", "whole", "value"]
    at, rows = None, []
    inside = depth = element = place = 0
    pending: list[str] = []
    clean = last = False

    def ended() -> None:
        if at and pending:
            text = ",".join(pending)
            if last:
                if not text.rstrip().endswith("]"):
                    raise ValueError(f"{at[0]}: text stands after the array")
                text = text.rstrip()[:-1]
            rows.append((at[0], element, at[1], clean and last, text))

    def batch_of() -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    for batch in batches:
        rows = []
        for file, block, run in _runs(batch):
            values = run.column(2).to_pylist()
            first = (file, block) != at
            if first:
                ended()
                if run.column(4).null_count:
                    raise ValueError(f"{file}: blocks were cut otherwise before")
                inside, depth, element, last = (run.column(i)[0].as_py() for i in (4, 5, 6, 7))
                at, pending, clean = (file, block), [], depth == 0 or inside == 0 and depth == 1
            places = run.column(3).to_numpy()
            if np.any(np.diff(places) != 1) or not first and places[0] != place + 1:
                raise ValueError("pieces lost their order")
            place = int(places[-1])
            after, deep = _walk(inside, depth, *effects(run.column(2)))
            starts = np.concatenate([[depth], deep[:-1]])
            if first and block == 0:
                if not values[0].lstrip().startswith("["):
                    raise ValueError(f"{file}: no array at the top")
                values[0], starts = values[0].lstrip()[1:], starts[1:]
            if np.any(starts <= 0):
                raise ValueError(f"{file}: text stands after the array")
            a = 0
            for i in np.flatnonzero((after == 0) & (deep == 1)).tolist():
                rows.append((file, element, block, clean, ",".join([*pending, *values[a : i + 1]])))
                pending, clean, a, element = [], True, i + 1, element + 1
            pending += values[a:]
            inside, depth = int(after[-1]), int(deep[-1])
        yield batch_of()
    rows = []
    ended()
    if rows:
        yield batch_of()


def array_elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, element, value): the text of each element of the top-level array of each file,
    numbered from 0 in its order.

    A file that ends inside its array, has text before or after it, or an empty element fails
    the query; a file of no bytes, as Spark writes for an empty partition, has none. An element's text is held by one task, a file's is not: of
    each block only the element that crosses its end meets another block.
    """
    pieces = _pieces(spark, path)
    sums = pieces.select("file", "block", "value", "size").mapInArrow(_summed, _SUMS)
    states = sums.groupBy("file").applyInPandas(_composed, _STATES)  # a row a block
    known = pieces.join(F.broadcast(states), ["file", "block"], "left")  # a row a block of the files
    cut = known.select("file", "block", "value", "place", "inside", "depth", "element", "last").mapInArrow(_cut, "file string, element long, block long, whole boolean, value string")
    parts = cut.filter(~F.col("whole")).groupBy("file", "element").agg(F.sort_array(F.collect_list(F.struct("block", "value"))).alias("parts"))
    joined = parts.select("file", "element", F.array_join(F.transform("parts", lambda p: p["value"]), ",").alias("value"))
    every = cut.filter("whole").select("file", "element", "value").unionByName(joined)
    only = states.filter("only").select("file", F.lit(True).alias("only")).distinct()
    blank = F.trim(F.regexp_replace("value", r"[\n\r\t]", " ")) == ""
    checked = every.join(F.broadcast(only), "file", "left").filter(~(blank & F.coalesce("only", F.lit(False))))  # a row a file at most
    return checked.select("file", "element", F.when(~blank, F.col("value")).otherwise(F.raise_error(F.concat("file", F.lit(": an empty element")))).alias("value"))


def read_json_elements(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The objects of the top-level array of each file with the given columns; one that does
    not fit the schema, or is no object, fails the query."""
    text = array_elements(spark, path)
    object_ = F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).rlike(r"(?s)^\{.*\}$")
    value = F.when(object_, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not an object: "), F.left("value", F.lit(80)))))
    schema = schema.simpleString() if isinstance(schema, StructType) else schema
    return text.select("file", "element", F.from_json(value, schema, {"mode": "FAILFAST"}).alias("x")).select("file", "element", "x.*")


def write_json_arrays(rows: DataFrame, path: str) -> None:
    """One array a partition that has rows, an element a line, written as it comes."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for batch in batches:
            if batch.num_rows:
                texts = pc.binary_join_element_wise(pa.array(["," if begun else "["] + [","] * (batch.num_rows - 1)), batch.column(0), "")
                begun = True
                yield pa.RecordBatch.from_arrays([texts], ["value"])
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array(["]"])], ["value"])

    text = rows.select(F.to_json(F.struct(*(f"`{c}`" for c in rows.columns))).alias("value"))
    text.mapInArrow(lines, "value string").write.text(path)
