"""Masks of frames as runs of pixels (survey N04): boxes drawn, joined over time, grown, and
laid over frames.

A run is (start, length) in the order of pixels, row by row; a mask's runs are sorted and
apart. Joining and growing are expressions over runs or joins of them: no mask is spread out
to pixels but where it meets the pixels of a frame.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RUNS = "array<struct<start:int,length:int>>"


def _run(start: Column, length: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), length.cast("int").alias("length"))


def joined_runs(runs: Column) -> Column:
    """Runs in any order and over each other as those of one mask."""
    empty = F.array().cast(RUNS)  # not made from ``runs``, which would be computed twice

    def add(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        end = last["start"] + last["length"]
        meets = (F.size(done) > 0) & (r["start"] <= F.try_element_at(done, F.lit(-1))["start"] + F.try_element_at(done, F.lit(-1))["length"])
        longer = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(_run(last["start"], F.greatest(end, r["start"] + r["length"]) - last["start"])))
        return F.when(meets, longer).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(F.array_sort(F.filter(runs, lambda r: r["length"] > 0)), empty, add)


def box_runs(boxes: Column, height: Column, width: Column) -> Column:
    """The pixels that any of ``boxes`` [x1, y1, x2, y2] touches. A box that is no area, or
    leaves the frame, or holds what is no number, fails the query."""
    e = lambda b, i: F.element_at(b, i).cast("double")
    good = lambda b: (F.size(b) == 4) & F.forall(b, lambda x: (x >= 0) & (x < float("inf"))) & (e(b, 1) < e(b, 3)) & (e(b, 2) < e(b, 4)) & (e(b, 3) <= width) & (e(b, 4) <= height)
    checked = F.when(F.forall(boxes, lambda b: F.coalesce(good(b), F.lit(False))), boxes).otherwise(F.raise_error(F.lit("invalid detector rectangle")))
    lines = lambda b: F.transform(F.sequence(F.floor(e(b, 2)), F.ceil(e(b, 4)) - 1), lambda y: _run(y * width + F.floor(e(b, 1)), F.ceil(e(b, 3)) - F.floor(e(b, 1))))
    return joined_runs(F.flatten(F.transform(checked, lines)))


def covered(runs: Column) -> Column:
    """Pixels of a mask."""
    return F.aggregate(runs, F.lit(0).cast("long"), lambda s, r: s + r["length"])


def by_row(runs: Column, width: Column) -> Column:
    """The runs cut at the ends of rows, as an array of (y, x, length)."""
    w = lambda v: F.floor(v / width)
    piece = lambda r, y: F.struct(y.alias("y"), (F.greatest(r["start"], y * width) - y * width).alias("x"), (F.least(r["start"] + r["length"], (y + 1) * width) - F.greatest(r["start"], y * width)).alias("length"))
    return F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(w(r["start"]), w(r["start"] + r["length"] - 1)), lambda y: piece(r, y))))


def dilated(runs: Column, height: Column, width: Column, radius: int) -> Column:
    """The mask grown by ``radius`` pixels to all sides and corners, within the frame."""
    r = F.lit(radius)
    low, high = (lambda p: F.greatest(p["x"] - r, F.lit(0))), (lambda p: F.least(p["x"] + p["length"] + r, width))
    lines = lambda p: F.transform(F.sequence(F.greatest(p["y"] - r, F.lit(0).cast("long")), F.least(p["y"] + r, height - F.lit(1).cast("long"))), lambda y: _run(y * width + low(p), high(p) - low(p)))
    return joined_runs(F.flatten(F.transform(by_row(runs, width), lines)))


def inverted(runs: Column, height: Column, width: Column) -> Column:
    """The pixels that are not in the mask."""
    n = F.size(runs)
    end = lambda k: F.when(k == 0, 0).otherwise(F.get(runs, k - 1)["start"] + F.get(runs, k - 1)["length"])
    start = lambda k: F.when(k < n, F.get(runs, k)["start"]).otherwise(height * width)
    return F.filter(F.transform(F.sequence(F.lit(0), n), lambda k: _run(end(k), start(k) - end(k))), lambda r: r["length"] > 0)


def union_over_time(masks: DataFrame, clip: str, runs: str = "runs") -> DataFrame:
    """(clip, runs): the pixels that any mask of a clip has. Runs are joined in their order by
    a window a clip, after equal ones have met; no frame is spread out to pixels. A clip of
    empty masks keeps an empty one."""
    each = masks.select(clip, F.explode(runs).alias("r")).groupBy(clip, "r.start").agg(F.max("r.length").alias("length"))
    w = Window.partitionBy(clip).orderBy("start")
    before = F.max(F.col("start") + F.col("length")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = each.withColumn("new", F.coalesce((F.col("start") > before).cast("int"), F.lit(1)))
    islands = new.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    one = islands.groupBy(clip, "island").agg(F.min("start").alias("start"), (F.max(F.col("start") + F.col("length")) - F.min("start")).alias("length"))
    found = one.groupBy(clip).agg(F.sort_array(F.collect_list(_run(F.col("start"), F.col("length")))).alias("mk_runs"))  # at most half the pixels of a frame
    every = masks.select(clip).distinct().join(found, clip, "left")
    return every.select(clip, F.coalesce("mk_runs", F.array().cast(RUNS)).alias(runs))


def suppressed(frames: DataFrame, fill: tuple[int, int, int] = (128, 128, 128), into: str = "pixels") -> DataFrame:
    """Frames (height, width, pixels as bytes of red, green and blue, runs, ...) with the
    masked pixels set to ``fill``, and the share of pixels left as ``visible``. A mask that
    leaves its frame, or pixels of another size, fails the query."""
    if len(fill) != 3 or not all(0 <= v <= 255 for v in fill):
        raise ValueError("fill is three values in [0, 255]")

    @F.arrow_udf("binary")
    def painted(pixels: pa.Array, sizes: pa.Array, runs: pa.Array) -> pa.Array:
        out = []
        for p, n, r in zip(pixels.to_pylist(), sizes.to_pylist(), runs.to_pylist(), strict=True):
            if len(p) != 3 * n or r and (r[-1]["start"] + r[-1]["length"] > n or r[0]["start"] < 0):
                raise ValueError("a mask or the pixels do not have the size of the frame")
            x = np.frombuffer(p, np.uint8).reshape(n, 3).copy()
            for s in r:
                x[s["start"] : s["start"] + s["length"]] = fill
            out.append(x.tobytes())
        return pa.array(out, pa.binary())

    size = F.col("height") * F.col("width")
    return frames.withColumns({into: painted("pixels", size, "runs"), "visible": 1 - covered(F.col("runs")) / size})


def intersection(a: Column, b: Column, height: Column, width: Column) -> Column:
    """The pixels of both masks: what neither leaves out."""
    return inverted(joined_runs(F.concat(inverted(a, height, width), inverted(b, height, width))), height, width)


def union(*masks: Column) -> Column:
    return joined_runs(reduce(F.concat, masks))
