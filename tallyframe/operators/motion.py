"""Motion fields of clips: alignment, changes of velocity, smoothness (survey N02, F15, D09),
and flicker of frames.

A field is a row (clip, index, height, width, flow, valid, dt): ``flow`` holds dx and dy of
each pixel in turn, row by row; ``valid`` a flag a pixel, or null for all; ``index`` counts a
clip's fields from 0 without gaps; ``dt`` is the time that the field spans. Neighbours meet by
an equality join on clip and index, so a long clip is spread over tasks like many short ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.functions import fields as K
from tallyframe.functions.scores import discontinuity_score
from tallyframe.operators.stats import top_mean


@dataclass(frozen=True)
class Smoothness:
    """How changes of motion become a score."""

    eps: float = 1e-3
    least_motion: float = 0.05
    magnitude_weight: float = 0.5
    direction_weight: float = 0.5
    #: Directions are compared after alignment instead of pixel by pixel.
    aligned_direction: bool = False
    #: ``topk``: mean of the ``top_k`` greatest changes. ``mean_tail``: mean of all, mixed with
    #: that of the upper tail.
    aggregation: str = "topk"
    top_k: int = 3
    tail_quantile: float = 0.9
    tail_weight: float = 0.25

    def __post_init__(self) -> None:
        finite = all(np.isfinite(x) for x in (self.eps, self.least_motion, self.magnitude_weight, self.direction_weight))
        if not finite or self.eps <= 0 or min(self.least_motion, self.magnitude_weight, self.direction_weight) < 0:
            raise ValueError("eps has to be positive, thresholds and weights not negative")
        if self.magnitude_weight == 0 and self.direction_weight == 0:
            raise ValueError("one of the weights has to be positive")
        if self.aggregation not in ("topk", "mean_tail"):
            raise ValueError("aggregation is topk or mean_tail")
        if isinstance(self.top_k, bool) or not isinstance(self.top_k, int) or self.top_k < 1:
            raise ValueError("top_k has to be a positive integer")
        if not (0 <= self.tail_quantile <= 1 and 0 <= self.tail_weight <= 1):
            raise ValueError("tail_quantile and tail_weight lie in [0, 1]")


FIELD = ("height", "width", "flow", "valid", "dt")


def _stacks(batch: pa.RecordBatch, flows: list[str], masks: list[str]) -> Iterator[tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    """(places in the batch, stacks of ``flows``, stacks of ``masks``) of the rows of each
    shape. A length that does not fit the shape, or a number that is none, raises."""
    column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
    shapes = np.stack([column["height"].to_numpy(zero_copy_only=False), column["width"].to_numpy(zero_copy_only=False)], axis=1)
    for height, width in np.unique(shapes, axis=0).tolist():
        places = np.flatnonzero((shapes == (height, width)).all(axis=1))

        def stack(name: str, size: int) -> np.ndarray:
            lists = column[name].take(pa.array(places))  # noqa: B023
            if lists.null_count or not np.all(np.diff(lists.offsets.to_numpy()) == size):
                raise ValueError(f"{name} does not have the shape of its field")
            return lists.flatten().to_numpy(zero_copy_only=False)

        out = [stack(n, height * width * 2).astype(float).reshape(-1, height, width, 2) for n in flows]
        if not all(np.isfinite(f).all() for f in out):
            raise ValueError("a field holds numbers that are not finite")
        yield places, out, [stack(n, height * width).astype(bool).reshape(-1, height, width) for n in masks]


def _each(run: Callable, flows: list[str], masks: list[str], keys: list[str], names: list[str]) -> Callable:
    """A function of Arrow batches: ``run(flows, masks, batch, places)`` gives the new columns
    of one stack; rows keep their order."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            if not batch.num_rows:
                continue
            got: list = [None] * batch.num_rows
            for places, f, m in _stacks(batch, flows, masks):
                for k, row in zip(places, zip(*run(f, m, batch, places), strict=True), strict=True):
                    got[k] = row
            keep = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            yield pa.RecordBatch.from_arrays([*keep, *(pa.array(list(c)) for c in zip(*got, strict=True))], [*keys, *names])

    return batches


def _flags(c: str) -> Column:
    return F.coalesce(F.col(c), F.array_repeat(F.lit(True), F.col("height") * F.col("width")))


def checked_fields(fields: DataFrame) -> DataFrame:
    """Fields with flags for a null ``valid``; a dt that is not positive and finite fails the
    query."""
    ok = (F.col("dt") > 0) & (F.col("dt") < float("inf"))
    dt = F.when(ok, F.col("dt")).otherwise(F.raise_error(F.lit("dt has to be finite and positive")))
    return fields.select("clip", "index", "height", "width", F.col("flow").cast("array<double>").alias("flow"), _flags("valid").alias("valid"), dt.cast("double").alias("dt"))


def _after(rows: DataFrame, names: list[str], prefix: str = "p_", back: int = 1) -> DataFrame:
    """The columns of the row ``back`` places earlier in the clip, renamed, under this row's
    index."""
    return rows.select("clip", (F.col("index") + back).alias("index"), *(F.col(n).alias(prefix + n) for n in names))


def transitions(fields: DataFrame) -> DataFrame:
    """Each field beside the one before it (``p_``). Another shape than before fails the query."""
    both = fields.join(_after(fields, list(FIELD)), ["clip", "index"])
    same = (F.col("height") == F.col("p_height")) & (F.col("width") == F.col("p_width"))
    height = F.when(same, F.col("height")).otherwise(F.raise_error(F.lit("the fields of a clip differ in shape")))
    return both.withColumn("height", height).drop("p_height", "p_width")


def field_motion(fields: DataFrame) -> DataFrame:
    """(clip, index, motion): the median speed over a field's valid pixels, 0 for none."""

    def run(f, m, batch, places):
        dt = batch.column(batch.schema.get_field_index("dt")).to_numpy(zero_copy_only=False)[places]
        speed = K.norm(f[0]) / dt[:, None, None]
        return ([K.masked(s, v)[1] for s, v in zip(speed, m[0], strict=True)],)

    kept = fields.select("clip", "index", *FIELD)
    return kept.mapInArrow(_each(run, ["flow"], ["valid"], ["clip", "index"], ["motion"]), kept.select("clip", "index", F.lit(0.0).alias("motion")).schema)


def changes(fields: DataFrame, config: Smoothness = Smoothness()) -> DataFrame:
    """A row a transition: mean, median and 0.9 quantile of the relative change of velocity
    along the earlier field (``magnitude``, ``median``, ``p90``), the share of pixels with
    one, and the mean turn of the direction, pixel by pixel and aligned."""
    c = config

    def run(f, m, batch, places):
        at = lambda n: batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False)[places][:, None, None, None]
        before, now = f[0] / at("p_dt"), f[1] / at("dt")
        along, ok = K.warp(now, f[0], m[1])
        ok &= m[0]
        was, is_, raw = K.norm(before), K.norm(along), K.norm(now)
        relative = K.norm(along - before) / (is_ + was + c.eps)
        moving = ok & (was >= c.least_motion)
        turns = [(K.turn(before, now), moving & (raw >= c.least_motion)), (K.turn(before, along), moving & (is_ >= c.least_motion))]
        stats = [K.masked(r, o) for r, o in zip(relative, ok, strict=True)]
        return (*zip(*stats, strict=True), *([K.masked(x, o)[0] for x, o in zip(t, w, strict=True)] for t, w in turns))

    pairs = transitions(fields)
    names = ["magnitude", "median", "p90", "valid_ratio", "raw_direction", "aligned_direction"]
    schema = pairs.select("clip", "index", *(F.lit(0.0).alias(n) for n in names)).schema
    got = pairs.mapInArrow(_each(run, ["p_flow", "flow"], ["p_valid", "valid"], ["clip", "index"], names), schema)
    direction = F.col("aligned_direction" if c.aligned_direction else "raw_direction")
    return got.withColumns({"direction": direction, "discontinuity": c.magnitude_weight * F.col("magnitude") + c.direction_weight * direction})


def motion_smoothness(fields: DataFrame, config: Smoothness = Smoothness()) -> DataFrame:
    """A row a clip: number of fields, status, discontinuity and score (1 where a clip has
    fewer than three fields), and the means behind them."""
    fields = checked_fields(fields)
    speed = field_motion(fields).groupBy("clip").agg(F.count(F.lit(1)).alias("fields"), F.avg("motion").alias("mean_motion"))
    steps = changes(fields, config)
    means = ("magnitude", "direction", "aligned_direction", "valid_ratio", "discontinuity")
    mean = steps.groupBy("clip").agg(F.count(F.lit(1)).alias("steps"), *(F.avg(n).alias(f"mean_{n}") for n in means))
    if config.aggregation == "topk":
        tail = top_mean(steps, "clip", "discontinuity", "index", F.lit(config.top_k), "tail")
        mixed = F.col("tail")
    else:
        count = F.greatest(F.lit(1), F.ceil(F.lit(1.0 - config.tail_quantile) * F.col("steps")))
        tail = top_mean(steps.join(mean.select("clip", "steps"), "clip"), "clip", "discontinuity", "index", count, "tail")
        mixed = (1 - config.tail_weight) * F.col("mean_discontinuity") + config.tail_weight * F.col("tail")
    enough = F.col("fields") >= 3
    d = F.when(enough, mixed).otherwise(F.lit(0.0))
    out = speed.join(mean, "clip", "left").join(tail, "clip", "left").withColumn("d", d)
    return out.select(
        "clip", "fields", F.when(enough, "succeeded").otherwise("insufficient_motion_states").alias("status"), F.col("d").alias("discontinuity"), discontinuity_score(F.col("d")).alias("score"),
        "mean_motion", *(F.when(enough, F.col(f"mean_{n}")).alias(f"mean_{n}") for n in means), F.when(enough, F.col("tail")).alias("tail_discontinuity"),
    )


def _change(rows: DataFrame, values: str, masked: bool) -> DataFrame:
    """The difference of ``values`` to ``p_values``, aligned along ``shift`` and over dt; with
    its flags. Only what ``masked`` allows is valid besides the alignment."""

    def run(f, m, batch, places):
        dt = batch.column(batch.schema.get_field_index("dt")).to_numpy(zero_copy_only=False)[places][:, None, None, None]
        before, now, shift = f
        along, ok = K.warp(now, shift, m[1] if masked else np.ones(now.shape[:3], bool))
        ok = ok & m[0] if masked else ok
        out = (along - before) / dt
        return [x.ravel() for x in out], [x.ravel() for x in ok]

    keys = ["clip", "index", "height", "width", "dt"]
    schema = rows.select(*keys, F.array(F.lit(0.0)).alias("values"), F.array(F.lit(True)).alias("valid")).schema
    return rows.mapInArrow(_each(run, [f"p_{values}", values, "shift"], ["p_valid", "valid"], keys, ["values", "valid"]), schema)


def acceleration(fields: DataFrame) -> DataFrame:
    """Change of velocity along each field over the later field's dt, from the second field
    on: (clip, index, height, width, dt, values, valid). Valid where the alignment is."""
    fields = checked_fields(fields)
    speed = F.transform("flow", lambda x: x / F.col("dt"))
    with_speed = fields.withColumn("speed", speed)
    pairs = with_speed.join(_after(with_speed, ["speed", "valid", "flow"]), ["clip", "index"]).withColumnRenamed("p_flow", "shift")
    return _change(pairs, "speed", masked=False)


def jerk(fields: DataFrame) -> DataFrame:
    """Change of acceleration in the same way, from the third field on; valid where the
    alignment and both accelerations are."""
    a = acceleration(fields)
    shift = _after(fields.select("clip", "index", F.col("flow").cast("array<double>").alias("shift")), ["shift"], "", 2)
    pairs = a.join(_after(a, ["values", "valid"]), ["clip", "index"]).join(shift, ["clip", "index"])
    return _change(pairs, "values", masked=True)


def frame_differences(frames: DataFrame) -> DataFrame:
    """(clip, index, difference): mean absolute difference of the values (``pixels``) of each
    frame to the one before. Frames of other sizes fail the query."""
    pairs = frames.select("clip", "index", "pixels").join(_after(frames, ["pixels"]), ["clip", "index"])
    total = F.aggregate(F.zip_with("pixels", "p_pixels", lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    same = F.size("pixels") == F.size("p_pixels")
    return pairs.select("clip", "index", F.when(same, total / F.size("pixels")).otherwise(F.raise_error(F.lit("the frames of a clip differ in size"))).alias("difference"))


def flicker_score(frames: DataFrame) -> DataFrame:
    """A row a clip: (255 - mean difference) / 255. A clip of one frame fails the query."""
    steps = frame_differences(frames).groupBy("clip").agg(F.count(F.lit(1)).alias("steps"), F.avg("difference").alias("mean_difference"))
    every = frames.select("clip").distinct().join(steps, "clip", "left")
    score = F.when(F.col("steps") > 0, (255 - F.col("mean_difference")) / 255).otherwise(F.raise_error(F.lit("flicker needs two frames or more")))
    return every.select("clip", "steps", "mean_difference", score.alias("score"))


def indexed(rows: DataFrame, clip: str, order: list[str]) -> DataFrame:
    """``rows`` with ``clip`` and ``index``, counted from 0 in the clip's order."""
    w = Window.partitionBy(clip).orderBy(*order)
    return rows.withColumns({"clip": F.col(clip), "index": (F.row_number().over(w) - 1).cast("int")})
