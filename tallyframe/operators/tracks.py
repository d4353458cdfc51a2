"""Camera and object motion of fields (survey N01), and evidence of point tracks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import camera as K
from tallyframe.functions import tracks as P
from tallyframe.operators.motion import _stacks

_STATISTICS = "struct<top5_mean:double,mean:double,median:double,maximum:double>"
DECOMPOSED = f"clip string, index int, affine array<double>, inlier_ratio double, candidate_count int, initial_candidate_count int, candidate_strategy string, fallback boolean, fallback_reason string, residual_median double, residual_mad double, apparent {_STATISTICS}, camera {_STATISTICS}, residual {_STATISTICS}"


def decompose_motion(fields: DataFrame, camera: K.Camera = K.Camera(), compensate: bool = True) -> DataFrame:
    """A row a field (clip, index, height, width, flow): the similarity of the camera, how
    well it fits, and statistics of the whole motion, the camera's and what is left of it.
    Without ``compensate`` all motion is left. Each field by itself, its tries seeded by the
    settings and its size, so a split or another order changes nothing."""
    flow = F.col("flow").cast("array<double>")
    rows = fields.select(F.col("clip").cast("string").alias("clip"), F.col("index").cast("int").alias("index"), "height", "width", flow.alias("flow"))
    names = [f.split(" ")[0] for f in DECOMPOSED.replace(", ", "|").split("|")]
    kinds = [pa.string(), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.float64(), pa.float64(), *[pa.struct([(n, pa.float64()) for n in ("top5_mean", "mean", "median", "maximum")])] * 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list = [None] * batch.num_rows
            for places, (flows,), _ in _stacks(batch, ["flow"], []):
                for k, f in zip(places, flows, strict=True):
                    if compensate:
                        moved, how = K.decompose(f, camera)
                    else:
                        off = "global_compensation_disabled"
                        moved, how = np.zeros_like(f), {"affine": [1.0, 0.0, 0.0, 0.0, 1.0, 0.0], "inlier_ratio": 0.0, "candidate_count": 0, "initial_candidate_count": 0, "candidate_strategy": off, "fallback": True, "fallback_reason": off, "residual_median": K.statistics(f)["median"], "residual_mad": 0.0}
                    how = {"clip": batch.column(0)[k].as_py(), "index": batch.column(1)[k].as_py(), "apparent": K.statistics(f), "camera": K.statistics(moved), "residual": K.statistics(f - moved), **how}
                    out[k] = [how[n] for n in names]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)

    return rows.mapInArrow(run, DECOMPOSED)


@dataclass(frozen=True)
class Trajectory:
    """Tolerances of the evidence; see ``track_scores``."""

    patch_radius: int = 7
    blur_sigma: float = 1.2
    illumination_sigma: float = 0.0
    contrast_floor: float = 8.0
    match_error_max: float = 0.45
    stationary_error_max: float = 0.30
    improvement_ratio: float = 0.85
    improvement_absolute: float = 0.015
    cycle_error_max: float = 2.0
    noise_floor_pixels: float = 0.35
    min_coverage: float = 0.60

    def __post_init__(self) -> None:
        for x in (self.patch_radius, self.blur_sigma, self.contrast_floor, self.match_error_max, self.stationary_error_max, self.cycle_error_max):
            if not np.isfinite(x) or x <= 0:
                raise ValueError("sizes and tolerances have to be finite and positive")
        if not 0 < self.min_coverage <= 1 or not 0 < self.improvement_ratio < 1:
            raise ValueError("coverage or improvement ratio out of range")
        for x in (self.noise_floor_pixels, self.improvement_absolute, self.illumination_sigma):
            if not np.isfinite(x) or x < 0:
                raise ValueError("floors and scales may not be negative")
        if self.illumination_sigma and self.illumination_sigma <= self.blur_sigma:
            raise ValueError("the scale of illumination has to exceed that of the noise")


def query_grid(height: int, width: int, points: int, radius: int) -> list[tuple[float, float]]:
    """``points`` x ``points`` places (x, y) whose patches lie inside a frame, row by row."""
    margin = radius + 2
    if min(height, width) <= 2 * margin:
        raise ValueError("the frame is too small for its patches")
    xs, ys = (np.linspace(margin, n - 1 - margin, points).astype(np.float32).tolist() for n in (width, height))
    return [(x, y) for y in ys for x in xs]


EVIDENCE = "clip string, index int, height int, width int, dt double, displacement array<double>, moving_error array<double>, stationary_error array<double>, cycle_error array<double>, visible_pair array<boolean>, inside_pair array<boolean>"


def track_evidence(frames: DataFrame, config: Trajectory = Trajectory()) -> DataFrame:
    """Frames (clip, index, time, height, width, pixels as bytes of red, green and blue,
    tracks and reverse_tracks as x and y in turn, visible and reverse_visible a flag a point)
    as a row a pair of neighbours. Places that are no numbers, or lists of other lengths than
    the frame's first, fail the query. Pairs meet by clip and index."""
    names = ["time", "height", "width", "pixels", "tracks", "reverse_tracks", "visible", "reverse_visible"]
    after = frames.select("clip", (F.col("index") - 1).alias("index"), *(F.col(n).alias(f"n_{n}") for n in names))
    pairs = frames.select(F.col("clip"), "index", *names).join(after, ["clip", "index"]).withColumn("clip", F.col("clip").cast("string"))
    order = pairs.columns

    def places(values: list, n: int) -> np.ndarray:
        out = np.array(values, float).reshape(-1, 2)
        if len(out) != n or not np.isfinite(out).all():
            raise ValueError("a track has places that are none, or too few or many")
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                shape = row["height"], row["width"]
                if shape != (row["n_height"], row["n_width"]):
                    raise ValueError("the frames of a clip differ in size")
                n = len(row["visible"])
                image = [P.prepared(np.frombuffer(row[k], np.uint8).reshape(*shape, 3), config.blur_sigma, config.illumination_sigma) for k in ("pixels", "n_pixels")]
                at = [places(row[k], n) for k in ("tracks", "n_tracks", "reverse_tracks", "n_reverse_tracks")]
                flags = [row[k] for k in ("visible", "n_visible", "reverse_visible", "n_reverse_visible")]
                if any(len(f) != n for f in flags):
                    raise ValueError("a track has too few or many flags")
                e = P.pair_evidence(*image, *at, config.patch_radius, config.contrast_floor)
                out.append({"clip": row["clip"], "index": row["index"], "height": shape[0], "width": shape[1], "dt": row["n_time"] - row["time"], "visible_pair": [all(f) for f in zip(*flags, strict=True)], **{k: v.tolist() for k, v in e.items()}})
            if out:
                d, b = pa.list_(pa.float64()), pa.list_(pa.bool_())
                kinds = {"clip": pa.string(), "index": pa.int32(), "height": pa.int32(), "width": pa.int32(), "dt": pa.float64(), "displacement": d, "moving_error": d, "stationary_error": d, "cycle_error": d, "visible_pair": b, "inside_pair": b}
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in kinds.items()], list(kinds))

    return pairs.select(*order).mapInArrow(run, EVIDENCE)


def track_scores(evidence: DataFrame, config: Trajectory = Trajectory()) -> DataFrame:
    """A row a clip. A point moved where it was seen both ways, its patches match and
    better so than standing still; it stood where its patch is still there and it did not
    move. The score is the moved way over the clip's time, all points and the shorter side,
    whatever was seen: points without evidence do not raise it. Less coverage than asked for
    gives no score. A pair without a positive time, or a negative way, fails the query."""
    c = config
    zipped = F.arrays_zip(*(F.col(n) for n in ("displacement", "moving_error", "stationary_error", "cycle_error", "visible_pair", "inside_pair")))

    def state(p: Column) -> Column:
        tracked = p["visible_pair"] & p["inside_pair"] & (p["cycle_error"] <= c.cycle_error_max) & (p["moving_error"] <= c.match_error_max)
        moving = tracked & (p["moving_error"] + c.improvement_absolute < c.improvement_ratio * p["stationary_error"])
        static = p["inside_pair"] & (p["stationary_error"] <= c.stationary_error_max) & ~moving
        return F.struct(p["displacement"].alias("way"), moving.alias("moving"), static.alias("static"))

    ok = (F.col("dt") > 0) & (F.col("dt") < float("inf")) & F.forall("displacement", lambda x: (x >= 0) & (x < float("inf")))
    dt = F.when(ok, F.col("dt")).otherwise(F.raise_error(F.lit("a pair needs a positive time and ways that are not negative")))
    pairs = evidence.select("clip", "height", "width", dt.alias("dt"), F.transform(zipped, state).alias("p"))
    count = lambda f: F.size(F.filter("p", f)).cast("long")
    way = lambda f: F.aggregate(F.filter("p", f), F.lit(0.0), lambda s, x: s + x["way"])
    moving, static = (lambda x: x["moving"]), (lambda x: x["static"])
    pairs = pairs.select(
        "clip", "dt", F.least("height", "width").alias("side"), F.size("p").cast("long").alias("points"), count(moving).alias("moving"), count(static).alias("static"),
        way(lambda x: F.lit(True)).alias("raw"), way(moving).alias("verified"), way(lambda x: x["moving"] & (x["way"] > c.noise_floor_pixels)).alias("full"),
    )
    total = pairs.groupBy("clip").agg(
        F.sum("dt").alias("seconds"), F.max("points").alias("points"), F.min("points").alias("fewest"), F.max("side").alias("side"), F.sum("points").alias("total_pairs"), F.sum(F.col("moving") + F.col("static")).alias("valid_pairs"),
        F.sum((F.col("moving") + F.col("static")) * F.col("dt")).alias("seen"), F.sum("moving").alias("moving"), F.sum("static").alias("static"), *(F.sum(n).alias(n) for n in ("raw", "verified", "full")),
    )
    points = F.when(F.col("points") == F.col("fewest"), F.col("points")).otherwise(F.raise_error(F.lit("the pairs of a clip differ in points")))
    whole = F.col("seconds") * points
    coverage = F.col("seen") / whole
    per = lambda n: F.col(n) / (whole * F.col("side"))
    enough = coverage >= c.min_coverage
    return total.select(
        "clip", F.when(enough, "succeeded").otherwise("insufficient_evidence").alias("status"), F.when(enough, per("full")).alias("score"), coverage.alias("coverage"), (F.col("moving") / F.col("total_pairs")).alias("moving_fraction"),
        (F.col("static") / F.col("total_pairs")).alias("static_fraction"), per("raw").alias("raw_tracks"), per("verified").alias("verified_correspondence"), per("full").alias("full"), "valid_pairs", "total_pairs",
    )
