"""Dimensions from evidence to a score a clip (survey 2.R): consistency of subjects and
backgrounds from weighted patches, and the degree of motion from fields."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import scores as S
from tallyframe.functions.parsed import effective_needed_frames, pixel_threshold

#: Frames whose similarities to all later ones are held at a time.
BLOCK = 256
CONSISTENCY = "clip string, frames int, valid int, local double, anchored double, pairs double"


def pooled(patches: DataFrame) -> DataFrame:
    """(clip, index, vector, weight) of patches (clip, index, weight, vector): the mean of
    a frame's vectors by weight, summed value by value, so a frame of many patches combines
    before the shuffle. A frame whose weights add up to nothing has a null vector; a negative
    weight fails the query."""
    w = F.when(F.col("weight") >= 0, F.col("weight").cast("double")).otherwise(F.raise_error(F.lit("a weight is negative or none")))
    p = patches.select("clip", "index", w.alias("w"), F.posexplode("vector").alias("k", "x"))
    sums = p.groupBy("clip", "index", "k").agg(F.sum(F.col("w") * F.col("x")).alias("s"), F.sum("w").alias("w"))
    one = sums.groupBy("clip", "index").agg(F.sort_array(F.collect_list(F.struct("k", "s"))).alias("v"), F.max("w").alias("weight"))  # the values of one vector
    return one.select("clip", "index", F.when(F.col("weight") > 0, F.transform("v", lambda x: x["s"] / F.col("weight"))).alias("vector"), "weight")


def _of_clip(frames: pd.DataFrame) -> pd.DataFrame:
    frames = frames.sort_values("index")
    x = np.array([v if v is not None else [] for v in frames["vector"]], dtype=object)
    n, have = len(x), np.array([len(v) > 0 for v in x])
    size = max((len(v) for v in x), default=0)
    m = np.zeros((n, size))
    for i in np.flatnonzero(have):
        m[i] = x[i]
    norm = np.linalg.norm(m, axis=1)
    if not np.isfinite(m).all() or (norm[have] == 0).any():
        raise ValueError(f"clip {frames['clip'].iloc[0]}: vectors have to be finite and not zero")
    m[have] /= norm[have, None]
    local = np.clip((m[1:] * m[:-1]).sum(axis=1), 0, None).sum()
    anchored = np.clip(m[1:] @ m[0], 0, None).sum() if n else 0.0
    total = 0.0
    for a in range(0, n, BLOCK):
        s = np.clip(m[a : a + BLOCK] @ m[a:].T, 0, None)
        total += np.triu(s, 1).sum()
    return pd.DataFrame([(str(frames["clip"].iloc[0]), n, int(have.sum()), local, anchored, total)], columns=["clip", "frames", "valid", "local", "anchored", "pairs"])


def consistency(frames: DataFrame) -> DataFrame:
    """of frames (clip, index, vector) a row a clip: mean similarity of neighbours
    (local), of all frames to the first (anchored) and of all pairs, each cut at 0. A frame
    with a null vector counts 0 in every mean it belongs to. A clip of one frame fails the
    query. The pairs of a clip are its definition; a block of frames is held at a time."""
    c = frames.select(F.col("clip").cast("string").alias("clip"), "index", F.col("vector").cast("array<double>").alias("vector")).groupBy("clip").applyInPandas(_of_clip, CONSISTENCY)
    n = F.when(F.col("frames") >= 2, F.col("frames")).otherwise(F.raise_error(F.concat(F.lit("two frames or more are needed: "), F.col("clip"))))
    return c.select("clip", "frames", "valid", (F.col("local") / (n - 1)).alias("local"), (F.col("anchored") / (n - 1)).alias("anchored"), (F.col("pairs") / (n * (n - 1) / 2)).alias("pairs"))


def subject_consistency(patches: DataFrame) -> DataFrame:
    """A row a clip: half the similarity of neighbours and half that of all pairs, of the
    frames' subject vectors; status by whether every frame has one."""
    c = consistency(pooled(patches))
    return c.select("clip", "frames", F.when(F.col("valid") == F.col("frames"), "succeeded").otherwise("partial").alias("status"), "local", "pairs", (0.5 * F.col("local") + 0.5 * F.col("pairs")).alias("score"))


def background_consistency(patches: DataFrame, gain: float = 1.75) -> DataFrame:
    """A row a clip: the similarity of all pairs of background vectors, its deficit enlarged."""
    c = consistency(pooled(patches))
    return c.select("clip", "frames", "valid", F.col("pairs").alias("raw"), S.calibrated(F.col("pairs"), gain).alias("score"))


#: The part of a motion that a target asks about. Fixed values.
ROUTES = {"camera": "camera", "subject": "residual", "any": "apparent"}


def dynamic_degree(motion: DataFrame, exponent: float = 0.5, reference_lag: float = 1 / 8) -> DataFrame:
    """A row a clip of ``motion`` (clip, index, height, width, dt, target, and the top means
    apparent, camera and residual of each transition): whether it moves as the official rule
    has it, whether so with one moving frame at least, and the intensity of the target's motion
    over time. A transition with a null mean is invalid and adds neither time nor motion; an
    unknown target has no intensity. Thresholds are the official pixels in the same units."""
    diagonal = F.hypot(F.col("height").cast("double"), F.col("width").cast("double"))
    pixels = pixel_threshold(F.col("height"), F.col("width"))
    asked = F.coalesce(*(F.when(F.col("target") == t, F.col(c)) for t, c in ROUTES.items()))
    ok = F.col("apparent").isNotNull() & (F.col("dt") > 0)
    level = S.intensity(asked, diagonal, F.col("dt"), exponent)
    limit = pixels / diagonal / reference_lag**exponent
    r = motion.select("clip", "target", ok.alias("ok"), F.when(ok, F.col("dt")).alias("time"), F.when(ok, level).alias("level"), (ok & (F.col("apparent") > pixels)).alias("over"), F.when(ok & level.isNotNull(), level > limit).alias("significant"))
    sums = r.groupBy("clip").agg(
        F.count(F.lit(1)).alias("transitions"), F.count_if("ok").alias("valid"), F.count_if("over").alias("over"), F.first("target").alias("target"), F.count_distinct("target").alias("targets"), F.sum(F.when(F.col("level").isNotNull(), F.col("time"))).alias("time"),
        F.sum(F.col("level") * F.col("time")).alias("moved"), F.sum(F.when(F.col("significant"), F.col("time")).otherwise(0.0)).alias("long"), F.sum("time").alias("seen"),
    )
    frames = F.col("transitions") + 1
    known = F.col("target").isin(*ROUTES)
    status = F.when(F.col("valid") == 0, "insufficient_transitions").when(~F.coalesce(known, F.lit(False)), "unresolved").otherwise("succeeded")
    one = F.when(F.col("targets") <= 1, F.lit(True)).otherwise(F.raise_error(F.lit("a clip has several targets")))
    rule = lambda n: F.col("over") >= n
    return sums.filter(one).select(
        "clip", status.alias("status"), "transitions", "valid", rule(S.needed_frames(frames)).alias("official_moves"), rule(effective_needed_frames(frames)).alias("moves"),
        F.when(status == "succeeded", F.col("moved") / F.col("time")).alias("score"), F.when(status == "succeeded", F.col("long") / F.col("time")).alias("significant_share"),
    )


def dataset_mean(scores: DataFrame, score: str = "score") -> DataFrame:
    """each clip weighs the same; the mean of all is null where one has no score."""
    n, k = F.count(F.lit(1)), F.count(score)
    return scores.agg(n.alias("clips"), k.alias("scored"), F.avg(score).alias("observed_mean"), F.when(n == k, F.avg(score)).alias("mean"))


def top_mean_of(flow: Column, share: float = 0.05) -> Column:
    """The mean length of the greatest ``share`` of a field (``flow``: dx and dy in turn), one
    at least, as an expression."""
    half = F.floor(F.size(flow) / 2).cast("int")
    sizes = F.transform(F.sequence(F.lit(0), half - 1), lambda k: F.hypot(F.get(flow, 2 * k), F.get(flow, 2 * k + 1)))
    count = F.greatest(F.lit(1), F.floor(half * F.lit(share)).cast("int"))
    return F.aggregate(F.slice(F.reverse(F.array_sort(sizes)), F.lit(1), count), F.lit(0.0), lambda s, x: s + x) / count
