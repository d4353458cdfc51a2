"""Camera fits of fields made from parts, and scores of point tracks made from vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import tracks as T
from tallyframe.plans.registry import query, read, spread


@query("""WITH p AS (SELECT p_partkey AS id, (p_size % 7 - 3)::DOUBLE AS tx, (p_partkey % 5 - 2)::DOUBLE AS ty, 4.0::DOUBLE + p_partkey % 3 AS own FROM part)
SELECT id, round(tx, 4) AS tx, round(ty, 4) AS ty, round(sqrt(tx * tx + ty * ty), 4) AS camera_mean, own AS object_top, round(sqrt(tx * tx + ty * ty) * 240 / 256 + sqrt((tx + own) * (tx + own) + ty * ty) * 16 / 256, 4) AS apparent_mean, round(240 / 256, 6) AS inlier_ratio, 'geometric_inlier_residual_consistent_border_band_prior' AS strategy FROM p""")
def camera_motion(spark, d):  # N01: a camera's shift over 16 x 16 pixels and an object of 4 x 4 that moves on its own
    p = spread(read(spark, d, "part", "p_partkey", "p_size"), "p_partkey")
    tx, ty, own = F.col("p_size") % 7 - 3, F.col("p_partkey") % 5 - 2, 4 + F.col("p_partkey") % 3
    inside = lambda k: (F.floor(k / 16).between(6, 9)) & ((k % 16).between(6, 9))
    pixel = lambda k: F.array((tx + F.when(inside(k), own).otherwise(0)).cast("double"), ty.cast("double"))
    fields = p.select(F.col("p_partkey").alias("clip"), F.lit(0).alias("index"), F.lit(16).alias("height"), F.lit(16).alias("width"), F.flatten(F.transform(F.sequence(F.lit(0), F.lit(255)), pixel)).alias("flow"))
    r = lambda c: F.round(c, 4) + 0.0  # noqa: E731 - no negative zero
    out = T.decompose_motion(fields)
    return out.select(F.col("clip").cast("long").alias("id"), r(F.get("affine", F.lit(2))).alias("tx"), r(F.get("affine", F.lit(5))).alias("ty"), r(F.col("camera.mean")).alias("camera_mean"), r(F.col("residual.top5_mean")).alias("object_top"), r(F.col("apparent.mean")).alias("apparent_mean"), F.round("inlier_ratio", 6).alias("inlier_ratio"), F.col("candidate_strategy").alias("strategy"))


@query("""WITH f AS (SELECT label AS clip, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT clip, 0.1 + 0.05 * (vec_id % 3) AS dt, abs(e[k]) * 10 AS way, abs(e[65 - k]) AS moved, abs(e[(k * 7) % 64 + 1]) * 2 AS still, abs(e[(k * 5) % 64 + 1]) * 12 AS cycle, (vec_id + k) % 7 <> 0 AS vis, (vec_id * 3 + k) % 11 <> 0 AS ins FROM (SELECT *, unnest(range(1, 65)) AS k FROM f)),
m AS (SELECT *, vis AND ins AND cycle <= 2.0 AND moved <= 0.45 AND moved + 0.015 < 0.85 * still AS moving FROM p),
s AS (SELECT *, ins AND still <= 0.30 AND NOT moving AS static FROM m),
c AS (SELECT clip, sum(dt) AS time, sum(CASE WHEN moving OR static THEN dt ELSE 0 END) / sum(dt) AS coverage, sum(way) / (sum(dt) * 48) AS raw, sum(CASE WHEN moving AND way > 0.35 THEN way ELSE 0 END) / (sum(dt) * 48) AS score,
             avg(moving::INT) AS moving_fraction, avg(static::INT) AS static_fraction, count_if(moving OR static) AS valid_pairs FROM s GROUP BY clip)
SELECT clip::VARCHAR AS clip, CASE WHEN coverage >= 0.6 THEN 'succeeded' ELSE 'insufficient_evidence' END AS status, round(CASE WHEN coverage >= 0.6 THEN score END, 5) AS score, round(coverage, 5) AS coverage, round(raw, 5) AS raw_tracks, round(moving_fraction, 5) AS moving_fraction, round(static_fraction, 5) AS static_fraction, valid_pairs FROM c""")
def track_motion(spark, d):  # N03: 64 points a pair of frames
    e = read(spark, d, "embeddings", "label", "vec_id", "embedding")
    at = lambda k: F.abs(F.get("embedding", k.cast("int")).cast("double"))
    each = lambda f: F.transform(F.sequence(F.lit(1), F.lit(64)), f)
    one = e.select(
        F.col("label").cast("string").alias("clip"), F.lit(48).alias("height"), F.lit(64).alias("width"), (0.1 + 0.05 * (F.col("vec_id") % 3)).alias("dt"), each(lambda k: at(k - 1) * 10).alias("displacement"), each(lambda k: at(64 - k)).alias("moving_error"),
        each(lambda k: at((k * 7) % 64) * 2).alias("stationary_error"), each(lambda k: at((k * 5) % 64) * 12).alias("cycle_error"), each(lambda k: (F.col("vec_id") + k) % 7 != 0).alias("visible_pair"), each(lambda k: (F.col("vec_id") * 3 + k) % 11 != 0).alias("inside_pair"),
    )
    out = T.track_scores(one)
    return out.select("clip", "status", *(F.round(c, 5).alias(c) for c in ("score", "coverage", "raw_tracks", "moving_fraction", "static_fraction")), "valid_pairs")
