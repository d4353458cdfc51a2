"""Dimensions end to end over vectors: patches, frames, clips."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import dimensions as D
from tallyframe.operators.motion import indexed
from tallyframe.plans.motion import vector_fields
from tallyframe.plans.registry import query, read

#: Four patches of 16 values a frame, weighed by what the patch is; one frame in nine has none.
PATCHES_SQL = """
f AS (SELECT label AS clip, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT clip, i, j, CASE WHEN vec_id % 9 = 0 THEN 0 ELSE (vec_id + j) % 3 END::DOUBLE AS w, e[16 * j + 1:16 * j + 16] AS v FROM (SELECT *, unnest([0, 1, 2, 3]) AS j FROM f)),
u AS (SELECT clip, i, w, unnest(v) + 0.2 AS x, generate_subscripts(v, 1) AS k FROM p),
m AS (SELECT clip, i, k, CASE WHEN sum(w) > 0 THEN sum(w * x) / sum(w) END AS x FROM u GROUP BY 1, 2, 3),
v AS (SELECT clip, i, list(coalesce(x, 0) ORDER BY k) AS x, bool_or(x IS NULL) AS gone FROM m GROUP BY 1, 2),
s AS (SELECT a.clip, a.i, b.i AS j, CASE WHEN a.gone OR b.gone THEN 0 ELSE greatest(0, list_cosine_similarity(a.x, b.x)) END AS s FROM v a JOIN v b ON a.clip = b.clip AND a.i < b.i),
c AS (SELECT clip, max(j) + 1 AS frames, avg(s) FILTER (j = i + 1) AS local, avg(s) AS pairs FROM s GROUP BY 1),
h AS (SELECT clip, count_if(NOT gone) AS valid FROM v GROUP BY 1)"""


def _patches(spark, d):
    e = indexed(read(spark, d, "embeddings", "label", "vec_id", "embedding"), "label", ["vec_id"])
    e = e.select("clip", "index", "vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j"))
    weight = F.when(F.col("vec_id") % 9 == 0, 0).otherwise((F.col("vec_id") + F.col("j")) % 3)
    return e.select("clip", "index", weight.alias("weight"), F.transform(F.slice("embedding", 16 * F.col("j") + 1, F.lit(16)), lambda x: x.cast("double") + 0.2).alias("vector"))


@query(f"""WITH {PATCHES_SQL}
SELECT c.clip::VARCHAR AS clip, frames::INT AS frames, CASE WHEN valid = frames THEN 'succeeded' ELSE 'partial' END AS status, round(local, 5) AS local, round(pairs, 5) AS pairs, round(0.5 * local + 0.5 * pairs, 5) AS score FROM c JOIN h ON h.clip = c.clip""")
def subject_consistency(spark, d):  # F11, F12, F13, 2.R
    out = D.subject_consistency(_patches(spark, d))
    return out.select(*(F.round(c, 5).alias(c) if t == "double" else c for c, t in out.dtypes))


@query(f"""WITH {PATCHES_SQL}
SELECT c.clip::VARCHAR AS clip, frames::INT AS frames, valid::INT AS valid, round(pairs, 5) AS raw, round(least(1, greatest(0, 1 - 1.75 * (1 - pairs))), 5) AS score FROM c JOIN h ON h.clip = c.clip""")
def background_consistency(spark, d):  # F12, F13, D08, 2.R
    out = D.background_consistency(_patches(spark, d))
    return out.select(*(F.round(c, 5).alias(c) if t == "double" else c for c, t in out.dtypes))


@query("""WITH f AS (SELECT label AS clip, vec_id, embedding::DOUBLE[] AS e, (1 + vec_id % 2)::DOUBLE AS dt FROM embeddings),
t AS (SELECT clip, dt, vec_id % 13 <> 0 AS seen, list_sum(list_sort([4 * sqrt(e[k] * e[k] + e[65 - k] * e[65 - k]) FOR k IN range(1, 65)], 'DESC')[1:3]) / 3 AS top FROM f),
r AS (SELECT clip, seen, dt, CASE clip % 4 WHEN 0 THEN top WHEN 1 THEN top / 2 WHEN 2 THEN top / 4 END AS asked, top, 6 * 8 / 256.0::DOUBLE AS pixels, sqrt(128.0::DOUBLE) AS diag FROM t),
l AS (SELECT *, CASE WHEN seen THEN asked / diag / sqrt(dt) END AS level FROM r),
c AS (SELECT clip, count(*) AS transitions, count_if(seen) AS valid, count_if(seen AND top > pixels) AS over, sum(CASE WHEN level IS NOT NULL THEN dt END) AS time, sum(level * dt) AS moved, sum(CASE WHEN level > pixels / diag / sqrt(0.125::DOUBLE) THEN dt ELSE 0 END) AS long FROM l GROUP BY clip)
SELECT clip, CASE WHEN clip % 4 = 3 THEN 'unresolved' ELSE 'succeeded' END AS status, transitions, valid, over >= round_even(4 * (transitions + 1) / 16.0, 0) AS official_moves, over >= greatest(1, round_even(4 * (transitions + 1) / 16.0, 0)) AS moves, round(CASE WHEN clip % 4 <> 3 THEN moved / time END, 6) AS score, round(CASE WHEN clip % 4 <> 3 THEN long / time END, 6) AS significant_share FROM c""")
def dynamic_degree(spark, d):  # D10, D11, D18, F14, F15, 2.R: fields by the target of their clip
    fields = vector_fields(spark, d)
    ids = indexed(read(spark, d, "embeddings", "label", "vec_id"), "label", ["vec_id"]).select("clip", "index", "vec_id")
    f = fields.join(ids, ["clip", "index"])
    top = F.when(F.col("vec_id") % 13 != 0, D.top_mean_of(F.col("flow")))
    target = F.get(F.array(F.lit("any"), F.lit("camera"), F.lit("subject"), F.lit("unknown")), (F.col("clip") % 4).cast("int"))
    m = f.select("clip", "index", "height", "width", "dt", target.alias("target"), top.alias("apparent"), (top / 2).alias("camera"), (top / 4).alias("residual"))
    return D.dynamic_degree(m).select("clip", "status", "transitions", "valid", "official_moves", "moves", F.round("score", 6).alias("score"), F.round("significant_share", 6).alias("significant_share"))
