"""Motion fields and frames made from vectors: a label is a clip, a vector an 8 x 8 field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import motion as M
from tallyframe.plans.registry import query, read


def vector_fields(spark: SparkSession, d: str) -> DataFrame:
    """dx is a vector's values in turn, dy the same backwards, both four times as large."""
    e = M.indexed(read(spark, d, "embeddings", "label", "vec_id", "embedding"), "label", ["vec_id"])
    x = F.transform("embedding", lambda v: v.cast("double") * 4)
    pairs = F.flatten(F.zip_with(x, F.reverse(x), lambda a, b: F.array(a, b)))
    valid = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda p: (F.col("vec_id") + p) % 11 != 0)
    return e.select("clip", "index", F.lit(8).alias("height"), F.lit(8).alias("width"), pairs.alias("flow"), valid.alias("valid"), (1 + F.col("vec_id") % 2).cast("double").alias("dt"))


#: Every pixel of a field, its place, motion, flag; and of each transition the earlier field
#: beside the later one read along it, pixel by pixel from four neighbours.
FIELDS_SQL = """
f AS (SELECT label AS clip, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, vec_id, embedding::DOUBLE[] AS e, (1 + vec_id % 2)::DOUBLE AS dt FROM embeddings),
px AS (SELECT clip, i, dt, p // 8 AS y, p % 8 AS x, e[p + 1] * 4 AS u, e[64 - p] * 4 AS v, (vec_id + p) % 11 <> 0 AS ok FROM (SELECT *, unnest(range(64)) AS p FROM f)),
t AS (SELECT c.clip, c.i, c.y, c.x, c.dt, p.u AS du, p.v AS dv, p.u / p.dt AS pu, p.v / p.dt AS pv, p.ok AS pok, c.u / c.dt AS ru, c.v / c.dt AS rv, c.x + p.u AS sx, c.y + p.v AS sy
      FROM px c JOIN px p ON p.clip = c.clip AND p.i = c.i - 1 AND p.y = c.y AND p.x = c.x),
k AS (SELECT clip, i, y, x, unnest([0, 1]) AS kx, floor(sx)::INT AS x0, floor(sy)::INT AS y0, sx - floor(sx) AS fx, sy - floor(sy) AS fy FROM t WHERE sx >= 0 AND sx <= 7 AND sy >= 0 AND sy <= 7),
k2 AS (SELECT *, unnest([0, 1]) AS ky FROM k),
w AS (SELECT clip, i, y, x, least(x0 + kx, 7) AS cx, least(y0 + ky, 7) AS cy, (CASE kx WHEN 0 THEN 1 - fx ELSE fx END) * (CASE ky WHEN 0 THEN 1 - fy ELSE fy END) AS w FROM k2),
g AS (SELECT w.clip, w.i, w.y, w.x, sum(w * u / dt) AS au, sum(w * v / dt) AS av, bool_and(w <= 2.220446049250313e-16 OR ok) AS ok FROM w JOIN px c ON c.clip = w.clip AND c.i = w.i AND c.y = w.cy AND c.x = w.cx GROUP BY ALL),
a AS (SELECT t.*, au, av, coalesce(g.ok, false) AS aok FROM t LEFT JOIN g USING (clip, i, y, x))"""


@query(f"""WITH {FIELDS_SQL},
n AS (SELECT *, pok AND aok AS met, sqrt(pu * pu + pv * pv) AS pm, sqrt(au * au + av * av) AS am, sqrt(ru * ru + rv * rv) AS rm FROM a),
r AS (SELECT *, CASE WHEN met THEN sqrt((au - pu) * (au - pu) + (av - pv) * (av - pv)) / (am + pm + 0.001) END AS rel,
             CASE WHEN met AND pm >= 0.05 AND rm >= 0.05 THEN least(2, greatest(0, 1 - (pu * ru + pv * rv) / (pm * rm))) END AS raw,
             CASE WHEN met AND pm >= 0.05 AND am >= 0.05 THEN least(2, greatest(0, 1 - (pu * au + pv * av) / (pm * am))) END AS aligned FROM n),
s AS (SELECT clip, i, coalesce(avg(rel), 0) AS magnitude, coalesce(avg(raw), 0) AS direction, coalesce(avg(aligned), 0) AS aligned, count(rel) / 64 AS ratio FROM r GROUP BY 1, 2),
o AS (SELECT *, 0.5 * magnitude + 0.5 * direction AS d, row_number() OVER (PARTITION BY clip ORDER BY 0.5 * magnitude + 0.5 * direction DESC, i) AS k FROM s),
c AS (SELECT clip, avg(d) FILTER (k <= 3) AS top, avg(d) AS mean, avg(magnitude) AS magnitude, avg(direction) AS direction, avg(aligned) AS aligned, avg(ratio) AS ratio FROM o GROUP BY 1),
m AS (SELECT clip, count(*) AS fields, avg(motion) AS mean_motion FROM (SELECT clip, i, coalesce(median(sqrt(u * u + v * v) / dt) FILTER (ok), 0) AS motion FROM px GROUP BY 1, 2) GROUP BY 1)
SELECT m.clip, fields, CASE WHEN fields >= 3 THEN 'succeeded' ELSE 'insufficient_motion_states' END AS status, round(CASE WHEN fields >= 3 THEN top ELSE 0 END, 5) AS discontinuity, round(CASE WHEN fields >= 3 THEN exp(-top) ELSE 1 END, 5) AS score,
       round(mean_motion, 5) AS mean_motion, round(CASE WHEN fields >= 3 THEN mean END, 5) AS mean_discontinuity, round(CASE WHEN fields >= 3 THEN magnitude END, 5) AS mean_magnitude,
       round(CASE WHEN fields >= 3 THEN direction END, 5) AS mean_direction, round(CASE WHEN fields >= 3 THEN aligned END, 5) AS mean_aligned_direction, round(CASE WHEN fields >= 3 THEN ratio END, 5) AS mean_valid_ratio
FROM m LEFT JOIN c ON c.clip = m.clip""")
def motion_smoothness(spark, d):  # N02, F15, D09: fields to a clip's score
    out = M.motion_smoothness(vector_fields(spark, d)).drop("tail_discontinuity")
    return out.select(*(F.round(c, 5).alias(c) if t == "double" else c for c, t in out.dtypes))


@query(f"""WITH {FIELDS_SQL},
b AS (SELECT clip, i, y, x, (au - pu) / dt AS u, (av - pv) / dt AS v FROM a WHERE au IS NOT NULL)
SELECT clip, i::INT AS index, count(*) AS pixels, round(avg(sqrt(u * u + v * v)), 5) AS mean_acceleration, round(max(u), 5) AS most_dx FROM b GROUP BY 1, 2""")
def field_acceleration(spark, d):  # N02: change of velocity along the earlier field
    a = M.acceleration(vector_fields(spark, d)).select("clip", "index", F.posexplode(F.arrays_zip("valid", F.sequence(F.lit(0), F.lit(63)).alias("p"))).alias("k", "z"), "values")
    a = a.filter("z.valid").select("clip", "index", F.get("values", 2 * F.col("k")).alias("u"), F.get("values", 2 * F.col("k") + 1).alias("v"))
    return a.groupBy("clip", "index").agg(F.count(F.lit(1)).alias("pixels"), F.round(F.avg(F.hypot("u", "v")), 5).alias("mean_acceleration"), F.round(F.max("u"), 5).alias("most_dx"))


@query("""WITH f AS (SELECT label AS clip, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i, list_transform(embedding, lambda x: (round(abs(x::DOUBLE) * 1000, 0) % 256)::INT) AS px FROM embeddings),
s AS (SELECT a.clip, list_avg([abs(a.px[k] - b.px[k]) FOR k IN range(1, 65)]) AS d FROM f a JOIN f b ON b.clip = a.clip AND b.i = a.i - 1)
SELECT clip, count(*) AS steps, round(avg(d), 5) AS mean_difference, round((255 - avg(d)) / 255, 6) AS score FROM s GROUP BY 1""")
def flicker(spark, d):  # F06, 2.R temporal_flickering: frames of 64 values
    e = M.indexed(read(spark, d, "embeddings", "label", "vec_id", "embedding"), "label", ["vec_id"])
    pixels = F.transform("embedding", lambda x: (F.round(F.abs(x.cast("double")) * 1000, 0) % 256).cast("int"))
    out = M.flicker_score(e.select("clip", "index", pixels.alias("pixels")))
    return out.select("clip", "steps", F.round("mean_difference", 5).alias("mean_difference"), F.round("score", 6).alias("score"))
