"""Masks of boxes made from items, and perturbed frames made from vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyframe.operators import masks as M
from tallyframe.operators import perturbations as P
from tallyframe.operators.motion import indexed
from tallyframe.plans.registry import query, read

#: A box an item, up to 11 x 9 pixels in a frame of 24 x 32; an order is a frame, a customer's
#: orders of a year are a clip.
BOXES_SQL = """
b AS (SELECT l_orderkey AS frame, l_orderkey % 500 AS clip, (l_partkey % 20) + 0.5 AS x1, (l_suppkey % 14) + 0.25 AS y1, x1 + 1 + l_linenumber % 10 AS x2, y1 + 1 + l_quantity::BIGINT % 8 AS y2 FROM lineitem),
px AS (SELECT DISTINCT frame, clip, y, x FROM (SELECT frame, clip, y, unnest(range(floor(x1)::BIGINT, ceil(x2)::BIGINT)) AS x FROM (SELECT *, unnest(range(floor(y1)::BIGINT, ceil(y2)::BIGINT)) AS y FROM b)))"""


def _frames(spark, d):
    li = read(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    x, y = F.col("l_partkey") % 20 + 0.5, F.col("l_suppkey") % 14 + 0.25
    box = F.array(x, y, x + 1 + F.col("l_linenumber") % 10, y + 1 + F.col("l_quantity").cast("long") % 8)
    frames = li.groupBy(F.col("l_orderkey").alias("frame")).agg(F.collect_list(box).alias("boxes"))  # a handful of lines an order
    h, w = F.lit(24), F.lit(32)
    return frames.select("frame", (F.col("frame") % 500).alias("clip"), M.box_runs(F.col("boxes"), h, w).alias("runs")), h, w


@query(f"""WITH {BOXES_SQL},
g AS (SELECT DISTINCT frame, y + dy AS y, x + dx AS x FROM px, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx) WHERE y + dy BETWEEN 0 AND 23 AND x + dx BETWEEN 0 AND 31),
n AS (SELECT frame, count(*) AS pixels, sum(y * 32 + x)::BIGINT AS places FROM px GROUP BY 1)
SELECT n.frame, pixels, places, count(*) AS grown, sum(y * 32 + x)::BIGINT AS grown_places, 768 - pixels AS outside FROM n JOIN g ON g.frame = n.frame GROUP BY ALL""")
def box_masks(spark, d):  # N04: boxes drawn and joined, grown by a pixel, turned inside out
    frames, h, w = _frames(spark, d)
    r = frames.withColumn("grown", M.dilated(F.col("runs"), h, w, 1))
    return r.select("frame", M.covered(F.col("runs")).alias("pixels"), _places("runs"), M.covered(F.col("grown")).alias("grown"), _places("grown", "grown_places"), M.covered(M.inverted(F.col("runs"), h, w)).alias("outside"))


def _places(runs, name="places"):
    """The sum of the numbers of a mask's pixels."""
    each = lambda s, r: s + r["start"].cast("long") * r["length"] + F.floor(r["length"].cast("long") * (r["length"] - 1) / 2)
    return F.aggregate(runs, F.lit(0).cast("long"), each).alias(name)


@query(f"""WITH {BOXES_SQL}
SELECT clip, count(*) AS pixels, sum(p)::BIGINT AS places FROM (SELECT DISTINCT clip, y * 32 + x AS p FROM px) GROUP BY clip""")
def mask_unions(spark, d):  # N04: every pixel that any frame of a clip masks
    frames, _, _ = _frames(spark, d)
    return M.union_over_time(frames, "clip").select("clip", M.covered(F.col("runs")).alias("pixels"), _places("runs"))


PIXELS_SQL = """f AS (SELECT label AS clip, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, list_transform(embedding, lambda x: (round(abs(x::DOUBLE) * 1000, 0) % 256)::INT) AS px FROM embeddings)"""


def _pixels(spark, d):
    """8 x 8 frames whose red is a vector's values, green a half of it, blue what is left to 255."""
    @F.arrow_udf("binary")
    def colours(values: pa.Array) -> pa.Array:
        spread = lambda v: np.stack([v, v // 2, 255 - v], axis=-1).astype(np.uint8).tobytes()
        return pa.array([spread(np.array(v, int)) for v in values.to_pylist()], pa.binary())

    e = indexed(read(spark, d, "embeddings", "label", "vec_id", "embedding"), "label", ["vec_id"])
    px = F.transform("embedding", lambda x: (F.round(F.abs(x.cast("double")) * 1000, 0) % 256).cast("int"))
    return e.select("clip", "index", F.lit(8).alias("height"), F.lit(8).alias("width"), colours(px).alias("pixels"))


@query(f"""WITH {PIXELS_SQL},
c AS (SELECT clip, i, k - 1 AS p, [px[k], px[k] // 2, 255 - px[k]] AS rgb FROM (SELECT *, unnest(range(1, 65)) AS k FROM f)),
v AS (SELECT clip, i, p * 3 + ch AS q, rgb[ch + 1] AS v FROM (SELECT *, unnest([0, 1, 2]) AS ch FROM c)),
fam AS (SELECT * FROM (VALUES ('clean', 0.0::DOUBLE, 0), ('pixel_rgb', 12.0::DOUBLE, 5), ('global_alternating', 20.0::DOUBLE, 5), ('global_random', 20.0::DOUBLE, 6)) t(family, amplitude, seed)),
h0 AS (SELECT family, amplitude, seed, clip, i, q, v, (seed::HUGEINT * 2654435761 + i::HUGEINT * 2246822507 + (CASE family WHEN 'pixel_rgb' THEN q ELSE 0 END)::HUGEINT * 3266489917) % 4294967296 AS x FROM v, fam),
h1 AS (SELECT * REPLACE ((xor(x::UBIGINT, x::UBIGINT >> 16)::HUGEINT * 2146121005) % 4294967296 AS x) FROM h0),
h2 AS (SELECT * REPLACE ((xor(x::UBIGINT, x::UBIGINT >> 15)::HUGEINT * 2221713035) % 4294967296 AS x) FROM h1),
u AS (SELECT *, xor(x::UBIGINT, x::UBIGINT >> 16)::DOUBLE / 2147483648 - 1 AS u FROM h2),
r AS (SELECT family, clip, i, q, v, v + amplitude * CASE family WHEN 'clean' THEN 0 WHEN 'global_alternating' THEN CASE WHEN (i + seed % 2) % 2 = 0 THEN 1 ELSE -1 END ELSE u END AS raw FROM u),
o AS (SELECT *, least(255, greatest(0, round_even(raw, 0))) AS w FROM r)
SELECT clip, family, count(DISTINCT i) AS frames, round(avg(abs(w - v)), 4) AS difference, round(avg((raw < 0 OR raw > 255)::INT), 4) AS clipped, sum(w * (q % 7 + 1))::BIGINT AS weighted FROM o GROUP BY 1, 2""")
def perturbed_frames(spark, d):  # N05: four families of noise on every frame
    frames = _pixels(spark, d)
    families = F.array(*(F.struct(F.lit(f).alias("family"), F.lit(a).alias("amplitude"), F.lit(s).alias("seed")) for f, a, s in (("clean", 0.0, 0), ("pixel_rgb", 12.0, 5), ("global_alternating", 20.0, 5), ("global_random", 20.0, 6))))
    plan = frames.select("clip").distinct().select("clip", F.posexplode(families).alias("variant", "x")).select("clip", "variant", "x.*")

    @F.arrow_udf("long")
    def weighted(pixels: pa.Array) -> pa.Array:
        return pa.array([int((np.frombuffer(p, np.uint8).astype(np.int64) * (np.arange(len(p)) % 7 + 1)).sum()) for p in pixels.to_pylist()], pa.int64())

    out = P.perturbed(frames, plan).withColumn("weighted", weighted("pixels"))
    return out.groupBy("clip", "family").agg(F.count(F.lit(1)).alias("frames"), F.round(F.avg("difference"), 4).alias("difference"), F.round(F.avg("clipped"), 4).alias("clipped"), F.sum("weighted").alias("weighted"))


@query("""WITH fam AS (SELECT 'clean' AS family, 0.0::DOUBLE AS amplitude, 0 AS seed UNION ALL SELECT f, a, s FROM (SELECT unnest(['pixel_rgb', 'global_random']) AS f), (SELECT unnest([2.0::DOUBLE, 8.0::DOUBLE]) AS a), (SELECT unnest([1, 2]) AS s)),
v AS (SELECT 'static' AS kind, 0 AS motion, * FROM fam UNION ALL SELECT 'translation', m, fam.* FROM (SELECT unnest([0, 1, 3]) AS m), fam WHERE amplitude IN (0, 8)
      UNION ALL SELECT 'oscillation', m, fam.* FROM (SELECT unnest([1, 3]) AS m), fam WHERE family = 'clean' OR (family = 'pixel_rgb' AND amplitude = 8 AND seed = 1))
SELECT s_suppkey, kind, motion, family, amplitude, seed FROM supplier, v""")
def ladder_variants(spark, d):  # M07: every supplier is a source
    plan = P.ladder_plan(read(spark, d, "supplier", "s_suppkey"), ["pixel_rgb", "global_random"], [2.0, 8.0], [1, 2], [0, 1, 3], strongest_only=True)
    return plan.drop("variant")
