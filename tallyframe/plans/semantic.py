"""Semantic scores of clips: an order is a clip, two line items make a frame's detections.

A line item of quantity 13 has a box without area, so its frame counts as missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import semantic as V
from tallyframe.plans.registry import query, read

FRAMES = 16
DETECTIONS_SQL = """d AS (SELECT l_orderkey AS id, (l_linenumber - 1) // 2 AS slot, row_number() OVER () AS k, 'c' || (l_partkey % 3) AS label, (l_partkey % 9)::DOUBLE AS x1, (l_suppkey % 7)::DOUBLE AS y1,
     l_partkey % 9 + CASE WHEN l_quantity = 13 THEN 0 ELSE 20.0 END AS x2, l_suppkey % 7 + 20.0 AS y2, l_quantity = 13 AS bad FROM lineitem),
f AS (SELECT id, slot, bool_or(bad) AS bad FROM d GROUP BY 1, 2),
c AS (SELECT DISTINCT id FROM d)"""


def clips(spark: SparkSession, d: str) -> DataFrame:
    """(id, frames): the detections of each clip by slot."""
    li = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    x, y = (F.col("l_partkey") % 9).cast("double"), (F.col("l_suppkey") % 7).cast("double")
    box = F.array(x, y, x + F.when(F.col("l_quantity") == 13, 0.0).otherwise(20.0), y + 20.0)
    det = F.struct(F.concat(F.lit("c"), (F.col("l_partkey") % 3).cast("string")).alias("label"), box.alias("box"))
    rows = li.groupBy(F.col("l_orderkey").alias("id"), F.expr("cast((l_linenumber - 1) div 2 as int)").alias("slot")).agg(F.array_sort(F.collect_list(det)).alias("found"))
    # A clip has no more slots than a frame count fixed by the protocol.
    held = rows.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "found"))).alias("m"))
    return held.select("id", F.transform(F.sequence(F.lit(0), F.lit(FRAMES - 1)), lambda i: F.col("m")[i]).alias("frames"))


def entities() -> F.Column:
    return F.when(F.col("id") % 4 == 0, F.array(F.lit("c0"), F.lit("c1"))).otherwise(F.array(F.concat(F.lit("c"), (F.col("id") % 3).cast("string"))))


ENTITIES_SQL = """e AS (SELECT id, unnest(CASE WHEN id % 4 = 0 THEN ['c0', 'c1'] ELSE ['c' || (id % 3)] END) AS name FROM c)"""
IOU_SQL = """(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))) /
 ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)))"""


def _fields(spark_struct: F.Column, *names: str) -> list[F.Column]:
    return [F.round(spark_struct[n], 6).alias(n) for n in names] + [spark_struct["status"].alias("status")]


@query(f"""WITH {DETECTIONS_SQL}, {ENTITIES_SQL},
good AS (SELECT d.* FROM d JOIN f USING (id, slot) WHERE NOT f.bad),
s AS (SELECT f.id, f.slot, e.name, count(a.k) > 0 AS there, bool_or(b.k IS NOT NULL) AS sure FROM f JOIN e ON e.id = f.id LEFT JOIN good a ON a.id = f.id AND a.slot = f.slot AND a.label = e.name
      LEFT JOIN good b ON b.id = a.id AND abs(b.slot - a.slot) = 1 AND b.label = a.label AND {IOU_SQL} >= 0.5 WHERE NOT f.bad GROUP BY 1, 2, 3),
t AS (SELECT id, slot, CASE WHEN bool_or(NOT there) THEN 'absent' WHEN bool_and(sure) THEN 'supported' ELSE 'unconfirmed' END AS state FROM s GROUP BY 1, 2)
SELECT c.id, round(count(*) FILTER (state = 'supported') / 16.0::DOUBLE, 6) AS score, round(count(state) / 16.0::DOUBLE, 6) AS coverage, round(count(*) FILTER (state = 'unconfirmed') / 16.0::DOUBLE, 6) AS abstention,
       round(1 - count(state) / 16.0::DOUBLE, 6) AS missing, CASE WHEN count(state) = 16 THEN 'ok' ELSE 'partial' END AS status FROM c LEFT JOIN t ON t.id = c.id GROUP BY c.id""")
def objects_scores(spark, d):  # F09, D14
    s = clips(spark, d).select("id", V.objects_score(entities(), F.col("frames"), FRAMES).alias("s"))
    return s.select("id", *_fields(F.col("s"), "score", "coverage", "abstention", "missing"))


@query(f"""WITH {DETECTIONS_SQL}, {ENTITIES_SQL},
s AS (SELECT f.id, f.slot, bool_and(EXISTS (SELECT 1 FROM d a WHERE a.id = f.id AND a.slot = f.slot AND a.label = e.name)) AS hit FROM f JOIN e ON e.id = f.id GROUP BY 1, 2)
SELECT c.id, round(count_if(hit) / 16.0::DOUBLE, 6) AS score, round(count(hit) / 16.0::DOUBLE, 6) AS coverage, 'partial' AS status FROM c JOIN s ON s.id = c.id GROUP BY c.id""")
def label_scores(spark, d):  # F07, D15: labels alone, whatever their boxes
    labels = F.transform("frames", lambda f: F.transform(f, lambda x: x["label"]))
    s = clips(spark, d).select("id", V.labels_score(entities(), labels, FRAMES).alias("s"))
    return s.select("id", *_fields(F.col("s"), "score", "coverage"))


@query(f"""WITH {DETECTIONS_SQL},
r AS (SELECT id, unnest([{{'s': 'c0', 'r': CASE WHEN id % 2 = 0 THEN 'left' ELSE 'above' END, 'o': 'c1'}}, {{'s': 'c1', 'r': 'right', 'o': 'c1'}}]) AS t, unnest([0, 1]) AS n FROM c),
g AS (SELECT f.id, f.slot FROM f WHERE NOT EXISTS (SELECT 1 FROM d a WHERE a.id = f.id AND a.slot = f.slot AND a.bad AND a.label IN ('c0', 'c1'))),
p AS (SELECT g.id, g.slot, r.n, r.t.r AS rel, {IOU_SQL} AS iou, (b.x1 + b.x2 - a.x1 - a.x2) / 2 AS dx, (b.y1 + b.y2 - a.y1 - a.y2) / 2 AS dy
      FROM g JOIN r ON r.id = g.id JOIN d a ON a.id = g.id AND a.slot = g.slot AND a.label = r.t.s JOIN d b ON b.id = g.id AND b.slot = g.slot AND b.label = r.t.o AND a.k <> b.k),
v AS (SELECT id, slot, n, max(CASE WHEN (rel = 'left' AND abs(dx) > abs(dy) AND dx > 0) OR (rel = 'right' AND abs(dx) > abs(dy) AND dx < 0) OR (rel = 'above' AND abs(dy) > abs(dx) AND dy > 0) THEN CASE WHEN iou < 0.1 THEN 1.0 ELSE 0.1 / iou END ELSE 0.0 END) AS s FROM p GROUP BY 1, 2, 3),
w AS (SELECT g.id, g.slot, coalesce(sum(v.s), 0) / 2 AS s FROM g LEFT JOIN v ON v.id = g.id AND v.slot = g.slot GROUP BY 1, 2)
SELECT c.id, round(coalesce(sum(w.s), 0) / 16.0::DOUBLE, 6) AS score, round(count(w.s) / 16.0::DOUBLE, 6) AS coverage, 'partial' AS status FROM c LEFT JOIN w ON w.id = c.id GROUP BY c.id""")
def spatial_video_scores(spark, d):  # two relations a clip, signed
    one = lambda s, r, o: F.struct(F.lit(s).alias("subject"), r.alias("relation"), F.lit(o).alias("object"))
    triples = F.array(one("c0", F.when(F.col("id") % 2 == 0, "left").otherwise("above"), "c1"), one("c1", F.lit("right"), "c1"))
    s = clips(spark, d).select("id", V.spatial_score(triples, F.col("frames"), FRAMES).alias("s"))
    return s.select("id", *_fields(F.col("s"), "score", "coverage"))


@query("""WITH s AS (SELECT user_id, event_type, max(value) / 100 AS s FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, event_type) AS k FROM s),
a AS (SELECT DISTINCT user_id, unnest(['click', 'other', 'view']) AS a FROM s),
h AS (SELECT a.user_id, a.a, coalesce(bool_or(a.a <> 'other' AND r.k <= 5 AND round_even(r.s, 4) >= 0.85), false) AS hit FROM a LEFT JOIN r ON r.user_id = a.user_id AND r.event_type = a.a GROUP BY 1, 2)
SELECT user_id, round(count_if(hit) / 3, 6) AS score, round(1 / 3, 6) AS abstention, round(count_if(hit) / 2, 6) AS known_class_score, 'ok' AS status FROM h GROUP BY user_id""")
def action_scores(spark, d):  # F10, D17: a user's event types are classes
    e = read(spark, d, "events", "user_id", "event_type", "value").groupBy("user_id", "event_type").agg((F.max("value") / 100).alias("s"))
    # One entry an event type, of which there are few.
    top = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("n"), "event_type"))).alias("x"))
    s = top.select("user_id", V.action_score(F.array(F.lit("click"), F.lit("other"), F.lit("view")), F.transform("x", lambda x: x["event_type"]), F.transform("x", lambda x: -x["n"])).alias("s"))
    return s.select("user_id", *_fields(F.col("s"), "score", "abstention", "known_class_score"))


@query("""WITH k AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
s AS (SELECT conv_id, contains(text, 'the') AND contains(text, 'a') AS ok FROM k WHERE k <= 16 AND text IS NOT NULL)
SELECT c.conv_id, round(count_if(ok) / 16.0::DOUBLE, 6) AS score, round(count(ok) / 16.0::DOUBLE, 6) AS coverage, CASE WHEN count(ok) = 16 THEN 'ok' ELSE 'partial' END AS status
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id = c.conv_id GROUP BY 1""")
def scene_scores(spark, d):  # F10, D16: turns are captions
    from pyspark.sql.window import Window

    c = read(spark, d, "conversations", "conv_id", "turn", "text").withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    held = c.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("k") <= 16, F.struct(F.col("k").alias("i"), "text")))).alias("m"))
    captions = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: F.col("m")[i])
    s = held.select("conv_id", V.scene_score(V.scene_labels(F.array(F.lit("the"), F.lit("a")), captions)).alias("s"))
    return s.select("conv_id", *_fields(F.col("s"), "score", "coverage"))
