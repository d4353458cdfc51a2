"""Methods side by side, pairs from annotations, and transforms of prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import comparisons as M
from tallyframe.plans.registry import query, read
from tallyframe.sources.session import ensure_checkpoint_dir


@query("""WITH r AS (SELECT l_returnflag AS arm, l_extendedprice AS b, l_extendedprice + (l_partkey % 21 - 10) * l_quantity AS x, l_extendedprice + (l_suppkey % 9 - 3) * l_quantity AS y FROM lineitem)
SELECT arm, count(*) AS sources, round(avg(b), 4) AS base_mean, round(avg((x + y) / 2), 4) AS changed_mean, round(avg((x + y) / 2 - b), 4) AS delta, round(avg((abs(x - b) + abs(y - b)) / 2), 4) AS mae, round(stddev_pop(b), 4) AS base_std, round(min(b), 4) AS base_low, round(max(b), 4) AS base_high,
       round(min(least(x - b, y - b)), 4) AS largest_drop, round(max(greatest(x - b, y - b)), 4) AS largest_increase, round(max(greatest(abs(x - b), abs(y - b))), 4) AS maximum_change, round(avg(x), 4) AS mean_1701, round(avg(y), 4) AS mean_2904,
       round(quantile_cont(b, 0.05), 4) AS q05, round(quantile_cont(b, 0.25), 4) AS q25, round(quantile_cont(b, 0.5), 4) AS q50, round(quantile_cont(b, 0.75), 4) AS q75, round(quantile_cont(b, 0.95), 4) AS q95 FROM r GROUP BY arm""")
def arm_statistics(spark, d):  # K12: two changed values a line, by return flag
    p, q = F.col("l_extendedprice"), F.col("l_quantity")
    li = read(spark, d, "lineitem", "l_returnflag", "l_extendedprice", "l_quantity", "l_partkey", "l_suppkey")
    li = li.select(F.col("l_returnflag").alias("arm"), p.alias("b"), (p + (F.col("l_partkey") % 21 - 10) * q).alias("x"), (p + (F.col("l_suppkey") % 9 - 3) * q).alias("y"))
    out = M.paired_statistics(li, "arm", "b", {"1701": "x", "2904": "y"})
    return out.select(*(F.round(c, 4).alias(c) if t == "double" else c for c, t in out.dtypes))


def _method_sql(name: str, score: str) -> str:
    """The row of one method over the pairs of a table ``pairs``, every margin tried."""
    d = f"({score.format('score_a')} - {score.format('score_b')})"
    hit = "CASE WHEN (CASE WHEN abs(d) <= {m} THEN 0.5 WHEN d > 0 THEN 1.0 ELSE 0.0 END) = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    return f"""
{name}_p AS (SELECT model_a, model_b, label, split, {d} AS d, row_number() OVER () AS i FROM pairs),
{name}_t AS (SELECT m, avg({hit.format(m="m")}) AS acc FROM (SELECT DISTINCT abs(d) AS m FROM {name}_p WHERE split = 'dev' UNION SELECT 0.0), {name}_p WHERE split = 'dev' GROUP BY m),
{name}_m AS (SELECT min(m) AS m FROM {name}_t WHERE acc >= (SELECT max(acc) FROM {name}_t) - 1e-12),
{name}_k AS (SELECT sum(sign(a.d - b.d) * sign(a.label - b.label)) / sqrt((count(*) - count_if(a.d = b.d))::DOUBLE * (count(*) - count_if(a.label = b.label))) AS tau FROM {name}_p a JOIN {name}_p b ON a.i < b.i WHERE a.split = 'test' AND b.split = 'test'),
{name}_w AS (SELECT corr(p, l) AS pearson FROM (SELECT model, round(avg(p), 6) AS p, round(avg(l), 6) AS l FROM (SELECT model_a AS model, CASE WHEN d > 0 THEN 1.0 WHEN d < 0 THEN 0.0 ELSE 0.5 END AS p, label AS l FROM {name}_p
     UNION ALL SELECT model_b, 1 - CASE WHEN d > 0 THEN 1.0 WHEN d < 0 THEN 0.0 ELSE 0.5 END, 1 - label FROM {name}_p) GROUP BY model)),
{name} AS (SELECT (SELECT avg({hit.format(m="0")}) FROM {name}_p WHERE split = 'test') AS acc, (SELECT avg({hit.format(m="(SELECT m FROM " + name + "_m) + 1e-9")}) FROM {name}_p WHERE split = 'test') AS aware, (SELECT tau FROM {name}_k) AS tau, (SELECT pearson FROM {name}_w) AS pearson)"""


def comparison_sql() -> str:
    from tallyframe.plans.queries import PAIRS_SQL

    return f"""WITH {PAIRS_SQL}, {_method_sql("o", "{}")}, {_method_sql("r", "round({}, 3)")}
SELECT round(o.acc, 5) AS official_test_acc0, round(r.acc, 5) AS repair_test_acc0, round(r.acc - o.acc, 5) AS delta_test_acc0, round(o.aware, 5) AS official_test_tie_aware_acc, round(r.aware, 5) AS repair_test_tie_aware_acc, round(r.aware - o.aware, 5) AS delta_test_tie_aware_acc,
       round(o.tau, 5) AS official_kendall_tau_b, round(r.tau, 5) AS repair_kendall_tau_b, round(r.tau - o.tau, 5) AS delta_kendall_tau_b, round(o.pearson, 4) AS official_pearson, round(r.pearson, 4) AS repair_pearson, round(r.pearson - o.pearson, 4) AS delta_pearson FROM o, r"""


def method_comparison(spark, d):  # K18: scores as they are, and rounded to three digits
    from tallyframe.plans.queries import scored_pairs

    ensure_checkpoint_dir(spark)
    p = scored_pairs(spark, d).checkpoint()  # read several times
    near = p.withColumns({c: F.round(c, 3) for c in ("score_a", "score_b")})
    one = lambda t: M.method_metrics(t).withColumn("dimension", F.lit("price"))
    out = M.compared(one(p), one(near), ["dimension"], ["test_acc0", "test_tie_aware_acc", "kendall_tau_b", "pearson"]).drop("dimension")
    return out.select(*(F.round(c, 4 if c.endswith("pearson") else 5).alias(c) for c in out.columns))


@query("""WITH g AS (SELECT o_orderkey AS row, unnest(['animate', 'lavie', 'videocraft']) AS g, o_custkey AS c, o_totalprice AS t FROM orders),
p AS (SELECT row, g, c, t, CASE WHEN g = 'videocraft' AND row % 5 <> 0 THEN 'videocrafter' ELSE g END || '/' || row || '.mp4' AS path FROM g),
v AS (SELECT *, (row % 7 <> 0 OR g <> 'lavie') AND split_part(path, '/', 1) = CASE WHEN g = 'videocraft' THEN 'videocrafter' ELSE g END AS ok FROM p),
x AS (SELECT a.row, a.g AS ga, b.g AS gb, a.ok AND b.ok AS ok, a.c, CASE WHEN a.ok THEN 'd/' || a.path END AS va, CASE WHEN a.row % 11 <> 0 THEN (a.row % 3) / 2.0::DOUBLE END AS l, CASE WHEN a.row % 4 = 0 THEN 0.5 ELSE 1 - (a.row % 3) / 2.0::DOUBLE END AS r FROM v a JOIN v b ON a.row = b.row AND a.g < b.g)
SELECT ga AS generator_a, gb AS generator_b, count(*) AS pairs, count_if(ok AND l IS NOT NULL) AS usable, count_if(l IS NOT NULL AND abs(l + r - 1) < 1e-8) AS reciprocal, count(va) AS first_videos, round(sum(l), 1) AS labels FROM x GROUP BY 1, 2""")
def annotation_pairs(spark, d):  # M06: three generators an order, some without their video, label or folder
    o = read(spark, d, "orders", "o_orderkey").withColumnRenamed("o_orderkey", "source_row")
    row, names = F.col("source_row"), ("animate", "lavie", "videocraft")
    home = lambda g: F.when(row % 5 != 0, "videocrafter").otherwise(g) if g == "videocraft" else F.lit(g)
    path = lambda g: F.concat(home(g), F.lit("/"), row.cast("string"), F.lit(".mp4"))
    label, back = F.when(row % 11 != 0, (row % 3) / 2.0), F.when(row % 4 == 0, 0.5).otherwise(1 - (row % 3) / 2.0)
    anno = F.create_map(*(x for i, a in enumerate(names) for x in (F.lit(a), F.create_map(*(y for j, b in enumerate(names) if b != a for y in (F.lit(b), label if i < j else back))))))
    rows = o.select("source_row", F.create_map(*(x for g in names for x in (F.lit(g), path(g)))).alias("videos"), anno.alias("anno"))
    every = [o.select(path(g).alias("path")) for g in ("animate", "videocraft")] + [o.filter(row % 7 != 0).select(path("lavie").alias("path"))]
    out = M.annotated_pairs(rows, every[0].unionByName(every[1]).unionByName(every[2]), F.lit("d"))
    return out.groupBy("generator_a", "generator_b").agg(F.count(F.lit(1)).alias("pairs"), F.count_if("usable").alias("usable"), F.count_if("reciprocal").alias("reciprocal"), F.count("video_a").alias("first_videos"), F.round(F.sum("label_a_over_b"), 1).alias("labels"))


@query("""WITH p AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'scene' WHEN 1 THEN 'spatial' ELSE 'object' END AS task, p_size AS n FROM part),
t AS (SELECT *, CASE task WHEN 'scene' THEN ['alley', 'kitchen', 'attic'][id % 5 + 1] WHEN 'spatial' THEN ['on the left of', 'on the top of', 'near'][n % 3 + 1] ELSE CASE WHEN n % 4 > 0 THEN 'dog' END END AS target FROM p),
q AS (SELECT *, CASE task WHEN 'scene' THEN coalesce('an ' || target, 'the ocean') WHEN 'spatial' THEN 'a cat ' || target || ' a box on the left of it' ELSE 'a dog' END AS prompt FROM t),
m AS (SELECT id, task, prompt, target, 'identity' AS transform, target IS NOT NULL AS eligible, NULL AS axis FROM q
 UNION ALL SELECT id, task, CASE WHEN target = 'alley' THEN 'a lane' WHEN target = 'attic' THEN 'an upper floor' ELSE prompt END, CASE target WHEN 'alley' THEN 'lane' WHEN 'attic' THEN 'upper floor' END, 'synonym', coalesce(target IN ('alley', 'attic'), false), NULL FROM q WHERE task = 'scene'
 UNION ALL SELECT id, task, CASE WHEN target = 'kitchen' THEN 'a ocean' ELSE 'a kitchen' END, CASE WHEN target = 'kitchen' THEN 'ocean' ELSE 'kitchen' END, 'class_swap', target IS NOT NULL, NULL FROM q WHERE task = 'scene'
 UNION ALL SELECT id, task, CASE WHEN k IN ('prompt_swap', 'evidence_mirror_joint', 'video_mirror_joint') AND target <> 'near' THEN 'a cat ' || CASE target WHEN 'on the left of' THEN 'on the right of' ELSE 'on the bottom of' END || ' a box on the left of it' ELSE prompt END,
        CASE WHEN k IN ('prompt_swap', 'evidence_mirror_joint', 'video_mirror_joint') THEN CASE target WHEN 'on the left of' THEN 'on the right of' WHEN 'on the top of' THEN 'on the bottom of' END ELSE target END, k, target <> 'near', CASE target WHEN 'on the left of' THEN 'hflip' WHEN 'on the top of' THEN 'vflip' END
        FROM q, (SELECT unnest(['evidence_mirror', 'video_mirror', 'prompt_swap', 'evidence_mirror_joint', 'video_mirror_joint']) AS k) WHERE task = 'spatial'
 UNION ALL SELECT id, task, prompt, target, c || '_occlusion_' || l, target IS NOT NULL, NULL FROM q, (SELECT unnest(['target', 'background', 'non_target']) AS c), (SELECT unnest(['0.0', '0.5', '0.8', '1.0']) AS l) WHERE task = 'object')
SELECT * FROM m""")
def prompt_transforms(spark, d):  # M01: scenes, relations and objects of parts under their transforms
    p = read(spark, d, "part", "p_partkey", "p_size").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("n"))
    kind = F.get(F.array(F.lit("scene"), F.lit("spatial"), F.lit("object")), (F.col("id") % 3).cast("int"))
    pick = lambda k, *xs: F.get(F.array(*(F.lit(x) for x in xs)), k.cast("int"))
    target = F.when(kind == "scene", pick(F.col("id") % 5, "alley", "kitchen", "attic")).when(kind == "spatial", pick(F.col("n") % 3, "on the left of", "on the top of", "near")).when(F.col("n") % 4 > 0, "dog")
    p = p.select("id", kind.alias("task"), target.alias("target"))
    prompt = F.when(F.col("task") == "scene", F.coalesce(F.concat(F.lit("an "), "target"), F.lit("the ocean"))).when(F.col("task") == "spatial", F.concat(F.lit("a cat "), "target", F.lit(" a box on the left of it"))).otherwise("a dog")
    out = M.transform_matrix(p.withColumn("prompt", prompt), {"alley": "lane", "attic": "upper floor"})
    return out.select("id", "task", "prompt", "target", "transform", "eligible", "axis")
