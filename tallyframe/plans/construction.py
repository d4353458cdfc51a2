"""Queries of builders and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import construction as M
from tallyframe.operators import contracts as C
from tallyframe.operators import reports as Q
from tallyframe.operators import stats as K
from tallyframe.plans.queries import ORDERS_SQL, scored_orders, scored_pairs
from tallyframe.plans.registry import query, read

SCENES = {"red ring": "crimson hoop", "old bolt": "antique screw"}


@query(f"""WITH g AS (SELECT l_partkey AS id, CASE WHEN min(l_returnflag) = max(l_returnflag) THEN min(l_returnflag) END AS e, CASE WHEN min(l_linenumber % 2) = max(l_linenumber % 2) THEN (min(l_linenumber % 2))::VARCHAR END AS v FROM lineitem GROUP BY 1),
f AS (SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY p_type, p_size) AS family FROM part),
c AS (SELECT p_partkey::VARCHAR AS source_id, coalesce(CASE WHEN p_size % 3 > 0 THEN 'kind' || (p_size % 3) END, 'unknown') AS condition, e AS expected, v AS visual_expected, 'a ' || p_name AS prompt, p_type AS caption, family FROM part LEFT JOIN g ON g.id = p_partkey JOIN f ON f.id = p_partkey)
SELECT *, NULL::VARCHAR AS original_prompt FROM c UNION ALL
SELECT source_id || ':synonym', 'synonym', expected, visual_expected, CASE prompt WHEN 'a red ring' THEN 'a crimson hoop' ELSE 'an antique screw' END, caption, family, prompt FROM c WHERE prompt IN ('a red ring', 'a old bolt')""")
def labelled_conditions(spark, d):  # M02: parts of one type and size are a family
    p = read(spark, d, "part").withColumn("id", F.col("p_partkey"))
    kind = F.when(F.col("p_size") % 3 > 0, F.concat(F.lit("kind"), (F.col("p_size") % 3).cast("string")))
    plan = p.select("id", kind.alias("kind"), F.concat(F.lit("a "), "p_name").alias("prompt"), F.col("p_type").alias("caption"))
    gold = read(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("evidence"), (F.col("l_linenumber") % 2).cast("string").alias("visual"))
    keys = p.select("id", F.concat_ws("|", "p_type", "p_size").alias("key"))
    return M.conditions(plan, gold, keys, SCENES)


@query("""WITH s AS (SELECT doc_id, lang, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 2000 THEN 'middle' END AS bucket FROM documents)
SELECT doc_id, lang, bucket, t AS target_bucket FROM s, (SELECT unnest(['short', 'middle', 'long']) AS t) WHERE bucket IS NULL OR bucket <> t""")
def length_families(spark, d):  # M03
    bucket = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 2000, "middle")
    return M.length_families(read(spark, d, "documents").select("doc_id", "lang", bucket.alias("bucket")), "bucket", ["short", "middle", "long"])


@query("""WITH c AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'polishing ' || p_name ELSE p_name END AS label, p_size % 2 = 0 OR regexp_matches(p_name, '^[^ ]*ing ') AS kept FROM part)
SELECT p_partkey, CASE WHEN kept THEN 'A person is ' ELSE 'The action is ' END || label || '.' AS prompt, kept FROM c""")
def weak_action_labels(spark, d):  # M04
    label = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("polishing "), "p_name")).otherwise(F.col("p_name"))
    return M.weak_actions(read(spark, d, "part").select("p_partkey", label.alias("label"))).drop("label")


@query("""WITH e AS (SELECT l_orderkey * 10 + l_linenumber AS k, 'C' || (min(l_partkey) % 50) AS s, ['left', 'right', 'above', 'near'][(min(l_suppkey) % 4 + 1)::INT] AS r, 'C' || (min(l_suppkey) % 50) AS o FROM lineitem GROUP BY 1),
x AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY sha256('3:' || k), k) AS n FROM e WHERE r <> 'near')
SELECT k, r AS direction, 'The ' || lower(s) || CASE r WHEN 'above' THEN ' is above the ' ELSE ' is to the ' || r || ' of the ' END || lower(o) || '.' AS prompt FROM x WHERE n <= 40""")
def weak_relation_labels(spark, d):  # M04, H09
    e = read(spark, d, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k")).agg(F.min("l_partkey").alias("a"), F.min("l_suppkey").alias("b"))
    direction = F.get(F.array(*(F.lit(x) for x in ("left", "right", "above", "near"))), (F.col("b") % 4).cast("int"))
    word = lambda c: F.concat(F.lit("C"), (F.col(c) % 50).cast("string"))
    edges = e.select("k", word("a").alias("subject"), direction.alias("direction"), word("b").alias("object"))
    return M.weak_relations(edges, "k", 40, 3).select("k", "direction", "prompt")


@query("""WITH g AS (SELECT p_partkey % 5 AS build, p_partkey AS source, f AS family, a AS amplitude FROM part, (SELECT unnest(['clean', 'shake']) AS f), (SELECT unnest([1, 2, 4]) AS a))
SELECT build, family, amplitude::INT AS amplitude, count(*) AS n, count(DISTINCT source) AS sources FROM g GROUP BY ALL""")
def candidate_ledger(spark, d):  # M07, E09, L01
    s = read(spark, d, "part", "p_partkey").select((F.col("p_partkey") % 5).alias("build"), F.col("p_partkey").alias("source"))
    grid = s.withColumn("family", F.explode(F.array(F.lit("clean"), F.lit("shake")))).withColumn("amplitude", F.explode(F.array(*(F.lit(a) for a in (1, 2, 4)))))
    grid = grid.withColumn("candidate", F.concat_ws(":", "source", "family", "amplitude"))
    builds = s.groupBy("build").agg(F.count(F.lit(1)).alias("sources")).withColumn("protocol", F.lit("v1"))
    return M.merged_ledgers(grid, builds, "build", "source", "candidate", 6).groupBy("build", "family", "amplitude").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"))


@query("""WITH v AS (SELECT s_suppkey AS i, 200 + s_suppkey * 7 % 90 AS frames, [8.0, 16.0, 24.0][(s_suppkey % 3 + 1)::INT]::DOUBLE AS fps FROM supplier),
g AS (SELECT *, round_even(fps / 8, 0)::BIGINT AS k FROM v), h AS (SELECT *, (frames + k - 1) // k AS n FROM g)
SELECT 'set:' || i AS source_id, round(frames / fps, 6) AS seconds, k AS "interval", 0::BIGINT AS first, (n - 16) // 2 * k AS middle, (n - 16) * k AS last FROM h""")
def cohort_windows(spark, d):  # M09, G07
    s = read(spark, d, "supplier")
    i = F.col("s_suppkey")
    n = s.count()
    fps = F.get(F.array(*(F.lit(x) for x in (8.0, 16.0, 24.0))), (i % 3).cast("int"))
    c = M.cohort(s.select(i.alias("index"), (200 + i * 7 % 90).alias("frames"), fps.alias("fps")), s.select(i.alias("index"), F.concat_ws(" ", F.lit("Clip"), i).alias("prompt")), "set", n)
    w = F.col("windows")
    return c.select("source_id", F.round("seconds", 6).alias("seconds"), w["interval"].alias("interval"), w["start"].alias("first"), w["middle"].alias("middle"), w["end"].alias("last"))


@query("""WITH s AS (SELECT l_orderkey AS id, o_orderpriority AS position, ['clean', 'background', 'subject', 'clean', 'background', 'clean', 'background'][(l_linenumber - 1) % 7 + 1] AS variant, ['a', 'a', 'a', 'official', 'official', 'b', 'b'][(l_linenumber - 1) % 7 + 1] AS method, CASE WHEN l_quantity <> 7 THEN l_discount * 8 END AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
w AS (SELECT id, position, m.m AS method, max(v) FILTER (variant = 'clean' AND method = m.m) AS c, max(v) FILTER (variant = 'background' AND method = m.m) AS b, max(v) FILTER (variant = 'subject' AND method = m.m) AS s,
      abs(max(v) FILTER (variant = 'clean' AND method = 'official') - max(v) FILTER (variant = 'background' AND method = 'official')) AS origin FROM s, (SELECT unnest(['a', 'b']) AS m) AS m GROUP BY ALL),
x AS (SELECT position, method, origin, abs(c - b) AS moved, c - s AS d, coalesce(c = 0 AND b = 0, false) AS zero, origin IS NOT NULL AND c - b IS NOT NULL AS paired FROM w),
y AS (SELECT *, coalesce(NOT zero AND origin >= 0.1 AND moved <= 0.01, false) AS joint FROM x)
SELECT position, method, count(*) AS cases, count(*) FILTER (paired) AS paired, round(avg(origin) FILTER (paired), 6) AS origin_mean, round(avg(moved) FILTER (paired), 6) AS moved_mean, count(d) AS subject_scored, count(*) FILTER (d > 0) AS positive, count(*) FILTER (d < 0) AS wrong_direction,
       count(*) FILTER (abs(d) <= 0.01) AS negligible, count(*) FILTER (d > 0.01) AS drop_gt_001, count(*) FILTER (d >= 0.05) AS drop_ge_005, count(*) FILTER (d >= 0.1) AS drop_ge_010, count(*) FILTER (d > moved) AS subject_larger, count(*) FILTER (zero) AS zero_to_zero,
       count(*) FILTER (paired AND origin >= 0.1) AS origin_ge_01, count(*) FILTER (paired AND origin >= 0.2) AS origin_ge_02, count(*) FILTER (joint) AS joint_success, round(count(*) FILTER (joint) / count(*), 6) AS joint_fraction, count(*) FILTER (joint AND d >= 0.05) AS joint_with_response FROM y GROUP BY 1, 2""")
def stability_report(spark, d):  # K14: an order is a case, its lines are variants and methods
    li = read(spark, d, "lineitem").join(read(spark, d, "orders", "o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    pick = lambda xs: F.get(F.array(*(F.lit(x) for x in xs)), ((F.col("l_linenumber") - 1) % 7).cast("int"))
    variant, method = pick(("clean", "background", "subject", "clean", "background", "clean", "background")), pick(("a", "a", "a", "official", "official", "b", "b"))
    status = F.when(F.col("l_quantity") == 7, "failed").otherwise("succeeded")
    s = li.select(F.col("l_orderkey").alias("id"), F.col("o_orderpriority").alias("position"), variant.alias("variant"), method.alias("method"), (F.col("l_discount") * 8).alias("score"), status.alias("status"))
    return Q.stability(s, ["id"], ["a", "b"], "position")


@query()
def generator_confound(spark, d):  # K17: the least solution of a rank-deficient system, no SQL
    p = scored_pairs(spark, d).select(F.concat(F.lit("g"), F.col("model_a").cast("string")).alias("generator_a"), F.concat(F.lit("g"), F.col("model_b").cast("string")).alias("generator_b"), F.when(F.col("split") == "dev", "validation").otherwise("train").alias("role"), "label")
    return Q.generator_confound(p)


@query("""WITH v AS (SELECT o_orderpriority AS g, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS official, CASE WHEN o_orderstatus <> 'P' OR o_orderkey % 2 = 0 THEN o_totalprice + o_orderkey % 3 * 0.5 END AS repair FROM orders),
l AS (SELECT g, 'official' AS method, official AS v, official - official AS d FROM v UNION ALL SELECT g, 'repair', repair, repair - official FROM v)
SELECT g AS generator, method, count(*) AS expected, count(v) AS defined, count(*) - count(v) AS undefined, round(avg(v), 4) AS mean_defined, CASE WHEN count(v) = count(*) THEN round(avg(v), 4) END AS mean_full,
       count(d) AS common, round(avg(d), 4) AS mean_delta, round(quantile_cont(d, 0.5), 4) AS median_delta, count_if(abs(d) > 1e-12) AS changed FROM l GROUP BY GROUPING SETS ((method, g), (method))""")
def natural_population(spark, d):  # K19
    o = read(spark, d, "orders")
    official = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
    repair = F.when((F.col("o_orderstatus") != "P") | (F.col("o_orderkey") % 2 == 0), F.col("o_totalprice") + F.col("o_orderkey") % 3 * 0.5)
    return Q.natural_population(o.select(F.col("o_orderpriority").alias("generator"), official.alias("official"), repair.alias("repair")), "generator", ["official", "repair"])


@query(f"""WITH {ORDERS_SQL}, r AS (SELECT o_orderpriority, count(*) AS total, count(score) AS defined FROM o GROUP BY 1)
SELECT o_orderpriority, 'defined' AS field, (defined + 1)::DOUBLE AS published, defined::DOUBLE AS fresh FROM r WHERE o_orderpriority = '1-URGENT'""")
def recomputed_report(spark, d):  # K20: one published figure is off by one
    s = K.coverage_summary(scored_orders(spark, d), ["o_orderpriority"])
    off = (F.col("o_orderpriority") == "1-URGENT").cast("int")
    return C.recomputed(s.withColumn("defined", F.col("defined") + off), s, ["o_orderpriority"], ["total", "defined", "coverage"])
