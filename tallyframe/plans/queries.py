"""Queries over the driver's tables, one for each operator family, and their SQL.

Each key has a builder here and a DuckDB statement of the same meaning. The survey's
operator ids stand in the comments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.functions import scores as S
from tallyframe.functions import text as T
from tallyframe.operators import contracts as C
from tallyframe.operators import dataprep as D
from tallyframe.operators import relational as R
from tallyframe.operators import stats as K
from tallyframe.operators.quantiles import exact_quantiles
from tallyframe.plans.registry import QUERIES, SQL, query, read, spread  # noqa: F401
from tallyframe.sources.session import ensure_checkpoint_dir

# ---- pairs: prompt = brand, model = line number mod 4 ------------------------------------

PAIRS_SQL = """
v AS (SELECT p_brand AS prompt, l_linenumber % 4 AS model, round(avg(l_discount), 6) AS score, round(avg(l_tax), 3) AS taste
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
pairs AS (SELECT a.prompt, a.model AS model_a, b.model AS model_b, a.score AS score_a, b.score AS score_b,
                 CASE WHEN a.taste > b.taste THEN 1.0::DOUBLE WHEN a.taste < b.taste THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS label,
                 CASE WHEN ('0x' || substr(sha256('7:' || a.prompt), 1, 8))::BIGINT % 2 = 0 THEN 'dev' ELSE 'test' END AS split
          FROM v a JOIN v b ON a.prompt = b.prompt AND a.model < b.model)"""


def scored_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Model pairs of each prompt with both scores, a label and a split."""
    li = read(spark, d, "lineitem", "l_partkey", "l_linenumber", "l_discount", "l_tax")
    joined = li.join(read(spark, d, "part", "p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    v = joined.groupBy(F.col("p_brand").alias("prompt"), (F.col("l_linenumber") % 4).alias("model")).agg(F.round(F.avg("l_discount"), 6).alias("score"), F.round(F.avg("l_tax"), 3).alias("taste"))
    p = R.unordered_pairs(v, ["prompt"], "model", ["score", "taste"])
    label = S.outcome(F.col("taste_a") - F.col("taste_b"), 0.0)
    split = F.when(T.hash_int(F.concat(F.lit("7:"), "prompt")) % 2 == 0, "dev").otherwise("test")
    return p.select("prompt", "model_a", "model_b", "score_a", "score_b", label.alias("label"), split.alias("split"))


MARGIN_SQL = """
dev AS (SELECT score_a - score_b AS d, label FROM pairs WHERE split = 'dev'),
cand AS (SELECT DISTINCT abs(d) AS m FROM dev UNION SELECT 0.0),
tried AS (SELECT m, avg(CASE WHEN (CASE WHEN abs(d) <= m THEN 0.5 WHEN d > 0 THEN 1.0 ELSE 0.0 END) = label THEN 1.0 ELSE 0.0 END) AS acc FROM cand, dev GROUP BY m),
best AS (SELECT round(min(m), 9) AS margin, round(max(acc), 6) AS dev_accuracy FROM tried WHERE acc >= (SELECT max(acc) FROM tried) - 1e-12)"""


@query(f"WITH {PAIRS_SQL}, {MARGIN_SQL} SELECT margin, dev_accuracy FROM best")
def pairs_tie_margin(spark, d):  # K02, G12
    return K.tie_margin(scored_pairs(spark, d).filter("split = 'dev'"))


@query(f"""WITH {PAIRS_SQL}, {MARGIN_SQL}
SELECT split, count(*) AS total, count(score_a - score_b) AS valid,
       round(avg(CASE WHEN (CASE WHEN abs(score_a - score_b) <= margin THEN 0.5 WHEN score_a > score_b THEN 1.0 ELSE 0.0 END) = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM pairs, best GROUP BY split""")
def pairs_accuracy(spark, d):  # K01, D12: the margin of the dev split on both splits
    ensure_checkpoint_dir(spark)
    p = scored_pairs(spark, d).checkpoint()  # read for the margin, and again under it
    margin = K.tie_margin(p.filter("split = 'dev'")).select("margin")  # one row
    return K.pair_accuracy(p.crossJoin(F.broadcast(margin)), ["split"], F.col("margin"))


WIN_SQL = f"""WITH {PAIRS_SQL},
o AS (SELECT *, CASE WHEN score_a > score_b THEN 1.0 WHEN score_a < score_b THEN 0.0 ELSE 0.5 END AS p FROM pairs),
r AS (SELECT model_a AS model, p, label AS l FROM o UNION ALL SELECT model_b, 1 - p, 1 - label FROM o),
w AS (SELECT model, count(*) AS n, round(avg(p), 6) AS win_ratio, round(avg(l), 6) AS label_ratio FROM r GROUP BY model)"""


@query(f"{WIN_SQL} SELECT * FROM w")
def pairs_win_ratio(spark, d):  # F24
    return K.win_ratios(scored_pairs(spark, d))


@query(f"{WIN_SQL} SELECT round(corr(win_ratio, label_ratio), 5) AS pearson FROM w")
def pairs_model_pearson(spark, d):  # F25, K18
    return K.win_ratios(scored_pairs(spark, d)).agg(F.round(K.pearson("win_ratio", "label_ratio"), 5).alias("pearson"))


@query(f"""WITH {PAIRS_SQL},
x AS (SELECT row_number() OVER () AS i, score_a - score_b AS x, label AS y FROM pairs),
s AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y)) AS s, sum(CASE WHEN a.x = b.x THEN 1 ELSE 0 END) AS tx,
             sum(CASE WHEN a.y = b.y THEN 1 ELSE 0 END) AS ty, count(*) AS n FROM x a JOIN x b ON a.i < b.i)
SELECT round(s / sqrt((n - tx)::DOUBLE * (n - ty)), 6) AS tau_b FROM s""")
def pairs_kendall(spark, d):  # F25
    p = scored_pairs(spark, d).select((F.col("score_a") - F.col("score_b")).alias("x"), F.col("label").alias("y"))
    return K.kendall_tau_b(p, "x", "y", flat=float("nan"))


@query(f"""WITH {PAIRS_SQL},
c AS (SELECT prompt, (score_a - score_b) * (2 * label - 1) AS margin, label FROM pairs)
SELECT count_if(label <> 0.5) AS ordered, count_if(label = 0.5) AS tied,
       round(avg(CASE WHEN label <> 0.5 THEN CASE WHEN margin > 0 THEN 1.0 WHEN margin = 0 THEN 0.5 ELSE 0.0 END END), 6) AS concordance,
       (SELECT round(avg(abs(score_a - score_b)), 9) FROM pairs WHERE label = 0.5) AS tie_gap FROM c""")
def pairs_concordance(spark, d):  # K11
    p = scored_pairs(spark, d)
    margin = (F.col("score_a") - F.col("score_b")) * (2 * F.col("label") - 1)
    ordered = F.col("label") != 0.5
    return p.agg(F.count_if(ordered).alias("ordered"), F.count_if(~ordered).alias("tied"), F.round(F.avg(F.when(ordered, F.when(margin > 0, 1.0).when(margin == 0, 0.5).otherwise(0.0))), 6).alias("concordance"), F.round(F.avg(F.when(~ordered, F.abs(F.col("score_a") - F.col("score_b")))), 9).alias("tie_gap"))


# ---- coverage and status: an order is a clip ----------------------------------------------

ORDERS_SQL = """o AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'failed' ELSE 'unsupported' END AS status,
                 CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS score FROM orders)"""


def scored_orders(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "failed").otherwise("unsupported")
    o = o.withColumn("status", status)
    return o.withColumn("score", S.finite_score(F.col("o_totalprice"), F.col("status")))


@query(f"""WITH {ORDERS_SQL}
SELECT o_orderpriority, count(*) AS total, count(score) AS defined, round(count(score) / count(*), 6) AS coverage,
       round(avg(score), 2) AS observed_subset_mean, CASE WHEN count(score) = count(*) THEN round(avg(score), 2) END AS complete_mean
FROM o GROUP BY o_orderpriority""")
def coverage_summary(spark, d):  # F02, F01, D13
    return K.coverage_summary(scored_orders(spark, d), ["o_orderpriority"], digits=2)


@query(f"WITH {ORDERS_SQL} SELECT o_orderpriority, status, count(*) AS n FROM o GROUP BY 1, 2")
def status_counts(spark, d):  # F19
    return scored_orders(spark, d).groupBy("o_orderpriority", "status").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT o_custkey, avg(CASE WHEN o_orderpriority LIKE '1%' THEN o_totalprice END) AS a, avg(CASE WHEN o_orderpriority LIKE '2%' THEN o_totalprice END) AS b,
                       avg(CASE WHEN o_orderpriority LIKE '3%' THEN o_totalprice END) AS c, avg(CASE WHEN o_orderpriority LIKE '4%' THEN o_totalprice END) AS d FROM orders GROUP BY o_custkey)
SELECT (SELECT count(*) FROM c) AS planned, count(*) AS complete, round(avg(a), 2) AS origin_base, round(avg(b), 2) AS origin_cf, round(avg(c), 2) AS repair_base, round(avg(d), 2) AS repair_cf
FROM c WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL""")
def four_cell_means(spark, d):  # F28, E06: only rows with all four cells enter the means
    o = read(spark, d, "orders", "o_custkey", "o_orderpriority", "o_totalprice")
    cells = {n: F.avg(F.when(F.col("o_orderpriority").startswith(str(i + 1)), F.col("o_totalprice"))) for i, n in enumerate(("origin_base", "origin_cf", "repair_base", "repair_cf"))}
    per = o.groupBy("o_custkey").agg(*(c.alias(n) for n, c in cells.items()))
    whole = F.col("origin_base").isNotNull() & F.col("origin_cf").isNotNull() & F.col("repair_base").isNotNull() & F.col("repair_cf").isNotNull()
    return per.agg(F.count(F.lit(1)).alias("planned"), F.count_if(whole).alias("complete"), *(F.round(F.avg(F.when(whole, F.col(n))), 2).alias(n) for n in cells))


@query("""WITH v AS (SELECT l_orderkey, count_if(l_returnflag = 'R') AS hits, count(*) AS frames FROM lineitem GROUP BY 1)
SELECT count(*) AS videos, round(sum(hits) / sum(frames), 6) AS frame_weighted, round(avg(hits / frames), 6) AS equal_video FROM v""")
def video_means(spark, d):  # F03, F04, F06
    v = read(spark, d, "lineitem", "l_orderkey", "l_returnflag").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("hits"), F.count(F.lit(1)).alias("frames"))
    return v.agg(F.count(F.lit(1)).alias("videos"), F.round(F.sum("hits") / F.sum("frames"), 6).alias("frame_weighted"), F.round(F.avg(F.col("hits") / F.col("frames")), 6).alias("equal_video"))


@query("""WITH s AS (SELECT p_type, p_brand, avg(p_retailprice) AS m, count(*) AS n FROM part GROUP BY 1, 2),
k AS (SELECT count(DISTINCT p_brand) AS k FROM part)
SELECT p_type, count(*) AS strata, CASE WHEN count(*) = (SELECT k FROM k) THEN round(avg(m), 4) END AS macro_mean FROM s GROUP BY p_type""")
def macro_mean(spark, d):  # null if a stratum is empty
    p = read(spark, d, "part", "p_type", "p_brand", "p_retailprice")
    k = p.agg(F.count_distinct("p_brand").alias("k"))
    s = p.groupBy("p_type", "p_brand").agg(F.avg("p_retailprice").alias("m"))
    out = s.groupBy("p_type").agg(F.count(F.lit(1)).alias("strata"), F.avg("m").alias("m")).crossJoin(F.broadcast(k))
    return out.select("p_type", "strata", F.when(F.col("strata") == F.col("k"), F.round("m", 4)).alias("macro_mean"))


@query("""SELECT coalesce(o_orderpriority, 'all') AS priority, coalesce(o_orderstatus, 'all') AS status, count(*) AS n, round(avg(o_totalprice), 2) AS mean
FROM orders GROUP BY GROUPING SETS ((), (o_orderpriority), (o_orderstatus), (o_orderpriority, o_orderstatus))""")
def grouping_report(spark, d):  # F22
    o, p, t = read(spark, d, "orders", "o_orderpriority", "o_orderstatus", "o_totalprice"), F.col("o_orderpriority"), F.col("o_orderstatus")
    sets = o.groupingSets([[], [p], [t], [p, t]], p, t).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean"))
    return sets.select(F.coalesce(p, F.lit("all")).alias("priority"), F.coalesce(t, F.lit("all")).alias("status"), "n", "mean")


@query("""SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.05), 4) AS q05, round(quantile_cont(c_acctbal, 0.25), 4) AS q25, round(quantile_cont(c_acctbal, 0.5), 4) AS q50,
       round(quantile_cont(c_acctbal, 0.75), 4) AS q75, round(quantile_cont(c_acctbal, 0.95), 4) AS q95, max(c_acctbal) AS most FROM customer GROUP BY 1""")
def quantile_report(spark, d):  # F21
    q = {f"q{int(100 * x):02d}": x for x in (0.05, 0.25, 0.5, 0.75, 0.95)}
    c = read(spark, d, "customer", "c_mktsegment", "c_acctbal")
    most = c.groupBy("c_mktsegment").agg(F.max("c_acctbal").alias("most"))
    return exact_quantiles(c, ["c_mktsegment"], "c_acctbal", q).select("c_mktsegment", *(F.round(n, 4).alias(n) for n in q)).join(most, "c_mktsegment")


# ---- paired designs: base = supplier, family = return flag, level = line number ------------

GRID_SQL = """g AS (SELECT l_suppkey AS base, l_returnflag AS family, l_linenumber AS level, round(avg(l_extendedprice), 6) AS score FROM lineitem GROUP BY 1, 2, 3)"""


def level_grid(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem", "l_suppkey", "l_returnflag", "l_linenumber", "l_extendedprice")
    return li.groupBy(F.col("l_suppkey").alias("base"), F.col("l_returnflag").alias("family"), F.col("l_linenumber").alias("level")).agg(F.round(F.avg("l_extendedprice"), 6).alias("score"))


@query(f"""WITH {GRID_SQL}
SELECT a.base, a.family, a.level, round(a.score - b.score, 3) AS delta FROM g a LEFT JOIN g b ON a.base = b.base AND a.level = b.level AND b.family = 'N'""")
def paired_delta(spark, d):  # E05
    out = R.to_baseline(level_grid(spark, d), ["base", "level"], "family", "N", "score")
    return out.select("base", "family", "level", F.round("delta", 3).alias("delta"))


@query(f"""WITH {GRID_SQL}
SELECT b.base, f.family, l.level FROM (SELECT DISTINCT base FROM g) b, (SELECT DISTINCT family FROM g) f, (SELECT DISTINCT level FROM g) l
ANTI JOIN g ON g.base = b.base AND g.family = f.family AND g.level = l.level""")
def grid_completeness(spark, d):  # E09, L03, E08
    return R.grid_gaps(level_grid(spark, d), ["base", "family", "level"], [["base"], ["family"], ["level"]])


@query(f"""WITH {GRID_SQL}, n AS (SELECT base, family, level, score, lead(score) OVER (PARTITION BY base, family ORDER BY level) AS nxt, lead(level) OVER (PARTITION BY base, family ORDER BY level) AS nl FROM g)
SELECT base, family, count(*) AS levels, count_if(nl IS NOT NULL AND nxt > score) AS rising, coalesce(bool_and(nxt > score) FILTER (nl IS NOT NULL), false) AS monotonic FROM n GROUP BY 1, 2""")
def ladder_ordering(spark, d):  # G10, G11
    w = Window.partitionBy("base", "family").orderBy("level")
    up = level_grid(spark, d).withColumn("up", F.lead("score").over(w) > F.col("score"))
    return up.groupBy("base", "family").agg(F.count(F.lit(1)).alias("levels"), F.count_if("up").alias("rising"), F.coalesce(F.every("up"), F.lit(False)).alias("monotonic"))


@query(f"""WITH {GRID_SQL},
p AS (SELECT base, level, max(CASE WHEN family = 'N' THEN score END) AS a, max(CASE WHEN family = 'R' THEN score END) AS b FROM g GROUP BY 1, 2)
SELECT level, count(*) AS pairs, count(a + b) AS complete, round(avg(b - a), 4) AS mean_delta, round(avg(abs(b - a)), 4) AS mae, round(min(b - a), 4) AS largest_drop,
       round(max(b - a), 4) AS largest_rise, round(stddev_pop(b - a), 4) AS sd FROM p GROUP BY level""")
def paired_arms(spark, d):  # K12, E06
    arms = level_grid(spark, d).groupBy("base", "level").agg(*(F.max(F.when(F.col("family") == f, F.col("score"))).alias(n) for f, n in (("N", "a"), ("R", "b"))))
    x = F.col("b") - F.col("a")
    r = lambda c: F.round(c, 4)
    return arms.groupBy("level").agg(F.count(F.lit(1)).alias("pairs"), F.count(x).alias("complete"), r(F.avg(x)).alias("mean_delta"), r(F.avg(F.abs(x))).alias("mae"), r(F.min(x)).alias("largest_drop"), r(F.max(x)).alias("largest_rise"), r(F.stddev_pop(x)).alias("sd"))


@query(f"""WITH {GRID_SQL}, t AS (SELECT base, family, level, score > 38000 AS hi FROM g),
n AS (SELECT *, lead(hi) OVER (PARTITION BY base, family ORDER BY level) AS nx FROM t)
SELECT family, count_if(NOT hi AND nx) AS zero_to_one, count_if(hi AND NOT nx) AS one_to_zero, count_if(nx IS NOT NULL) AS steps,
       round(count_if(hi <> nx) / count_if(nx IS NOT NULL), 6) AS change_rate FROM n GROUP BY family""")
def transition_counts(spark, d):  # F29
    w = Window.partitionBy("base", "family").orderBy("level")
    t = level_grid(spark, d).select("base", "family", "level", (F.col("score") > 38000).alias("hi"))
    t = t.withColumn("nx", F.lead("hi").over(w))
    return t.groupBy("family").agg(F.count_if(~F.col("hi") & F.col("nx")).alias("zero_to_one"), F.count_if(F.col("hi") & ~F.col("nx")).alias("one_to_zero"), F.count_if(F.col("nx").isNotNull()).alias("steps"), F.round(F.count_if(F.col("hi") != F.col("nx")) / F.count_if(F.col("nx").isNotNull()), 6).alias("change_rate"))


# ---- vectors: clip = label, frame = order of vec_id -----------------------------------------

@query("""WITH f AS (SELECT label, vec_id, embedding::DOUBLE[] AS e, lag(embedding::DOUBLE[]) OVER w AS p, first_value(embedding::DOUBLE[]) OVER w AS a FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
s AS (SELECT label, greatest(0, list_cosine_similarity(e, p)) AS sp, greatest(0, list_cosine_similarity(e, a)) AS sa FROM f WHERE p IS NOT NULL)
SELECT label, count(*) AS steps, round(avg((sp + sa) / 2), 5) AS consistency FROM s GROUP BY label""")
def temporal_consistency(spark, d):  # F11, G01, G02, D06
    w = Window.partitionBy("label").orderBy("vec_id")
    e = read(spark, d, "embeddings").withColumns({"p": F.lag("embedding").over(w), "a": F.first("embedding").over(w.rowsBetween(Window.unboundedPreceding, 0))}).filter("p is not null")
    zero = F.lit(0.0)
    both = (F.greatest(zero, S.cosine(F.col("embedding"), F.col("p"))) + F.greatest(zero, S.cosine(F.col("embedding"), F.col("a")))) / 2
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("steps"), F.round(F.avg(both), 5).alias("consistency"))


@query("""WITH u AS (SELECT label, vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
n AS (SELECT label, vec_id, sqrt(sum(x * x)) AS norm FROM u GROUP BY 1, 2),
c AS (SELECT label, i, sum(x / norm) AS s, sum((x / norm) * (x / norm)) AS q FROM u JOIN n USING (label, vec_id) GROUP BY 1, 2),
k AS (SELECT label, count(*) AS frames FROM embeddings GROUP BY 1)
SELECT label, any_value(frames) AS frames, round((sum(s * s) - sum(q)) / (any_value(frames) * (any_value(frames) - 1)), 5) AS all_pairs FROM c JOIN k USING (label) GROUP BY label""")
def all_pairs_consistency(spark, d):  # the mean over all pairs from the sum of unit vectors, without pairs
    e = read(spark, d, "embeddings", "label", "vec_id", "embedding")
    norm = F.sqrt(S.dot(F.col("embedding"), F.col("embedding")))
    u = e.select("label", F.posexplode(F.transform("embedding", lambda x: x.cast("double") / norm)).alias("i", "x"))
    c = u.groupBy("label", "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count(F.lit(1)).alias("n"))
    t = F.max("n")
    return c.groupBy("label").agg(t.alias("frames"), F.round((F.sum(F.col("s") * F.col("s")) - F.sum("q")) / (t * (t - 1)), 5).alias("all_pairs"))


@query("""WITH u AS (SELECT label, vec_id % 3 + 1 AS w, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
p AS (SELECT label, i, sum(w * x) / sum(w) AS m FROM u GROUP BY 1, 2)
SELECT label, count(*) AS dims, round(sqrt(sum(m * m)), 5) AS norm, round(max(m), 5) AS most FROM p GROUP BY label""")
def weighted_pool(spark, d):  # F13
    u = read(spark, d, "embeddings").select("label", (F.col("vec_id") % 3 + 1).alias("w"), F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    p = u.groupBy("label", "i").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m"))
    return p.groupBy("label").agg(F.count(F.lit(1)).alias("dims"), F.round(F.sqrt(F.sum(F.col("m") * F.col("m"))), 5).alias("norm"), F.round(F.max("m"), 5).alias("most"))


@query("""WITH a AS (SELECT label, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
t AS (SELECT label, vec_id AS i, e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM a),
c AS (SELECT label, max(e) FILTER (k = 1) AS c1, max(e) FILTER (k = 2) AS c2, max(e) FILTER (k = 3) AS c3 FROM t GROUP BY 1),
s AS (SELECT vec_id, [list_cosine_similarity(e, c1), list_cosine_similarity(e, c2), list_cosine_similarity(e, c3)] AS s FROM a JOIN c USING (label))
SELECT vec_id, round(0.5 * list_avg(s) + 0.5 * list_min(s), 5) AS blended FROM s""")
def condition_blend(spark, d):  # D07, D06, E19
    e = read(spark, d, "embeddings", "label", "vec_id", "embedding")
    k = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    c = e.withColumn("k", k).filter("k <= 3").groupBy("label").agg(*(F.max(F.when(F.col("k") == i, F.col("embedding"))).alias(f"c{i}") for i in (1, 2, 3)))
    s = F.array(*(S.cosine(F.col("embedding"), F.col(f"c{i}")) for i in (1, 2, 3)))
    return e.join(c, "label").select("vec_id", F.round(S.condition_blend(s), 5).alias("blended"))


@query("""WITH a AS (SELECT vec_id, label, list_sum(embedding::DOUBLE[]) AS ref, list_sum(list_transform(embedding, lambda x: round(x::DOUBLE, 4))) AS cand FROM embeddings)
SELECT label, count(*) AS rows, count_if(abs(cand - ref) <= greatest(1e-6, 0.01 * abs(ref))) AS passed, bool_and(abs(cand - ref) <= greatest(1e-6, 0.01 * abs(ref))) AS gate FROM a GROUP BY label""")
def agreement_gate(spark, d):  # F27, L08
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    e = read(spark, d, "embeddings").select("label", total(F.transform("embedding", lambda x: x.cast("double"))).alias("ref"), total(F.transform("embedding", lambda x: F.round(x.cast("double"), 4))).alias("cand"))
    ok = F.abs(F.col("cand") - F.col("ref")) <= F.greatest(F.lit(1e-6), 0.01 * F.abs("ref"))
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.count_if(ok).alias("passed"), F.every(ok).alias("gate"))


# ---- sequences: clip = user, frame = event ----------------------------------------------------

STEPS_SQL = """s AS (SELECT user_id, event_id, ts, event_type, value, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS dt, value - lag(value) OVER w AS dv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def steps(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = read(spark, d, "events", "user_id", "event_id", "ts", "event_type", "value").withColumn("us", us)
    return e.withColumns({"dt": F.col("us") - F.lag("us").over(w), "dv": F.col("value") - F.lag("value").over(w)}).drop("us")


@query(f"""WITH {STEPS_SQL}
SELECT user_id, count(*) AS steps, round(sum(abs(dv) * dt) / sum(dt), 5) AS weighted, round(sum(CASE WHEN abs(dv) > 10 THEN dt ELSE 0 END) / sum(dt), 6) AS significant_share FROM s WHERE dt > 0 GROUP BY 1""")
def duration_weighted(spark, d):  # F14
    s = steps(spark, d).filter("dt > 0")
    dt = F.col("dt").cast("double")
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("steps"), F.round(F.sum(F.abs("dv") * dt) / F.sum(dt), 5).alias("weighted"), F.round(F.sum(F.when(F.abs("dv") > 10, dt).otherwise(0.0)) / F.sum(dt), 6).alias("significant_share"))


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, any_value(n) AS n, round(avg(value), 5) AS top_mean FROM r WHERE k <= greatest(1, floor(n * 0.05)) GROUP BY 1""")
def top_fraction_mean(spark, d):  # F15
    by = Window.partitionBy("user_id")
    r = read(spark, d, "events", "user_id", "event_id", "value").withColumns({"k": F.row_number().over(by.orderBy(F.desc("value"), "event_id")), "n": F.count(F.lit(1)).over(by)})
    return r.filter(F.col("k") <= F.greatest(F.lit(1), F.floor(F.col("n") * 0.05))).groupBy("user_id").agg(F.first("n").alias("n"), F.round(F.avg("value"), 5).alias("top_mean"))


@query("""SELECT event_type, count(*) AS n, round(avg(value), 5) AS mean, round(median(value), 5) AS median, max(value) AS most FROM events GROUP BY 1""")
def motion_statistics(spark, d):  # F16
    e = read(spark, d, "events", "event_type", "value")
    rest = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 5).alias("mean"), F.max("value").alias("most"))
    return rest.join(exact_quantiles(e, ["event_type"], "value", {"median": 0.5}), "event_type").withColumn("median", F.round("median", 5))


@query(f"""WITH {STEPS_SQL}, p AS (SELECT event_type, dt / 1e6 AS x, abs(dv) AS y FROM s WHERE dt > 0 AND abs(dv) > 0)
SELECT event_type, count(*) AS n, CASE WHEN count(DISTINCT x) >= 2 THEN round(regr_slope(ln(y), ln(x)), 5) END AS exponent FROM p GROUP BY 1""")
def power_law_fit(spark, d):  # F17
    p = steps(spark, d).select("event_type", (F.col("dt") / 1e6).alias("x"), F.abs("dv").alias("y"))
    return K.power_law(p, ["event_type"], "x", "y").withColumn("exponent", F.round("exponent", 5))


@query("""WITH e AS (SELECT user_id, ts, event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS v FROM events),
f AS (SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS b,
             first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM e)
SELECT event_id, coalesce(b, a) AS filled FROM f""")
def ffill_bfill(spark, d):  # G03
    e = read(spark, d, "events", "user_id", "ts", "event_id", "value").withColumn("v", F.when(F.col("event_id") % 5 != 0, F.col("value")))
    return R.forward_backward_fill(e, ["user_id"], ["ts", "event_id"], "v").select("event_id", "filled")


@query("""WITH e AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT user_id, run::BIGINT AS run, event_type, count(*) AS n, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM i GROUP BY 1, 2, 3""")
def state_runs(spark, d):  # G09
    r = R.runs(read(spark, d, "events", "user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return r.select("user_id", "run", "event_type", "n", us("first_at").alias("first_us"), us("last_at").alias("last_us"))


@query("""WITH n AS (SELECT user_id, count(*) AS frames FROM events GROUP BY 1)
SELECT user_id, frames, least(4, greatest(1, ceil(frames / 8)))::INT AS windows, array_to_string([least(frames - 1, floor((floor(i * frames / 4.0) + floor((i + 1) * frames / 4.0) - 1) / 2))::BIGINT FOR i IN [0, 1, 2, 3]], ',') AS middles FROM n""")
def clip_sampling(spark, d):  # G05, G06
    n = read(spark, d, "events", "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("frames"))
    return n.select("user_id", "frames", R.count_windows(F.col("frames")).alias("windows"), F.array_join(R.middle_samples(F.col("frames"), 4), ",").alias("middles"))


@query("""WITH b AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, value FROM events)
SELECT event_id, round((SELECT median(x.value) FROM b x WHERE x.user_id = b.user_id AND x.k BETWEEN b.k - 2 AND b.k + 2), 6) AS smooth FROM b""")
def rolling_median(spark, d):  # G13
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 2)
    e = read(spark, d, "events", "user_id", "event_id", "ts", "value")
    return e.select("event_id", F.round(F.percentile("value", F.lit(0.5)).over(w), 6).alias("smooth"))


@query("""WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v FROM events),
p AS (SELECT *, last_value(v IGNORE NULLS) OVER a AS pv, last_value(CASE WHEN v IS NOT NULL THEN k END IGNORE NULLS) OVER a AS pk, first_value(v IGNORE NULLS) OVER b AS nv, first_value(CASE WHEN v IS NOT NULL THEN k END IGNORE NULLS) OVER b AS nk FROM e
      WINDOW a AS (PARTITION BY user_id ORDER BY k ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY user_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN nk - pk - 1 <= 2 THEN pv + (nv - pv) * (k - pk) / (nk - pk) END, 6) AS lerp FROM p""")
def gap_interpolation(spark, d):  # G14: gaps of two rows at most
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, d, "events", "user_id", "event_id", "ts", "value").withColumns({"k": F.row_number().over(by), "v": F.when(F.col("event_id") % 3 != 0, F.col("value"))})
    mark = F.when(F.col("v").isNotNull(), F.col("k"))
    order = Window.partitionBy("user_id").orderBy("k")
    before, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    e = e.withColumns({"pv": F.last("v", True).over(before), "pk": F.last(mark, True).over(before), "nv": F.first("v", True).over(after), "nk": F.first(mark, True).over(after)})
    lerp = F.col("pv") + (F.col("nv") - F.col("pv")) * (F.col("k") - F.col("pk")) / (F.col("nk") - F.col("pk"))
    return e.select("event_id", F.round(F.coalesce("v", F.when(F.col("nk") - F.col("pk") - 1 <= 2, lerp)), 6).alias("lerp"))


@query("""SELECT user_id, arg_max(event_id, {'m': value, 'k': -event_id}) AS anchor, max(value) AS peak FROM events GROUP BY 1""")
def anchor_choice(spark, d):  # G15, G04
    return read(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("anchor"), F.max("value").alias("peak"))


@query("""WITH g AS (SELECT user_id, unnest(range(0, 6)) AS i, min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events GROUP BY user_id),
t AS (SELECT user_id, i, lo + i * ((hi - lo) // 5) AS at FROM g)
SELECT t.user_id, t.i::INT AS i, (SELECT e.event_id FROM events e WHERE e.user_id = t.user_id AND epoch_us(e.ts) <= t.at ORDER BY e.ts DESC, e.event_id DESC LIMIT 1) AS event_id FROM t""")
def asof_grid(spark, d):  # E14: the last event at or before each point of a time grid, in one sorted pass
    e = read(spark, d, "events", "user_id", "event_id", "ts").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    span = e.groupBy("user_id").agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    grid = span.select("user_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i"), "lo", "hi").select("user_id", "i", (F.col("lo") + F.col("i") * F.expr("(hi - lo) div 5")).alias("us"))
    both = e.select("user_id", "us", "event_id", F.lit(None).cast("int").alias("i")).unionByName(grid.select("user_id", "us", F.lit(None).cast("long").alias("event_id"), "i"))
    w = Window.partitionBy("user_id").orderBy("us", F.col("i").asc_nulls_first(), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("event_id", F.last("event_id", True).over(w)).filter("i is not null").select("user_id", "i", "event_id")


@query("""WITH s AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, value FROM events),
l AS (SELECT unnest([1, 2, 4]) AS lag)
SELECT l.lag::INT AS lag, count(*) AS n, round(avg(abs(b.value - a.value)), 5) AS chord FROM s a JOIN l ON true JOIN s b ON a.user_id = b.user_id AND b.k = a.k + l.lag GROUP BY 1""")
def lag_scaling(spark, d):  # E15
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, d, "events", "user_id", "event_id", "ts", "value")
    e = e.withColumns({f"c{k}": F.abs(F.lead("value", k).over(w) - F.col("value")) for k in (1, 2, 4)})
    e = e.select(F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"c{k}").alias("chord")) for k in (1, 2, 4)))).alias("x")).select("x.*")
    return e.filter("chord is not null").groupBy("lag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("chord"), 5).alias("chord"))


# ---- text and data preparation -----------------------------------------------------------------


@query(r"""WITH t AS (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS n FROM documents),
w AS (SELECT doc_id, text, n, CASE WHEN n = '' THEN 0 ELSE len(string_split(n, ' ')) END AS words FROM t)
SELECT doc_id, words::INT AS words, length(text)::INT AS chars, len(regexp_extract_all(lower(n), '[a-z0-9]+'))::INT AS tokens,
       CASE WHEN words <= 14 THEN '1-14' WHEN words <= 49 THEN '15-49' WHEN words <= 99 THEN '50-99' WHEN words <= 200 THEN '100-200' WHEN words <= 400 THEN '201-400' ELSE '401+' END AS bucket FROM w""")
def text_lengths(spark, d):  # C01, C03, C04, C05
    t = F.col("text")
    words = T.word_count(t)
    counted = read(spark, d, "documents", "doc_id", "text").select("doc_id", words.alias("words"), T.char_count(t).alias("chars"), F.size(T.phrase_tokens(t)).alias("tokens"))
    return counted.withColumn("bucket", T.length_bucket(F.col("words")))


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def stem_sql(w: str) -> str:
    special = " ".join(f"WHEN {w} = '{a}' THEN '{b}'" for a, b in T.IRREGULAR.items())
    return f"""(CASE {special} WHEN {w} IN ({_quoted(T.SINGULAR_S)}) THEN {w}
 WHEN {w} LIKE '%ies' AND length({w}) > 4 THEN left({w}, length({w}) - 3) || 'y' WHEN {w} LIKE '%ves' AND length({w}) > 4 THEN left({w}, length({w}) - 3) || 'f'
 WHEN {w} LIKE '%ing' AND length({w}) > 5 THEN CASE WHEN length({w}) > 6 AND substr({w}, length({w}) - 3, 1) = substr({w}, length({w}) - 4, 1) AND substr({w}, length({w}) - 3, 1) NOT IN ('a', 'e', 'i', 'o', 'u') THEN left({w}, length({w}) - 4) ELSE left({w}, length({w}) - 3) END
 WHEN {w} LIKE '%es' AND NOT {w} LIKE '%ses' AND length({w}) > 3 THEN left({w}, length({w}) - 2) WHEN {w} LIKE '%s' AND NOT {w} LIKE '%ss' AND length({w}) > 3 THEN left({w}, length({w}) - 1) ELSE {w} END)"""


#: Words that the made-up prose seldom has, beside those it has.
STEM_WORDS = "people buses bus circus knives analysis adding seeing running boxes houses ponies glass thing falling leaves scarves business".split()


@query(f"""WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents UNION ALL SELECT unnest([{_quoted(STEM_WORDS)}])),
s AS (SELECT w, {stem_sql('w')} AS stem FROM t)
SELECT stem, count(*) AS n, count(DISTINCT w) AS forms FROM s GROUP BY stem""")
def stem_tokens(spark, d):  # C06
    t = read(spark, d, "documents", "text").select(F.explode(T.phrase_tokens(F.col("text"))).alias("w"))
    t = t.groupBy("w").agg(F.count(F.lit(1)).alias("k"))
    t = t.unionByName(spark.createDataFrame([(w, 1) for w in STEM_WORDS], "w string, k long"))
    return t.select("w", "k", T.stem(F.col("w")).alias("stem")).groupBy("stem").agg(F.sum("k").alias("n"), F.count_distinct("w").alias("forms"))


SPAN_SQL = f"""
s AS (SELECT *, lower(trim(regexp_replace(prompt, '\\s+', ' ', 'g'))) AS pn, lower(trim(trim(regexp_replace(phrase, '\\s+', ' ', 'g')), ' .,;:!?"''()[]{{}}')) AS qn FROM q),
z AS (SELECT *, list_transform(regexp_extract_all(pn, '[a-z0-9]+'), lambda w: {stem_sql('w')}) AS ps, list_transform(regexp_extract_all(qn, '[a-z0-9]+'), lambda w: {stem_sql('w')}) AS qs FROM s),
y AS (SELECT *, len(list_filter(qs, lambda x: list_contains(ps, x))) AS have FROM z),
support AS (SELECT *, CASE WHEN qn = '' THEN 'none' WHEN regexp_matches(' ' || pn || ' ', '[^a-z0-9]' || regexp_escape(qn) || '[^a-z0-9]') THEN 'exact' WHEN len(qs) = 0 THEN 'none'
       WHEN contains(' ' || array_to_string(ps, ' ') || ' ', ' ' || array_to_string(qs, ' ') || ' ') THEN 'morph' WHEN have = len(qs) THEN 'tokens'
       WHEN list_contains(ps, qs[-1]) AND have * 5 >= len(qs) * 3 THEN 'partial' ELSE 'none' END AS support FROM y)"""


@query(f"""WITH q AS (SELECT p_partkey, k, p_type || ' and the ' || p_name AS prompt, CASE k WHEN 0 THEN p_name WHEN 1 THEN p_type || 's' WHEN 2 THEN p_name || ' ' || p_type WHEN 3 THEN 'big ' || p_type || 's and ' || p_name ELSE '(' || substr(p_name, 1, 3) || ')' END AS phrase FROM part, range(5) AS r(k)),
{SPAN_SQL}
SELECT p_partkey, k::INT AS k, support FROM support""")
def span_support(spark, d):  # C07: the ladder of several phrases in a part's type and name
    p = spread(read(spark, d, "part", "p_partkey", "p_name", "p_type"), "p_partkey")
    name, kind = F.col("p_name"), F.col("p_type")
    phrases = F.array(name, F.concat(kind, F.lit("s")), F.concat_ws(" ", name, kind), F.concat(F.lit("big "), kind, F.lit("s and "), name), F.concat(F.lit("("), F.substring(name, 1, 3), F.lit(")")))
    rows = p.select("p_partkey", F.concat_ws(" and the ", kind, name).alias("prompt"), F.posexplode(phrases).alias("k", "phrase"))
    return rows.select("p_partkey", "k", T.span_support(F.col("prompt"), F.col("phrase")).alias("support"))


NAMES = ("(the %s)", "these two %s benches", "a stack of %s", "holding %s", "both the", "a pair of children near the %s", "%s")


@query(f"""WITH q AS (SELECT p_partkey, k, lower(trim(trim(replace([{_quoted(NAMES)}][k + 1], '%s', p_name)), ' .,;:!?"''()[]{{}}')) AS q FROM part, range({len(NAMES)}) AS r(k)),
b AS (SELECT *, string_split(regexp_replace(q, '^(?:(?:{'|'.join(T.DETERMINERS)})(?: |$))+', ''), ' ') AS ws FROM q),
h AS (SELECT *, ws[1:greatest(1, coalesce(list_min(list_filter([CASE WHEN ws[i] IN ({_quoted(T.HEAD_CUTS)}) THEN i - 1 END FOR i IN range(1, len(ws) + 1)], lambda x: x IS NOT NULL)), len(ws)))] AS hs FROM b)
SELECT p_partkey, k::INT AS k, CASE WHEN ws = [''] THEN q ELSE array_to_string(list_append(ws[1:-2], {stem_sql('ws[-1]')}), ' ') END AS entity,
       CASE WHEN ws = [''] THEN q ELSE array_to_string(list_append(hs[1:-2], {stem_sql('hs[-1]')}), ' ') END AS head FROM h""")
def entity_names(spark, d):  # C08, C09
    p = spread(read(spark, d, "part", "p_partkey", "p_name"), "p_partkey").select("p_partkey", F.posexplode(F.array(*(F.replace(F.lit(n), F.lit("%s"), F.col("p_name")) for n in NAMES))).alias("k", "q"))
    return p.select("p_partkey", "k", T.canonical_entity(F.col("q")).alias("entity"), T.head_noun(F.col("q")).alias("head"))


@query("""WITH c AS (SELECT conv_id, list(role || ' .' ORDER BY turn) AS items FROM conversations GROUP BY 1)
SELECT conv_id, len(items)::INT - len(list_distinct(items))::INT AS dropped, array_to_string([x FOR x, i IN items IF list_position(items, x) = i], '|') AS kept FROM c""")
def distinct_in_order(spark, d):  # C10
    items = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat(x["role"], F.lit("  .")))
    c = read(spark, d, "conversations").groupBy("conv_id").agg(items.alias("items"))
    kept, dropped = T.dedup_in_order(F.col("items"))
    return c.select("conv_id", dropped.alias("dropped"), F.array_join(kept, "|").alias("kept"))


@query(r"""SELECT doc_id, substr(sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))), 1, 24) AS id, ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT % 5 AS bucket FROM documents""")
def hash_ids(spark, d):  # C11, H04
    doc = read(spark, d, "documents", "doc_id", "text")
    return doc.select("doc_id", F.left(F.sha2(F.lower(T.normalize_space(F.col("text"))), 256), F.lit(24)).alias("id"), (T.hash_int(F.concat(F.lit("7:"), F.col("doc_id").cast("string"))) % 5).alias("bucket"))


@query()
def unicode_keys(spark, d):  # C13, C14: Arrow functions, as case folding and NFKC are not built in
    t = read(spark, d, "documents", "doc_id", "text")
    return t.select("doc_id", F.sha2(T.casefold_key("text"), 256).alias("casefold"), F.sha2(T.nfkc_key("text"), 256).alias("nfkc"))


@query("""SELECT event_id, (props->>'$.k')::INT AS k, CASE WHEN (props->>'$.k') IS NULL THEN 'missing_k' WHEN (props->>'$.k')::INT < 0 THEN 'negative_k' ELSE 'ok' END AS code FROM events""")
def json_unwrap(spark, d):  # C19, C27
    k = F.get_json_object("props", "$.k").try_cast("int")
    return read(spark, d, "events", "event_id", "props").select("event_id", k.alias("k"), F.when(k.isNull(), "missing_k").when(k < 0, "negative_k").otherwise("ok").alias("code"))


@query("""WITH c AS (SELECT conv_id, turn, list_filter([CASE WHEN role NOT IN ('user', 'assistant', 'system') THEN 'bad_role' END, CASE WHEN trim(text) = '' OR text IS NULL THEN 'empty_text' END,
   CASE WHEN turn <> row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 THEN 'bad_turn' END, CASE WHEN length(text) > 400 THEN 'long_text' END], lambda x: x IS NOT NULL) AS codes FROM conversations)
SELECT conv_id, turn, array_to_string(codes, ',') AS codes FROM c""")
def validate_records(spark, d):  # C32: codes, never an exception
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    c = read(spark, d, "conversations").withColumn("n", n)
    bad = [(~F.col("role").isin("user", "assistant", "system"), "bad_role"), (F.col("text").isNull() | (F.trim("text") == ""), "empty_text"), (F.col("turn") != F.col("n"), "bad_turn"), (F.length("text") > 400, "long_text")]
    return c.select("conv_id", "turn", F.array_join(F.array(*(F.when(x, code) for x, code in bad)), ",").alias("codes"))


@query(r"""WITH k AS (SELECT doc_id, sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS k, source FROM documents)
SELECT k AS key, min(doc_id) AS doc_id, count(*) AS copies, count(DISTINCT source) AS sources FROM k GROUP BY k""")
def dedupe_exact(spark, d):  # I05, I07: combined before the shuffle, so a frequent text is no hot task
    k = F.sha2(F.lower(T.normalize_space(F.col("text"))), 256)
    return read(spark, d, "documents", "doc_id", "text", "source").select(k.alias("key"), "doc_id", "source").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.count_distinct("source").alias("sources"))


@query("""WITH r AS (SELECT sha256(text) AS key, quality AS label, doc_id FROM documents JOIN labels USING (doc_id)),
g AS (SELECT key, count(DISTINCT label) AS labels, min(doc_id) AS doc_id FROM r GROUP BY key)
SELECT g.key, g.doc_id, r.label FROM g JOIN r USING (key, doc_id) WHERE g.labels = 1""")
def dedupe_conflict(spark, d):  # I06, F31
    r = read(spark, d, "documents", "doc_id", "text").join(read(spark, d, "labels", "doc_id", "quality"), "doc_id").select(F.sha2("text", 256).alias("key"), F.col("quality").alias("label"), "doc_id")
    return R.conflict_free(r, "key", "label", "doc_id")


@query("""WITH s AS (SELECT source AS name, sha256(text) AS key FROM documents), u AS (SELECT DISTINCT name, key FROM s)
SELECT a.name AS set_a, b.name AS set_b, count(*) AS shared FROM u a JOIN u b ON a.key = b.key AND a.name < b.name GROUP BY 1, 2""")
def leakage_overlap(spark, d):  # I10, L06
    return R.overlap(read(spark, d, "documents", "source", "text").select(F.col("source").alias("name"), F.sha2("text", 256).alias("key")), "name", "key")


@query("""WITH g AS (SELECT DISTINCT source FROM documents), r AS (SELECT source, row_number() OVER (ORDER BY sha256('7:' || source), source) AS rank, count(*) OVER () AS k FROM g)
SELECT doc_id, source, CASE WHEN rank <= greatest(1, round(k * 20 / 100.0)) THEN 'dev' ELSE 'train' END AS side FROM documents JOIN r USING (source)""")
def group_split(spark, d):  # J04, M08
    return R.group_split(read(spark, d, "documents", "doc_id", "source"), "source", 20, 7).select("doc_id", "source", "side")


@query("SELECT doc_id FROM documents ORDER BY sha256('11:' || doc_id) LIMIT 50")
def hash_sample(spark, d):  # H01: the sample is the feature
    return R.hash_sample(read(spark, d, "documents", "doc_id"), "doc_id", 50, 11).select("doc_id")


@query("""SELECT source, lang, doc_id, pick FROM (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY sha256('5:' || doc_id), doc_id)::INT AS pick FROM documents) WHERE pick <= 2""")
def group_picks(spark, d):  # H02, H09: two of each group by hash
    return R.pick_by_hash(read(spark, d, "documents", "source", "lang", "doc_id"), ["source", "lang"], "doc_id", 2, 5)


@query("""WITH g AS (SELECT DISTINCT c_nationkey AS key FROM customer), r AS (SELECT key, row_number() OVER (ORDER BY sha256('3:' || key), key) AS k FROM g)
SELECT key, k::INT AS rank, CASE WHEN k <= 5 THEN 'dev' WHEN k <= 12 THEN 'probe' ELSE 'train' END AS role FROM r""")
def hash_roles(spark, d):  # H03
    g = read(spark, d, "customer").select(F.col("c_nationkey").alias("key")).distinct()
    k = F.row_number().over(Window.orderBy(F.sha2(F.concat(F.lit("3:"), F.col("key").cast("string")), 256), "key"))  # one row a nation
    return g.withColumn("rank", k).withColumn("role", F.when(F.col("rank") <= 5, "dev").when(F.col("rank") <= 12, "probe").otherwise("train"))


@query("""WITH u AS (SELECT o_custkey AS id, left(o_orderpriority, 1)::INT AS pri, o_orderkey AS seq, o_orderstatus AS v FROM orders)
SELECT id, pri, seq, v FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pri DESC, seq) AS rn FROM u) WHERE rn = 1""")
def upsert(spark, d):  # I01, I02: five sources, one of each priority; the last overrides
    o = read(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    part = lambda p: o.filter(F.col("o_orderpriority").startswith(str(p))).select(F.col("o_custkey").alias("id"), F.lit(p).alias("pri"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("v"))
    every = part(1)
    for p in (2, 3, 4, 5):
        every = every.unionByName(part(p))
    return R.upsert(every, "id", "pri", "seq")


@query("""SELECT 'missing' AS side, c_custkey AS id FROM customer ANTI JOIN orders ON o_custkey = c_custkey
UNION ALL SELECT 'extra', o_custkey FROM (SELECT DISTINCT o_custkey FROM orders) ANTI JOIN customer ON o_custkey = c_custkey""")
def coverage_difference(spark, d):  # I04, L02, E07, E08
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("id")).distinct()
    return c.join(o, "id", "left_anti").select(F.lit("missing").alias("side"), "id").unionByName(o.join(c, "id", "left_anti").select(F.lit("extra").alias("side"), "id"))


@query("SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY sha256(text)) AS component FROM documents")
def components(spark, d):  # J01, J02: documents and the texts they share, every id its own neighbour
    from tallyframe.sources.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    doc = read(spark, d, "documents", "doc_id", "text").select("doc_id", F.sha2("text", 256).alias("k"))
    first = doc.groupBy("k").agg(F.min("doc_id").alias("a"))
    edges = doc.join(first, "k").select("a", F.col("doc_id").alias("b"))
    return R.components(edges)


@query("""WITH j AS (SELECT l.quality AS gold, CASE WHEN d.n_chars >= 300 THEN 1 ELSE 0 END AS pred FROM labels l JOIN documents d USING (doc_id)),
c AS (SELECT x AS class, count_if(gold = x AND pred = x) AS tp, count_if(gold <> x AND pred = x) AS fp, count_if(gold = x AND pred <> x) AS fn FROM j, (VALUES (0), (1)) v(x) GROUP BY x)
SELECT class, tp, fp, fn, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 1.0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM c""")
def confusion_f1(spark, d):  # F18
    j = read(spark, d, "labels", "doc_id", "quality").join(read(spark, d, "documents", "doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("gold"), (F.col("n_chars") >= 300).cast("int").alias("pred"))
    j = j.select("gold", "pred", F.explode(F.array(F.lit(0), F.lit(1))).alias("class"))
    g, p = F.col("gold") == F.col("class"), F.col("pred") == F.col("class")
    c = j.groupBy("class").agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"))
    both = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return c.withColumn("f1", F.round(F.when(both == 0, 1.0).otherwise(2 * F.col("tp") / both), 6))


@query("""WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS s FROM conversations),
p AS (SELECT a.conv_id, a.turn, len(list_intersect(a.s, b.s)) AS tp, len(a.s) AS np, len(b.s) AS ng FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
m AS (SELECT *, CASE WHEN np > 0 THEN tp / np WHEN ng = 0 THEN 1.0 ELSE 0.0 END AS pr, CASE WHEN ng > 0 THEN tp / ng WHEN np = 0 THEN 1.0 ELSE 0.0 END AS re FROM p)
SELECT conv_id, turn, tp::INT AS tp, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0 END, 6) AS f1 FROM m""")
def set_prf1(spark, d):  # F18, I08
    t = read(spark, d, "conversations").select("conv_id", "turn", F.array_distinct(T.phrase_tokens(F.col("text"))).alias("p"))
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("p").alias("g"))
    m = K.set_prf1(t.join(nxt, ["conv_id", "turn"]), "p", "g")
    return m.select("conv_id", "turn", "tp", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("""WITH c AS (SELECT source, sum(n_chars)::DOUBLE AS s, count(*)::DOUBLE AS n FROM documents GROUP BY 1),
k AS (SELECT count(*) AS k, sum(s) AS ts, sum(n) AS tn FROM c), j AS (SELECT row_number() OVER (ORDER BY source) - 1 AS j, s, n FROM c),
d AS (SELECT b, ('0x' || substr(sha256('20:' || b || ':' || slot), 1, 8))::BIGINT % k AS j FROM range(200) r(b), k, range(0, (SELECT k FROM k)) q(slot)),
e AS (SELECT b, sum(s) / sum(n) AS r FROM d JOIN j USING (j) GROUP BY b)
SELECT k AS clusters, round(ts / tn, 6) AS estimate, round((SELECT quantile_cont(r, 0.025) FROM e), 6) AS low, round((SELECT quantile_cont(r, 0.975) FROM e), 6) AS high FROM k""")
def cluster_bootstrap(spark, d):  # K04, K10, R8
    return K.cluster_bootstrap(read(spark, d, "documents", "source", "n_chars"), "source", "n_chars", 200, 20)


@query("""SELECT round((sum(p * (below + q / 2)) / (sum(p) * sum(q))), 6) AS auc, sum(p)::BIGINT AS positives, sum(q)::BIGINT AS negatives FROM (
SELECT v, p, q, coalesce(sum(q) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
SELECT round(value) AS v, count_if(event_type = 'click') AS p, count_if(event_type <> 'click') AS q FROM events GROUP BY 1))""")
def auc_half_ties(spark, d):  # F26
    e = read(spark, d, "events", "event_type", "value").withColumn("v", F.round("value"))
    return K.auc_half_ties(e, F.col("event_type") == "click", "v")


@query("""WITH b AS (SELECT o_custkey, avg(o_totalprice) AS a, count(*) AS n FROM orders GROUP BY 1),
r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS rn FROM b)
SELECT round(corr(ra, rn), 5) AS spearman FROM r""")
def spearman_levels(spark, d):  # ranks from counts per distinct value, ties at the middle
    b = read(spark, d, "orders", "o_custkey", "o_totalprice").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("a"), F.count(F.lit(1)).alias("n"))
    return K.mid_rank(K.mid_rank(b, "a", "ra"), "n", "rn").agg(F.round(K.pearson("ra", "rn"), 5).alias("spearman"))


# ---- boxes: frame = order, detection = line ------------------------------------------------------

BOX_SQL = """b AS (SELECT l_orderkey AS id, l_linenumber AS det, l_partkey % 5 AS label, [(l_partkey % 97)::DOUBLE, (l_suppkey % 89)::DOUBLE, l_partkey % 97 + l_quantity + 1, l_suppkey % 89 + 10.0 * l_linenumber] AS box FROM lineitem)"""
IOU_SQL = """(CASE WHEN (a.box[3]-a.box[1])*(a.box[4]-a.box[2]) + (c.box[3]-c.box[1])*(c.box[4]-c.box[2]) - i > 0 THEN i / ((a.box[3]-a.box[1])*(a.box[4]-a.box[2]) + (c.box[3]-c.box[1])*(c.box[4]-c.box[2]) - i) ELSE 0.0 END)"""
INTER = "greatest(0, least(a.box[3], c.box[3]) - greatest(a.box[1], c.box[1])) * greatest(0, least(a.box[4], c.box[4]) - greatest(a.box[2], c.box[2]))"


def boxes(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    x, y = (F.col("l_partkey") % 97).cast("double"), (F.col("l_suppkey") % 89).cast("double")
    return li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("det"), (F.col("l_partkey") % 5).alias("label"), F.array(x, y, x + F.col("l_quantity") + 1, y + 10.0 * F.col("l_linenumber")).alias("box"))


@query(f"""WITH {BOX_SQL}, p AS (SELECT a.id, a.det AS a, c.det AS c, a.box AS abox, c.box AS cbox, {IOU_SQL.replace(' i ', f' ({INTER}) ').replace('THEN i', f'THEN ({INTER})').replace('- i', f'- ({INTER})')} AS iou FROM b a JOIN b c ON a.id = c.id AND a.det < c.det),
m AS (SELECT *, (cbox[1]+cbox[3])/2 - (abox[1]+abox[3])/2 AS dx, (cbox[2]+cbox[4])/2 - (abox[2]+abox[4])/2 AS dy FROM p)
SELECT id, count(*) AS pairs, round(max(iou), 6) AS most_iou, round(max(CASE WHEN abs(dx) > abs(dy) THEN CASE WHEN iou < 0.1 THEN 1.0 ELSE 0.1 / iou END ELSE 0.0 END), 6) AS beside,
       round(max(CASE WHEN abs(dx) > abs(dy) AND dx > 0 THEN CASE WHEN iou < 0.1 THEN 1.0 ELSE 0.1 / iou END ELSE 0.0 END), 6) AS left_of FROM m GROUP BY id""")
def spatial_scores(spark, d):  # D01-D04, E10, E11, F06
    p = R.unordered_pairs(boxes(spark, d), ["id"], "det", ["box"])
    a, c = F.col("box_a"), F.col("box_b")
    left = F.lit("left")
    return p.groupBy("id").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.max(S.box_iou(a, c)), 6).alias("most_iou"), F.round(F.max(S.position_score(left, a, c, False)), 6).alias("beside"), F.round(F.max(S.position_score(left, a, c, True)), 6).alias("left_of"))


@query(f"""WITH {BOX_SQL}, p AS (SELECT a.id, a.det, {IOU_SQL.replace(' i ', f' ({INTER}) ').replace('THEN i', f'THEN ({INTER})').replace('- i', f'- ({INTER})')} AS iou FROM b a JOIN b c ON a.id = c.id AND a.label = c.label AND abs(a.det - c.det) = 1),
f AS (SELECT id, det FROM p WHERE iou >= 0.5 GROUP BY 1, 2)
SELECT b.id, count(DISTINCT b.det) AS present, count(DISTINCT f.det) AS confirmed, round(count(DISTINCT f.det) / 7.0, 6) AS score FROM b LEFT JOIN f ON b.id = f.id AND b.det = f.det GROUP BY b.id""")
def object_confirmation(spark, d):  # E12, F09: a box counts if the same label stands there in a neighbouring frame
    b = boxes(spark, d)
    near = b.select("id", "label", F.explode(F.array(F.col("det") - 1, F.col("det") + 1)).alias("det"), F.col("box").alias("other"))
    seen = b.join(near, ["id", "label", "det"], "left").groupBy("id", "det").agg(F.coalesce(F.bool_or(S.box_iou(F.col("box"), F.col("other")) >= 0.5), F.lit(False)).alias("ok"))
    return seen.groupBy("id").agg(F.count(F.lit(1)).alias("present"), F.count_if("ok").alias("confirmed"), F.round(F.count_if("ok") / 7.0, 6).alias("score"))


@query("""SELECT p_partkey, t.kind, t.kind <> 'mirror' OR p_size % 2 = 0 AS eligible, CASE t.kind WHEN 'identity' THEN p_size WHEN 'negate' THEN -p_size ELSE 50 - p_size END AS expected
FROM part, (VALUES ('identity'), ('negate'), ('mirror')) t(kind)""")
def matrix_plan(spark, d):  # M01
    size = F.col("p_size")
    kinds = [("identity", size, F.lit(True)), ("negate", -size, F.lit(True)), ("mirror", 50 - size, size % 2 == 0)]
    x = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), ok.alias("eligible"), e.alias("expected")) for k, e, ok in kinds)))
    return read(spark, d, "part", "p_partkey", "p_size").select("p_partkey", x.alias("x")).select("p_partkey", "x.*")


@query("""WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part)
SELECT p_partkey, (row_number() OVER (ORDER BY k, p_brand))::INT AS place FROM r WHERE k <= 3""")
def round_robin_manifest(spark, d):  # A18: at most three of each brand, brands in turn
    k = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    r = read(spark, d, "part", "p_brand", "p_partkey").withColumn("k", k)
    placed = R.cumulated(r.filter("k <= 3").withColumn("one", F.lit(1).cast("long")), ["k", "p_brand"], {"one": "before"})
    return placed.select("p_partkey", (F.col("before") + 1).cast("int").alias("place"))


@query("""WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) AS k, max(p_partkey) OVER (PARTITION BY p_brand) AS first_seen FROM part)
SELECT p_partkey, place FROM (SELECT p_partkey, row_number() OVER (ORDER BY k, first_seen DESC) - 1 AS place FROM r WHERE k <= 5) WHERE place < 60""")
def first_seen_turns(spark, d):  # A18: brands as the parts show them from the last on, five of each and sixty in all
    p = read(spark, d, "part", "p_brand", "p_partkey").withColumn("o", -F.col("p_partkey"))
    return R.round_robin_take(p, "p_brand", "o", 5, 60).select("p_partkey", "place")


@query("""SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS hour_us, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2""")
def hourly_windows(spark, d):  # S: tumbling windows, the batch form of streaming.windows
    from tallyframe.streaming.windows import windowed

    w = windowed(read(spark, d, "events"), "1 hour")
    return w.select(F.unix_micros("window.start").alias("hour_us"), "event_type", "n", F.round("total", 3).alias("total"))


@query("""WITH e AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 21600000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e)
SELECT user_id, min(epoch_us(ts)) AS start_us, max(epoch_us(ts)) + 21600000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark, d):  # S: the batch form of streaming.windows
    from tallyframe.streaming.windows import sessions

    s = sessions(read(spark, d, "events"), "6 hours")
    return s.select("user_id", F.unix_micros("session_window.start").alias("start_us"), F.unix_micros("session_window.end").alias("end_us"), "n")


@query("""SELECT event_type, event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1""")
def first_events(spark, d):  # S: the batch form of streaming.windows
    from tallyframe.streaming.windows import first_by_key

    return first_by_key(read(spark, d, "events", "ts", "event_id", "user_id", "event_type"), "event_type").select("event_type", "event_id", "user_id")


PAIRED_SQL = """r AS (SELECT source, CASE WHEN doc_id % 7 <> 0 THEN n_chars END AS a, CASE WHEN doc_id % 11 <> 0 THEN length(replace(text, ' ', '')) END AS b FROM documents)"""


@query(f"""WITH {PAIRED_SQL}, c AS (SELECT source, sum(a)::DOUBLE AS sa, sum(b)::DOUBLE AS sb, count(*) AS n FROM r WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1),
k AS (SELECT count(*) AS k, sum(sa) AS ta, sum(sb) AS tb, sum(n) AS tn FROM c), j AS (SELECT row_number() OVER (ORDER BY source) - 1 AS j, sa, sb, n FROM c),
d AS (SELECT b, ('0x' || substr(sha256('31:' || b || ':' || slot), 1, 8))::BIGINT % k AS j FROM range(200) q(b), k, range(0, (SELECT k FROM k)) s(slot)),
e AS (SELECT b, (sum(sb) - sum(sa)) / sum(n) AS r FROM d JOIN j USING (j) GROUP BY b)
SELECT k AS clusters, tn::BIGINT AS n, round((tb - ta) / tn, 4) AS delta, round((SELECT quantile_cont(r, 0.025) FROM e), 4) AS low, round((SELECT quantile_cont(r, 0.975) FROM e), 4) AS high FROM k""")
def paired_bootstrap(spark, d):  # K06, K09, R9
    r = read(spark, d, "documents", "doc_id", "source", "n_chars", "text")
    r = r.select("source", F.when(F.col("doc_id") % 7 != 0, F.col("n_chars")).alias("a"), F.when(F.col("doc_id") % 11 != 0, F.length(F.replace("text", F.lit(" "), F.lit("")))).alias("b"))
    return K.paired_bootstrap(r, "source", "a", "b", 200, 31)


@query("""WITH e AS (SELECT event_id, user_id, (epoch_us(ts) // 1000000)::DOUBLE AS t FROM events), s AS (SELECT user_id, min(t) AS lo, max(t) AS hi FROM e GROUP BY 1),
w AS (SELECT user_id, unnest(range(0, greatest(0, ceil((hi - lo - 172800) / 43200))::BIGINT + 1)) AS k, lo, hi FROM s),
b AS (SELECT user_id, k, lo + least(k * 43200, greatest(0, hi - lo - 172800)) AS st FROM w),
c AS (SELECT event_id, k, least(t - st, st + 172800 - t) AS inside FROM e JOIN b ON e.user_id = b.user_id AND t >= st AND t <= st + 172800)
SELECT event_id, arg_max(k, {'i': inside, 'k': -k}) AS win FROM c GROUP BY 1""")
def window_ownership(spark, d):  # G08
    e = read(spark, d, "events", "event_id", "user_id", "ts").withColumn("t", F.expr("unix_micros(cast(ts as timestamp)) div 1000000").cast("double"))
    return R.window_owner(e, "user_id", "t", 172800.0, 43200.0).select("event_id", F.col("window").alias("win"))


@query()
def box_tracks(spark, d):  # E16: sequential within a clip, no SQL
    b = boxes(spark, d).dropDuplicates(["id", "det"])
    return R.track_boxes(b.select(F.col("id").alias("clip"), F.col("det").alias("frame"), F.col("label").cast("int").alias("det"), "box"))


@query()
def alias_mentions(spark, d):  # C20, E13: longest match, no SQL
    find = T.mentions_udf({"ring": "ring", "small ring": "small ring", "widget": "widget", "red widget": "red widget", "bolt": "bolt"})
    return read(spark, d, "part", "p_partkey", "p_name").select("p_partkey", F.array_join(find("p_name"), "|").alias("labels"))


@query("""WITH g AS (SELECT o_custkey, count(DISTINCT o_orderstatus) AS labels, min(o_orderstatus) AS one, list_sort(list_distinct(list(o_orderkey))) AS ids FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN labels = 1 THEN one END AS label, array_to_string(ids, ',') AS ids, labels > 1 AS conflict FROM g""")
def merge_observations(spark, d):  # F31
    m = D.merge_observations(read(spark, d, "orders", "o_custkey", "o_orderstatus", "o_orderkey"), "o_custkey", "o_orderstatus", "o_orderkey")
    return m.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query("""WITH s AS (SELECT user_id, event_type, round(avg(value), 6) AS s FROM events GROUP BY 1, 2)
SELECT user_id, array_to_string(list_slice(list(event_type ORDER BY s DESC, event_type), 1, 3), ',') AS top FROM s GROUP BY 1""")
def top_classes(spark, d):  # H07, G04
    s = read(spark, d, "events", "user_id", "event_type", "value").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("s"))
    return D.top_classes(s, "user_id", "event_type", "s", 3).withColumn("top", F.array_join("top", ","))


@query("""WITH r AS (SELECT DISTINCT sha256(text) AS k FROM documents WHERE source = 'src3'),
h AS (SELECT doc_id, source || '/' || lang AS grp, sha256(text) IN (SELECT k FROM r) AS hit FROM documents), g AS (SELECT grp, bool_or(hit) AS gh FROM h GROUP BY 1)
SELECT doc_id, grp, CASE WHEN hit THEN 'reserved' WHEN gh THEN 'quarantine' WHEN ('0x' || substr(sha256('13:' || grp), 1, 8))::BIGINT % 5 = 0 THEN 'dev' ELSE 'train' END AS role FROM h JOIN g USING (grp)""")
def leakage_safe(spark, d):  # J03: the texts of one source are held as reserved
    t = read(spark, d, "documents", "doc_id", "source", "lang", "text").select("doc_id", "source", F.concat_ws("/", "source", "lang").alias("grp"), F.sha2("text", 256).alias("k"))
    return D.leakage_safe(t, t.filter("source = 'src3'"), "k", "grp", 13).select("doc_id", "grp", "role")


@query("""SELECT l_suppkey % 50 AS base, count(*) AS members, count_if(l_returnflag <> 'A') AS qualified, count(*) = 120 AND count_if(l_returnflag <> 'A') = 120 AS eligible FROM lineitem GROUP BY 1""")
def qualified_groups(spark, d):  # K16
    li = read(spark, d, "lineitem", "l_suppkey", "l_returnflag").select((F.col("l_suppkey") % 50).alias("base"), F.when(F.col("l_returnflag") != "A", "qualified").otherwise("excluded").alias("status"))
    return D.qualified_groups(li, "base", "status", 120)


@query("""WITH a AS (SELECT o_custkey, list(o_orderstatus ORDER BY o_orderkey) AS a FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN a[1] = a[2] THEN a[1] WHEN a[3] = a[1] OR a[3] = a[2] THEN a[3] END AS answer,
       CASE WHEN a[1] = a[2] THEN 'accepted' WHEN a[3] = a[1] OR a[3] = a[2] THEN 'arbitrated' ELSE 'rejected' END AS state FROM a""")
def arbitration(spark, d):  # M05
    return D.arbitrate(read(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey", "o_orderstatus")


@query("""SELECT c_custkey, c_nationkey, n_name, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def contract_join(spark, d):  # L01, L08: a key that repeats or a balance out of range fails the query
    n = C.require_unique(read(spark, d, "nation", "n_nationkey", "n_name"), ["n_nationkey"])
    c = C.require_range(C.require_unique(read(spark, d, "customer", "c_custkey", "c_nationkey", "c_acctbal"), ["c_custkey"]), "c_acctbal", -1e5, 1e5)
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", "n_name", "c_acctbal")


@query("""WITH p AS (SELECT p_partkey, p_size, p_size / 50.0::DOUBLE AS a, p_retailprice / 2500.0 AS b FROM part)
SELECT p_partkey, round(least(1.0, greatest(0.0, -ln((exp(-10 * a) + exp(-10 * b)) / 2) / 10)), 6) AS soft, round(0.5 * (a + b) / 2 + 0.5 * least(a, b), 6) AS blend,
       round(least(1.0, greatest(0.0, 1 - 2.0 * (1 - a))), 6) AS calibrated, round(exp(-a), 6) AS smooth, round_even(p_size / 4.0, 0)::INT AS needed, (a > 0.5)::INT + (b > 0.5)::INT >= 1 AS moves,
       CASE WHEN a > 0.9 THEN 'failed' WHEN b > 0.9 THEN 'blocked' WHEN a < 0.1 THEN 'not_applicable' ELSE 'verified' END AS state FROM p""")
def score_formulas(spark, d):  # D05, D07, D08, D09, D11, D18, D21
    p = read(spark, d, "part", "p_partkey", "p_size", "p_retailprice").withColumns({"a": F.col("p_size") / 50.0, "b": F.col("p_retailprice") / 2500.0})
    v = F.array("a", "b")
    none = F.lit("not_applicable")
    state = F.array(F.when(F.col("a") > 0.9, "failed").when(F.col("a") < 0.1, none).otherwise("verified"), F.when(F.col("b") > 0.9, "blocked").when(F.col("a") < 0.1, none).otherwise("verified"))
    return p.select("p_partkey", F.round(S.softmin(v, 10.0), 6).alias("soft"), F.round(S.condition_blend(v), 6).alias("blend"), F.round(S.calibrated(F.col("a"), 2.0), 6).alias("calibrated"), F.round(S.discontinuity_score(F.col("a")), 6).alias("smooth"), S.needed_frames(F.col("p_size")).alias("needed"), S.enough_moves(v, 0.5, F.lit(1)).alias("moves"), S.status_fold(state).alias("state"))


@query(r"""SELECT p_partkey, lower(trim(trim(regexp_replace('  (The ' || p_name || '!) ', '\s+', ' ', 'g')), ' .,;:!?"''()[]{}')) AS phrase,
       split_part(split_part(lower(p_name), '-', 1), '_', 1) AS label, p_partkey / 2.0::DOUBLE AS rate,
       CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE 'clips/' || p_partkey END AS path FROM part""")
def text_keys(spark, d):  # C02, C17, C29, C30
    p = read(spark, d, "part", "p_partkey", "p_name")
    name = F.col("p_name")
    path = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("clips/../"), F.col("p_partkey").cast("string"))).otherwise(F.concat(F.lit("clips/"), F.col("p_partkey").cast("string")))
    return p.select("p_partkey", T.normalize_phrase(F.concat(F.lit("  (The "), name, F.lit("!) "))).alias("phrase"), T.filename_label(F.concat(F.lit("x/"), name)).alias("label"), T.rate(F.concat(F.col("p_partkey").cast("string"), F.lit("/2"))).alias("rate"), T.safe_relative(path).alias("path"))


PROMPTS = ("the camera pans over %s", "a dog near the %s is slowly running", "camera movement, a bird flying", "%s in high action", "the pan of %s", "camera %s", "someone climbing a %s", "a car and %s", "a cat %s\n jumps")


def _motion_sql() -> str:
    has = lambda patterns: " OR ".join(f"regexp_matches(q, '{p}', 'i')" for p in patterns)
    return f"""WITH p AS (SELECT p_partkey, k, replace([{', '.join("'" + x.replace(chr(10), "' || chr(10) || '") + "'" for x in PROMPTS)}][k + 1], '%s', p_name) AS q FROM part, range({len(PROMPTS)}) AS r(k)),
m AS (SELECT p_partkey, k, {has(T.CAMERA_MOTION)} AS c, {has(T.SUBJECT_MOTION)} AS s, {has(T.ANY_MOTION)} AS g FROM p)
SELECT p_partkey, k::INT AS k, CASE WHEN c AND s THEN 'both' WHEN c THEN 'camera' WHEN s THEN 'subject' WHEN g THEN 'generic' ELSE 'unknown' END AS motion FROM m"""


@query(_motion_sql())
def motion_targets(spark, d):  # C26
    p = read(spark, d, "part", "p_partkey", "p_name").select("p_partkey", F.posexplode(F.array(*(F.replace(F.lit(n), F.lit("%s"), F.col("p_name")) for n in PROMPTS))).alias("k", "q"))
    return p.select("p_partkey", "k", T.motion_target(F.col("q")).alias("motion"))


@query("""WITH n AS (SELECT user_id, count(*) AS frames FROM events GROUP BY 1)
SELECT user_id, array_to_string([x FOR x IN [round_even(i * 24.0 / 10.0, 0)::BIGINT FOR i IN range(0, floor((frames - 1) * 10.0 / 24.0)::BIGINT + 1)] IF x < frames], ',') AS kept, CASE WHEN frames % 2 = 0 THEN 1 ELSE -1 END AS phase FROM n""")
def resampled_frames(spark, d):  # G16, G17
    n = read(spark, d, "events", "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("frames"))
    return n.select("user_id", F.array_join(R.resample_indices(F.col("frames"), 24.0, 10.0), ",").alias("kept"), R.alternating_phase(F.col("frames"), 0).alias("phase"))


from tallyframe.plans import comparisons, construction, dimensions, evaluators, intervals, io, masks, media, motion, parsing, reports, semantic, statistics, tracks  # noqa: E402, F401 - they register queries too, over tables made here

query(comparisons.comparison_sql())(comparisons.method_comparison)  # over the pairs above
