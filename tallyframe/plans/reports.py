"""Bootstraps, contracts of identity, and small relational forms, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.functions import text as T
from tallyframe.operators import bootstrap as B
from tallyframe.operators import contracts as C
from tallyframe.operators import relational as R
from tallyframe.plans.queries import GRID_SQL, PAIRS_SQL, level_grid, scored_pairs
from tallyframe.plans.registry import query, read


def draws_sql(members: str, cluster: str, draws: int, seed: int) -> str:
    """Statements that draw the clusters of ``members`` again: bm has (b, row of members)."""
    return f"""bn AS (SELECT cl, row_number() OVER (ORDER BY cl) - 1 AS j FROM (SELECT DISTINCT {cluster} AS cl FROM {members})), bk AS (SELECT count(*) AS k FROM bn),
bs AS (SELECT b, ('0x' || substr(sha256('{seed}:' || b || ':' || slot), 1, 8))::BIGINT % k AS j FROM range({draws}) t(b), bk, LATERAL range(k) u(slot)),
bm AS (SELECT bs.b, m.* FROM bs JOIN bn USING (j) JOIN {members} m ON m.{cluster} = bn.cl)"""


@query(f"""WITH r AS (SELECT source, n_chars::DOUBLE AS v FROM documents WHERE n_chars IS NOT NULL), {draws_sql('r', 'source', 40, 19)},
e AS (SELECT b, avg(v) AS a, quantile_cont(v, 0.5) AS m FROM bm GROUP BY b),
p AS (SELECT count(*) AS n, count(DISTINCT source) AS clusters, round(avg(v), 3) AS v_mean, round(quantile_cont(v, 0.5), 3) AS v_median FROM r)
SELECT p.*, round(quantile_cont(a, 0.025), 3) AS v_mean_low, round(quantile_cont(a, 0.975), 3) AS v_mean_high, round(quantile_cont(m, 0.025), 3) AS v_median_low, round(quantile_cont(m, 0.975), 3) AS v_median_high FROM e, p GROUP BY ALL""")
def member_bootstrap(spark, d):  # K05
    return B.resampled(read(spark, d, "documents", "source", F.col("n_chars").alias("v")), "source", ["v"], 40, 19, 3)


ARMS_SQL = f"""{GRID_SQL}, arms AS (SELECT base, level, max(CASE WHEN family = 'N' THEN score END) AS a, max(CASE WHEN family = 'R' THEN score END) AS b FROM g GROUP BY 1, 2),
r AS (SELECT base, level, a / 10000 AS av, b / 10000 AS bv, (b - a) / 10000 AS x FROM arms WHERE a IS NOT NULL AND b IS NOT NULL)"""


def arms(spark, d):
    p = level_grid(spark, d).groupBy("base", "level").agg(*(F.max(F.when(F.col("family") == f, F.col("score"))).alias(n) for f, n in (("N", "a"), ("R", "b"))))
    return p.dropna().select("base", "level", (F.col("a") / 10000).alias("av"), (F.col("b") / 10000).alias("bv"), ((F.col("b") - F.col("a")) / 10000).alias("x"))


@query(f"""WITH {ARMS_SQL}, {draws_sql('r', 'base', 30, 23)},
e AS (SELECT b, quantile_cont(av, 0.5) AS ma, quantile_cont(bv, 0.5) AS mb FROM bm GROUP BY b),
p AS (SELECT count(*) AS n, count(DISTINCT base) AS clusters, round(quantile_cont(av, 0.5), 4) AS av_median, round(quantile_cont(bv, 0.5), 4) AS bv_median FROM r)
SELECT p.*, round(quantile_cont(ma, 0.025), 4) AS av_median_low, round(quantile_cont(ma, 0.975), 4) AS av_median_high, round(quantile_cont(mb, 0.025), 4) AS bv_median_low, round(quantile_cont(mb, 0.975), 4) AS bv_median_high FROM e, p GROUP BY ALL""")
def paired_median_bootstrap(spark, d):  # K06
    out = B.resampled(arms(spark, d), "base", ["av", "bv"], 30, 23)
    return out.select("n", "clusters", *(c for c in out.columns if "_median" in c))


EFFECTS_SQL = f"""{ARMS_SQL}, f AS (SELECT base, round(avg(x), 6) AS x FROM r GROUP BY 1), {draws_sql('f', 'base', 30, 29)},
e AS (SELECT b, quantile_cont(x, 0.5) AS m, quantile_cont(abs(x), 0.5) AS s FROM bm GROUP BY b),
p AS (SELECT count(*) AS n, round(quantile_cont(x, 0.5), 4) AS signed_median, round(quantile_cont(abs(x), 0.5), 4) AS size_median, count_if(x = 0) AS zero_effects FROM f),
o AS (SELECT p.*, round(quantile_cont(m, 0.025), 4) AS signed_median_low, round(quantile_cont(m, 0.975), 4) AS signed_median_high, round(quantile_cont(s, 0.025), 4) AS size_median_low, round(quantile_cont(s, 0.975), 4) AS size_median_high FROM e, p GROUP BY ALL)"""


def base_effects(spark, d):
    return B.effects(arms(spark, d).groupBy("base").agg(F.round(F.avg("x"), 6).alias("x")), "base", "x", 30, 29)


@query(f"WITH {EFFECTS_SQL} SELECT * FROM o")
def effect_bootstrap(spark, d):  # K08
    return base_effects(spark, d)


@query(f"""WITH {EFFECTS_SQL}
SELECT n, size_median >= 0.2 AND size_median_low > 0.1 AS change, signed_median >= 0.2 AND signed_median_low > 0.1 AS ordered_drop, size_median <= 0.05 AND signed_median_low <= 0 AND signed_median_high >= 0 AS invariance FROM o""")
def effect_gates(spark, d):  # D20
    return base_effects(spark, d).select("n", *(B.gate(x).alias(x) for x in ("change", "ordered_drop", "invariance")))


@query(f"""WITH {PAIRS_SQL}, r AS (SELECT prompt || '/' || model_a || '/' || model_b AS id, CASE WHEN CASE WHEN score_a > score_b THEN 1.0 WHEN score_a < score_b THEN 0.0 ELSE 0.5 END = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM pairs),
{draws_sql('r', 'id', 40, 31)}, e AS (SELECT b, avg(v) AS a FROM bm GROUP BY b), l AS (SELECT list(a ORDER BY a) AS l FROM e)
SELECT (SELECT count(*) FROM r) AS n, (SELECT round(avg(v), 6) FROM r) AS estimate, round(l[1], 6) AS low, round(l[39], 6) AS high FROM l""")
def accuracy_bootstrap(spark, d):  # K03
    p = scored_pairs(spark, d)
    sign = F.when(F.col("score_a") > F.col("score_b"), 1.0).when(F.col("score_a") < F.col("score_b"), 0.0).otherwise(0.5)
    rows = p.select(F.concat_ws("/", "prompt", "model_a", "model_b").alias("id"), (sign == F.col("label")).cast("double").alias("v"))
    return B.order_statistic_interval(rows, "id", "v", 40, 31)


STRATA = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_LIST = ", ".join(f"'{s}'" for s in STRATA)


@query(f"""WITH r AS (SELECT c_nationkey AS f, o_orderpriority AS s, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority IN ({_LIST})), {draws_sql('r', 'f', 30, 37)},
e AS (SELECT b, CASE WHEN count(*) = 5 THEN avg(a) END AS r FROM (SELECT b, s, avg(v) AS a FROM bm GROUP BY 1, 2) GROUP BY b), l AS (SELECT list(r ORDER BY r) FILTER (r IS NOT NULL) AS l FROM e),
p AS (SELECT avg(a) AS estimate FROM (SELECT s, avg(v) AS a FROM r GROUP BY 1))
SELECT (SELECT count(DISTINCT f) FROM r) AS families, round(estimate, 6) AS estimate, len(l) AS bootstrap_valid, round(l[1 + floor(0.025 * (len(l) - 1))::INT], 6) AS low, round(l[1 + floor(0.975 * (len(l) - 1))::INT], 6) AS high FROM l, p""")
def macro_bootstrap(spark, d):  # K07
    o = read(spark, d, "orders", "o_custkey", "o_orderpriority", "o_orderstatus").join(read(spark, d, "customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    rows = o.select(F.col("c_nationkey").alias("f"), F.col("o_orderpriority").alias("s"), (F.col("o_orderstatus") == "F").cast("double").alias("v"))
    return B.macro_interval(rows, "f", "s", STRATA, "v", 30, 37)


@query(f"""WITH {GRID_SQL},
w AS (SELECT base, level, max(CASE WHEN family = 'N' THEN score END) AS clean, max(CASE WHEN family = 'R' THEN score END) AS subject, max(CASE WHEN family = 'A' THEN score END) AS background FROM g GROUP BY 1, 2),
x AS (SELECT *, (clean - subject) / clean AS sd, (clean - background) / clean AS bd FROM w),
y AS (SELECT *, CASE WHEN clean IS NULL OR subject IS NULL OR background IS NULL THEN 'unsupported_or_failed' WHEN sd <= 0 THEN 'sensitivity_failed' WHEN sd < 0.05 THEN 'subject_drop_below_0.05' ELSE 'measured' END AS state FROM x)
SELECT level, state, count(*) AS bases, round(avg(CASE WHEN state = 'measured' THEN bd / sd END), 5) AS mean_ratio, round(quantile_cont(CASE WHEN state = 'measured' THEN bd / sd END, 0.5), 5) AS median_ratio FROM y GROUP BY 1, 2""")
def region_discrimination(spark, d):  # K13: drops under two changes, their ratio, and why bases are left out
    score = lambda f: F.max(F.when(F.col("family") == f, F.col("score")))
    w = level_grid(spark, d).groupBy("base", "level").agg(score("N").alias("clean"), score("R").alias("subject"), score("A").alias("background"))
    w = R.measured_drops(w, "clean", "subject", "background", 0.05)
    ratio = F.when(F.col("state") == "measured", F.col("ratio"))
    return w.groupBy("level", "state").agg(F.count(F.lit(1)).alias("bases"), F.round(F.avg(ratio), 5).alias("mean_ratio"), F.round(F.percentile(ratio, F.lit(0.5)), 5).alias("median_ratio"))


@query(f"""WITH {GRID_SQL}, n AS (SELECT base, family, level, score, lead(score) OVER (PARTITION BY base, family ORDER BY level) > score AS up FROM g),
s AS (SELECT family, avg(CASE WHEN up THEN 1.0 ELSE 0.0 END) FILTER (up IS NOT NULL) AS rising, quantile_cont(score, 0.5) FILTER (level = 1) AS anchor FROM n GROUP BY 1)
SELECT family, round(rising, 6) AS rising, CASE WHEN rising >= 0.45 THEN round(anchor, 3) END AS constant FROM s""")
def calibration_constants(spark, d):  # K15: the median of an anchor, only where enough steps are ordered
    w = Window.partitionBy("base", "family").orderBy("level")
    n = level_grid(spark, d).withColumn("up", (F.lead("score").over(w) > F.col("score")).cast("double"))
    s = n.groupBy("family").agg(F.avg("up").alias("rising"), F.percentile(F.when(F.col("level") == 1, F.col("score")), F.lit(0.5)).alias("anchor"))
    return s.select("family", F.round("rising", 6).alias("rising"), F.when(F.col("rising") >= 0.45, F.round("anchor", 3)).alias("constant"))


@query("SELECT doc_id, sha256(text) AS sha, lang, n_chars FROM documents")
def identity_join(spark, d):  # E17, L04, E03: scores whose identity fields differ from the inputs fail the query
    inputs = read(spark, d, "documents", "doc_id", F.sha2("text", 256).alias("sha"), "lang")
    scores = read(spark, d, "documents", "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), "lang", "n_chars")
    return C.same_identity(scores, inputs, ["doc_id"], ["sha", "lang"])


@query(f"""WITH {PAIRS_SQL}, l AS (SELECT prompt, model_a AS a, model_b AS b, label FROM pairs UNION ALL SELECT prompt, model_b, model_a, CASE WHEN model_a = 0 AND model_b = 2 THEN label ELSE 1 - label END FROM pairs WHERE model_a <> 1)
SELECT x.prompt, x.a, x.b, x.label, coalesce(abs(x.label + y.label - 1) < 1e-8, false) AS reciprocal FROM l x LEFT JOIN l y ON y.prompt = x.prompt AND y.a = x.b AND y.b = x.a WHERE x.a < x.b""")
def reciprocal_labels(spark, d):  # E18, M06: a pair's two labels add up to one; a missing one does not
    p = scored_pairs(spark, d)
    back = F.when((F.col("model_a") == 0) & (F.col("model_b") == 2), F.col("label")).otherwise(1 - F.col("label"))
    both = p.select("prompt", F.col("model_a").alias("a"), F.col("model_b").alias("b"), "label").unionByName(p.filter("model_a <> 1").select("prompt", F.col("model_b").alias("a"), F.col("model_a").alias("b"), back.alias("label")))
    return R.reciprocal(both, ["prompt"], "a", "b", "label").filter("a < b")


@query("""SELECT c_custkey, coalesce(o.status, 'missing') AS status, o.n FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderstatus) AS status, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey""")
def evidence_status(spark, d):  # E04: a planned row without evidence stays, as missing
    plan = read(spark, d, "customer", "c_custkey")
    o = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderstatus").alias("status"), F.count(F.lit(1)).alias("n"))
    return plan.join(o, "c_custkey", "left").select("c_custkey", F.coalesce("status", F.lit("missing")).alias("status"), "n")


@query("SELECT p_partkey, p_brand, p_size FROM part WHERE p_size % 3 = 0")
def reviewed_cohort(spark, d):  # L07: only reviewed rows, and a review that names other content fails the query
    p = read(spark, d, "part", "p_partkey", "p_brand", "p_size")
    return C.reviewed(p, p.filter("p_size % 3 = 0").select("p_partkey", "p_brand"), ["p_partkey"], ["p_brand"])


@query("""WITH n AS (SELECT user_id, count(*) AS t FROM events GROUP BY 1), w AS (SELECT user_id, t, round_even(0.25 * t, 0)::BIGINT AS w FROM n)
SELECT user_id, w AS width, p.position, CASE p.position WHEN 'start' THEN 0 WHEN 'middle' THEN (t - w) // 2 ELSE t - w END AS first FROM w, (VALUES ('start'), ('middle'), ('end')) p(position) WHERE w > 0 AND 3 * w <= t""")
def fixed_windows(spark, d):  # G07
    n = read(spark, d, "events", "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("t"))
    return n.select("user_id", F.inline(R.fixed_windows(F.col("t"))))


@query("""WITH n AS (SELECT user_id, count(*) AS t FROM events GROUP BY 1), k AS (SELECT user_id, t, least(4, greatest(1, ceil(t / 8.0)::INT)) AS k FROM n),
w AS (SELECT user_id, t, k, unnest(range(k)) AS i FROM k)
SELECT user_id, i::INT AS i, (i * t) // k AS first, ((i + 1) * t) // k - (i * t) // k AS weight FROM w""")
def weighted_windows(spark, d):  # G06
    n = read(spark, d, "events", "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("t"))
    return n.select("user_id", F.inline(R.equal_windows(F.col("t"), R.count_windows(F.col("t")))))


@query("""WITH s AS (SELECT user_id, event_type, round(avg(value), 6) AS p FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, event_type) AS k FROM s)
SELECT user_id, k::INT AS rank, p FROM r WHERE event_type = 'click'""")
def target_rank(spark, d):  # G04
    s = read(spark, d, "events", "user_id", "event_type", "value").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("p"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("p"), "event_type"))).filter("event_type = 'click'").select("user_id", "rank", "p")


@query("""WITH b AS (SELECT l_orderkey, l_quantity * l_linenumber AS area, l_discount AS score, l_partkey, l_suppkey FROM lineitem WHERE l_quantity >= 5)
SELECT l_orderkey, k::INT AS k, area, score FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY area DESC, score DESC, l_partkey, l_suppkey) AS k FROM b) WHERE k <= 2""")
def largest_boxes(spark, d):  # H06: by area, then score, then index
    b = read(spark, d, "lineitem", "l_orderkey", "l_quantity", "l_linenumber", "l_discount", "l_partkey", "l_suppkey").filter("l_quantity >= 5").withColumn("area", F.col("l_quantity") * F.col("l_linenumber"))
    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("area"), F.desc("l_discount"), "l_partkey", "l_suppkey"))
    return b.withColumn("k", k).filter("k <= 2").select("l_orderkey", "k", "area", F.col("l_discount").alias("score"))


@query("""WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part) SELECT p_partkey, (i % 7)::INT AS shard, i // 7 AS place FROM r""")
def round_robin_shards(spark, d):  # H10, H11: shards by place in the input; (place, shard) restores the order
    return R.round_robin(read(spark, d, "part", "p_partkey"), "p_partkey", 7)


@query("""SELECT p_partkey FROM (SELECT p_partkey FROM part ORDER BY sha256('17:' || p_partkey), p_partkey LIMIT (SELECT count(*) // 5 FROM part))""")
def shuffled_share(spark, d):  # H05: a fifth of the rows, taken from a seeded order
    p = read(spark, d, "part", "p_partkey")
    return R.hash_sample(p, "p_partkey", p.count() // 5, 17).select("p_partkey")


@query("""SELECT l_suppkey AS id FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'N'""")
def common_ids(spark, d):  # I03: ids that all methods have scored
    li = read(spark, d, "lineitem", "l_suppkey", "l_returnflag")
    side = lambda f: li.filter(F.col("l_returnflag") == f).select(F.col("l_suppkey").alias("id"))
    return side("A").intersect(side("R")).intersect(side("N"))


@query("""SELECT sha256(text) AS key, count(DISTINCT source) > 1 AS shared, count(DISTINCT source) AS sources, count(*) AS n FROM documents GROUP BY 1""")
def shared_prompts(spark, d):  # I07, F20
    return read(spark, d, "documents", "source", "text").groupBy(F.sha2("text", 256).alias("key")).agg((F.count_distinct("source") > 1).alias("shared"), F.count_distinct("source").alias("sources"), F.count(F.lit(1)).alias("n"))


@query("""WITH RECURSIVE a AS (SELECT p_partkey AS alias, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_partkey - 1 END AS target FROM part),
r(alias, goal) AS (SELECT alias, alias FROM a UNION ALL SELECT r.alias, a.target FROM r JOIN a ON a.alias = r.goal WHERE a.target IS NOT NULL AND a.target >= 1)
SELECT alias, min(goal) AS canonical FROM r GROUP BY 1""")
def alias_closure(spark, d):  # I09: an alias leads to the end of its chain; a cycle fails the query
    p = read(spark, d, "part", F.col("p_partkey").alias("alias"))
    target = F.when((F.col("alias") % 10 != 0) & (F.col("alias") > 1), F.col("alias") - 1)
    return R.alias_closure(p.withColumn("target", target), "alias", "target")


@query("""SELECT o_custkey, round(avg(o_totalprice / 100), 9) AS scaled FROM orders GROUP BY 1""")
def scaled_means(spark, d):  # F05
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.avg(F.col("o_totalprice") / 100), 9).alias("scaled"))


@query("""SELECT l_orderkey, count(*) AS edited, count_if(l_returnflag <> 'N') AS present, count_if(l_returnflag = 'N') = count(*) AS occluded FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1""")
def edited_presence(spark, d):  # frames with evidence among those that were edited
    li = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag").filter("l_linenumber % 2 = 1")
    seen = F.count_if(F.col("l_returnflag") != "N")
    return li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("edited"), seen.alias("present"), (seen == 0).alias("occluded"))


@query("""SELECT doc_id, turn_off FROM (SELECT conv_id AS doc_id, turn AS turn_off, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k <= 3""")
def first_turns(spark, d):  # H08: a limit per group is the feature
    c = read(spark, d, "conversations", F.col("conv_id").alias("doc_id"), F.col("turn").alias("turn_off"))
    return c.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("turn_off"))).filter("k <= 3").drop("k")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'on the left of' WHEN 1 THEN 'on the right of' WHEN 2 THEN 'on the top of' ELSE 'on the bottom of' END AS relation FROM part""")
def relation_names(spark, d):  # C18
    given = F.get(F.array(*(F.lit(x) for x in ("Left", " right ", "TOP", "on the bottom of"))), (F.col("p_partkey") % 4).cast("int"))
    return read(spark, d, "part", "p_partkey").select("p_partkey", T.normalize_relation(given).alias("relation"))
