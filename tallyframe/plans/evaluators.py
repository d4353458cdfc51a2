"""Evaluators and summaries over parts, views of frames, answers parsed with codes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tallyframe.functions import parsed as P
from tallyframe.functions import scores as S
from tallyframe.operators import evaluators as E
from tallyframe.plans.io import fresh
from tallyframe.plans.registry import query, read
from tallyframe.sources import records as R

STATUS_SQL = """CASE WHEN p_size % 7 = 0 THEN 'failed' WHEN p_size % 11 = 0 THEN 'unsupported' ELSE 'succeeded' END"""


def rated(batch: pd.DataFrame) -> pd.DataFrame:
    """Price by size, backwards; sizes that seven divides fail, those that eleven does are not
    supported."""
    size = batch["p_size"]
    status = pd.Series("succeeded", index=batch.index).mask(size % 11 == 0, "unsupported").mask(size % 7 == 0, "failed")
    score = (batch["p_retailprice"] / size).where(status == "succeeded")
    return pd.DataFrame({"p_partkey": batch["p_partkey"], "status": status, "score": score, "error": ("size " + size.astype(str)).where(status == "failed"), "backend": "audit"})[::-1]


def _rated(spark, d):
    p = E.numbered(read(spark, d, "part", "p_partkey", "p_size", "p_retailprice"), "p_partkey")
    return E.run_evaluator(p, rated, "p_partkey", "backend string")


@query(f"""SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS ordinal, p_partkey, {STATUS_SQL} AS status, round(CASE WHEN {STATUS_SQL} = 'succeeded' THEN p_retailprice / p_size END, 6) AS score, CASE WHEN p_size % 7 = 0 THEN 'size ' || p_size END AS error FROM part""")
def evaluated_parts(spark, d):  # P, L02, H11: an evaluator that returns its batches backwards
    return _rated(spark, d).select("ordinal", "p_partkey", "status", F.round("score", 6).alias("score"), "error")


@query(f"""WITH r AS (SELECT {STATUS_SQL} AS status, p_retailprice / p_size AS score FROM part)
SELECT CASE WHEN bool_and(status = 'succeeded') THEN 'complete' WHEN bool_or(status = 'succeeded') THEN 'partial' ELSE 'failed' END AS status, count(*) AS total, count_if(status = 'succeeded') AS succeeded, count_if(status = 'failed') AS failed,
       count_if(status = 'succeeded') AS valid_samples, round(avg(score) FILTER (status = 'succeeded'), 6) AS aggregate, count_if(status = 'failed') AS errors, count_if(status = 'unsupported') AS unsupported FROM r""")
def run_summaries(spark, d):  # P, F01: the run's row
    s = E.summary(_rated(spark, d))
    return s.select("status", "total", "succeeded", "failed", "valid_samples", F.round("aggregate", 6).alias("aggregate"), "errors", F.coalesce(F.try_element_at("status_counts", F.lit("unsupported")), F.lit(0)).alias("unsupported"))


@query("""WITH p AS (SELECT p_partkey AS id, p_size + 16 AS w, p_size % 13 + 9 AS h FROM part),
v AS (SELECT id, w, h, round_even(w / 2, 0)::INT AS x, round_even(h / 2, 0)::INT AS y FROM p),
s AS (SELECT id, [x * y, (w - x) * y, x * (h - y), (w - x) * (h - y)] AS areas, [((id * k) % 131) / 100.0::DOUBLE - 0.1 FOR k IN [3, 5, 7, 11]] AS raw, (id % 120) / 100.0::DOUBLE AS whole FROM v)
SELECT id, areas[1]::INT AS first_area, list_sum(areas)::INT AS area, round(list_avg([least(1, greatest(0, r)) FOR r IN raw]), 6) AS environment_mean, round(least(1, whole) * list_avg([least(1, greatest(0, r)) FOR r IN raw]), 6) AS score FROM s""")
def scene_quarters(spark, d):  # N07: quarters of a frame, and a score that all of them support
    p = read(spark, d, "part", "p_partkey", "p_size").select(F.col("p_partkey").alias("id"), (F.col("p_size") + 16).alias("w"), (F.col("p_size") % 13 + 9).alias("h"))
    area = lambda v: (v["right"] - v["left"]) * (v["bottom"] - v["top"])
    raw = F.array(*(((F.col("id") * k) % 131) / F.lit(100.0) - 0.1 for k in (3, 5, 7, 11)))
    p = p.withColumns({"areas": F.transform(E.scene_views(F.col("w"), F.col("h")), area), "g": E.grounded_score((F.col("id") % 120) / F.lit(100.0), raw)})
    return p.select("id", F.get("areas", F.lit(0)).alias("first_area"), F.aggregate("areas", F.lit(0), lambda s, x: s + x).alias("area"), F.round("g.environment_mean", 6).alias("environment_mean"), F.round("g.score", 6).alias("score"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN 'invalid_json' WHEN 3 THEN 'schema_types' WHEN 4 THEN 'missing:k' ELSE 'type:k' END AS errors,
       CASE WHEN event_id % 6 < 2 THEN (props->>'$.k')::INT END AS k, (props->>'$.k')::INT AS unwrapped FROM events""")
def parsed_answers(spark, d):  # C27, C19: fenced, broken, foreign and incomplete answers; nested wrappers
    e, p = read(spark, d, "events", "event_id", "props"), F.col("props")
    k = F.get_json_object(p, "$.k")
    forms = F.array(p, F.concat(F.lit("```json\n"), p, F.lit("\n```")), F.concat(p, F.lit("}")), F.concat(F.lit("["), p, F.lit("]")), F.lit('{"other": 1, "k": null}'), F.lit('{"k": "x7"}'))
    got = P.parse_object(F.get(forms, (F.col("event_id") % 6).cast("int")), {"k": "int"})
    wrapped = F.get(F.array(p, F.concat(F.lit('{"dim": '), p, F.lit("}")), F.concat(F.lit('{"dim": {"dim": {"dim":'), p, F.lit("}}}"))), (F.col("event_id") % 3).cast("int"))
    out = e.withColumns({"x": got, "u": P.unwrap(wrapped, "dim"), "want": k})
    return out.select("event_id", F.array_join("x.errors", ",").alias("errors"), F.col("x.value.k").alias("k"), F.get_json_object("u", "$.k").cast("int").alias("unwrapped"))


@query("""WITH b AS (SELECT p_partkey AS id, (p_size % 9) / 10.0::DOUBLE AS a, (p_size % 7) / 10.0::DOUBLE AS b, p_size AS n FROM part)
SELECT id, round(-ln((exp(-10 * a) + exp(-10 * b)) / 2) / 10, 6) AS soft, least(a, b) AS hard, round(6 * least(n, 40) / 256.0::DOUBLE, 6) AS pixels, greatest(1, round_even(4 * n / 16.0, 0))::INT AS needed FROM b""")
def strict_scores(spark, d):  # D05, D11: checked inputs, thresholds
    p = read(spark, d, "part", "p_partkey", "p_size")
    v = F.array((F.col("p_size") % 9) / F.lit(10.0), (F.col("p_size") % 7) / F.lit(10.0))
    return p.select(F.col("p_partkey").alias("id"), F.round(P.strict_softmin(v, 10.0), 6).alias("soft"), P.hard_min(v).alias("hard"), F.round(P.pixel_threshold(F.col("p_size"), F.lit(40)), 6).alias("pixels"), P.effective_needed_frames(F.col("p_size")).alias("needed"))


@query("SELECT (row_number() OVER (ORDER BY p_partkey) - 1)::INT AS id, lower(p_name) AS label FROM part")
def vocabulary_rows(spark, d):  # A14: a label and its number a line
    path = fresh(spark, "vocabulary")
    p = E.numbered(read(spark, d, "part", "p_partkey", "p_name"), "p_partkey")
    p.select(F.concat(F.initcap("p_name"), F.lit(" \t"), F.col("ordinal").cast("string"))).write.text(path)
    return R.fixed_vocabulary(spark, path)


@query("""SELECT l_suppkey % 7 AS shard, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem WHERE l_linenumber = 1 GROUP BY 1""")
def expected_scores(spark, d):  # A15: shards whose rows are the orders that are asked for, each once
    li = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity").filter("l_linenumber = 1")
    rows = li.select((F.col("l_suppkey") % 7).alias("shard"), F.monotonically_increasing_id().alias("id"), "l_quantity")
    path = fresh(spark, "shards")
    rows.write.partitionBy("shard").parquet(path)
    scores = spark.read.parquet(path)
    receipts = li.groupBy((F.col("l_suppkey") % 7).alias("shard")).agg(F.count(F.lit(1)).alias("n")).withColumns({"complete": F.lit(True), "protocol": F.lit("v2")})
    out = R.expected_shards(scores, receipts, "v2", scores.select("id"), "id")
    return out.groupBy(F.col("shard").cast("long").alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"))
