"""Evaluators under contract, summaries, strict scores and parsed answers."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import parsed as P
from tallyframe.operators import dataprep as D
from tallyframe.operators import evaluators as E
from tallyframe.operators import relational as R
from tallyframe.sources import records as S


def inputs(spark, n=25):
    return E.numbered(spark.range(n).selectExpr("concat('v', lpad(id, 3, '0'), '.mp4') AS video", "id AS size").repartition(3), "video")


def scorer(change=lambda d: d):
    """A function of its own, which workers get whole: they do not import tests."""

    def good(batch):
        return change(pd.DataFrame({"video": batch["video"], "status": "succeeded", "score": batch["size"] / 100})[::-1])

    return good


def test_results_cover_inputs_in_order(spark):
    out = E.run_evaluator(inputs(spark), scorer(), "video").orderBy("ordinal").collect()
    assert [r.ordinal for r in out] == list(range(25)) and [r.video for r in out] == [f"v{i:03d}.mp4" for i in range(25)] and all(r.score == r["size"] / 100 and r.error is None for r in out)
    s = E.summary(E.run_evaluator(inputs(spark), scorer(), "video")).first()
    assert (s.status, s.total, s.aggregate) == ("complete", 25, pytest.approx(0.12)) and s.status_counts == {"succeeded": 25}


@pytest.mark.parametrize(
    "change,match",
    [(lambda d: d[1:], "cover"), (lambda d: pd.concat([d, d[:1]]), "cover"), (lambda d: d.assign(video="x"), "cover"), (lambda d: d.assign(status="done"), "unknown status"), (lambda d: d.assign(score=None), "do not agree"), (lambda d: d.assign(status="failed"), "do not agree"), (lambda d: d.assign(score=float("inf")), "do not agree")],
)
def test_broken_contracts_fail(spark, change, match):
    with pytest.raises(Exception, match=match):
        E.run_evaluator(inputs(spark), scorer(change), "video").collect()


def test_isolated_errors_and_hooks(spark):
    def fails(batch):
        raise RuntimeError("no model")

    out = E.run_evaluator(inputs(spark, 5), fails, "video", isolate=True)
    assert {(r.status, r.score, r.error) for r in out.collect()} == {("failed", None, "RuntimeError: no model")}
    s = E.summary(out).first()
    assert (s.status, s.errors, s.aggregate) == ("failed", 5, None)
    assert E.summary(out.limit(0)).first().status == "not_implemented"
    assert E.summary(out.withColumn("status", F.lit("not_implemented"))).first().status == "not_implemented"
    assert E.summary(out, lambda r: r.groupBy("status").count()).first()["count"] == 5
    with pytest.raises(Exception, match="no model"):
        E.run_evaluator(inputs(spark, 5), fails, "video").collect()
    with pytest.raises(ValueError, match="score"):
        E.run_evaluator(inputs(spark).withColumn("Score", F.lit(1)), scorer(), "video")


def test_foreign_results(spark):
    i = inputs(spark, 6)
    r = i.select("video", (F.col("size") * 2).alias("score")).repartition(4)
    assert [x.score for x in E.covered_once(i, r, "video").orderBy("ordinal").collect()] == [0, 2, 4, 6, 8, 10]
    for bad in (r.filter("score > 0"), r.unionByName(r.filter("score = 2")), r.withColumn("video", F.concat("video", F.lit("x")))):
        with pytest.raises(Exception, match="cover their inputs once"):
            E.covered_once(i, bad, "video").collect()


def test_views_and_grounded_scores(spark):
    one = lambda *c: spark.range(1).select(*c).first()
    v = one(E.scene_views(F.lit(5), F.lit(7)).alias("v")).v
    assert [(x.left, x.top, x.right, x.bottom) for x in v] == [(0, 0, 2, 4), (2, 0, 5, 4), (0, 4, 2, 7), (2, 4, 5, 7)]
    g = one(E.grounded_score(F.lit(0.5), F.array(F.lit(1.5), F.lit(-1.0), F.lit(0.5))).alias("g")).g
    assert (g.environment_mean, g.score) == (0.5, 0.25)
    for whole, views in ((float("nan"), [1.0]), (1.0, []), (1.0, [float("inf")])):
        with pytest.raises(Exception, match="scene evidence"):
            one(E.grounded_score(F.lit(whole), F.array(*map(F.lit, views)).cast("array<double>")).alias("g"))


def test_answers_are_parsed_with_codes(spark):
    texts = ['{"a": 1, "b": ["x"]}', '```json\n{"a": 2, "b": []}\n```', '```\n{"a": 3, "b": null}```', "{", "", "[1]", "7", '"x"', '{"a": "z", "b": ["x"]}', '{"b": ["x"]}', '{"a": 1, "b": ["x"]}}', '{"a": 1, "b": ["x"]} {}', '{"a": 1}, "x": 2', '{"a":1}] [{"a":2}', None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", P.parse_object(F.col("t"), {"a": "int", "b": "array<string>"}).alias("p"))
    got = {r.i: r.p for r in df.collect()}
    assert got[0].value.a == 1 and got[0].value.b == ["x"] and got[1].value.b == [] and not got[1].errors
    want = {2: ["missing:b"], 3: ["invalid_json"], 4: ["invalid_json"], 5: ["schema_types"], 6: ["schema_types"], 7: ["schema_types"], 8: ["type:a"], 9: ["missing:a"], 10: ["invalid_json"], 11: ["invalid_json"], 12: ["invalid_json"], 13: ["invalid_json"], 14: ["invalid_json"]}
    assert {i: got[i].errors for i in want} == want and all(got[i].value is None for i in want)
    for deep in range(5):
        t = {"k": deep, "dim": None}
        inner = json.dumps({"k": deep})
        for _ in range(deep):
            inner = json.dumps({"dim": json.loads(inner)})
        assert json.loads(spark.createDataFrame([(inner,)], "t string").select(P.unwrap(F.col("t"), "dim").alias("u")).first().u) == {"k": t["k"]}


def test_strict_scores(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    a = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    assert one(P.strict_iou(a(0, 0, 2, 2), a(1, 1, 3, 3))) == pytest.approx(1 / 7) and one(P.hard_min(a(0.3, 0.2))) == 0.2 and one(P.strict_cosine(a(1, 0), a(1, 1))) == pytest.approx(0.5**0.5)
    assert one(P.pixel_threshold(F.lit(512), F.lit(256))) == 6 and one(P.effective_needed_frames(F.lit(1))) == 1 and one(P.effective_needed_frames(F.lit(10))) == 2
    for c in (P.strict_iou(a(0, 0, 0, 0), a(1, 1, 1, 1)), P.strict_softmin(a(0.5, 1.2), 10.0), P.hard_min(F.array().cast("array<double>")), P.strict_cosine(a(0, 0), a(1, 1)), P.strict_cosine(a(1), a(1, 1))):
        with pytest.raises(Exception, match="without area|lie in|of one size"):
            one(c)


def test_vocabularies_and_expected_shards(spark, tmp_path):
    (tmp_path / "v.txt").write_text("Riding a\tbike\t1\nABSEILING \t0\n\n")
    assert sorted(map(tuple, S.fixed_vocabulary(spark, str(tmp_path / "v.txt"), 2).collect())) == [(0, "abseiling"), (1, "riding a\tbike")]
    for text, size in (("a\t0\nb\t0\n", None), ("a\t1\n", None), ("a\t0\n", 2), ("a\tx\n", 1)):
        (tmp_path / "w.txt").write_text(text)
        with pytest.raises(Exception, match="each once"):
            S.fixed_vocabulary(spark, str(tmp_path / "w.txt"), size).collect()
    scores = spark.createDataFrame([(0, 1), (0, 2), (1, 3)], "shard int, id int")
    receipts = spark.createDataFrame([(0, True, "p", 2), (1, True, "p", 1)], "shard int, complete boolean, protocol string, n int")
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "id int")
    assert S.expected_shards(scores, receipts, "p", ids(1, 2, 3), "id").count() == 3
    for bad in (ids(1, 2), ids(1, 2, 3, 4)):
        with pytest.raises(Exception, match="exactly once"):
            S.expected_shards(scores, receipts, "p", bad, "id").collect()
    for change in ("complete = false AS complete", "'q' AS protocol", "n + 1 AS n"):  # receipts that lie
        name = change.split(" AS ")[1]
        lies = receipts.selectExpr(*(change.replace("complete = false", "not complete") if c == name else c for c in receipts.columns))
        with pytest.raises(Exception, match="valid receipt"):
            S.expected_shards(scores, lies, "p", ids(1, 2, 3), "id").collect()


def test_grids_and_tops_with_nulls(spark):
    rows = spark.createDataFrame([("a", 1), (None, 1), ("a", None)], "k string, l int")
    assert sorted(map(tuple, R.grid_gaps(rows, ["k", "l"], [["k"], ["l"]]).collect()), key=str) == [(None, None)]
    t = spark.createDataFrame([(1, "b", 1.0), (1, "a", 1.0), (1, "c", 3.0), (2, "x", None)], "k int, l string, s double")
    assert {r.k: r.top for r in D.top_classes(t, "k", "l", "s", 2).collect()} == {1: ["c", "a"], 2: ["x"]}
