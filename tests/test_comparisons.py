"""Reports of methods against numpy, pairs of annotations and transforms by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import comparisons as M


def test_paired_statistics(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 3))
    rows = [("a" if i % 3 else "b", f"p{i % 20}", *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, ("a", "p1", None, 1.0, 1.0), ("a", "p1", 1.0, None, 1.0)], "arm string, prompt string, base double, s1 double, s2 double")
    got = {r.arm: r for r in M.paired_statistics(df, "arm", "base", {"1701": "s1", "2904": "s2"}).collect()}
    for arm in "ab":
        v = np.array([r[2:] for r in rows if r[0] == arm])
        d, g = v[:, 1:] - v[:, :1], got[arm]
        assert g.sources == len(v) and g.base_mean == pytest.approx(v[:, 0].mean()) and g.changed_mean == pytest.approx(v[:, 1:].mean()) and g.delta == pytest.approx(d.mean()) and g.mae == pytest.approx(abs(d).mean())
        assert g.base_std == pytest.approx(v[:, 0].std()) and (g.base_low, g.base_high) == (v[:, 0].min(), v[:, 0].max()) and g.largest_drop == pytest.approx(d.min()) and g.largest_increase == pytest.approx(d.max()) and g.maximum_change == pytest.approx(abs(d).max())
        assert [g[q] for q in M.QUANTILES] == pytest.approx(np.quantile(v[:, 0], list(M.QUANTILES.values())).tolist()) and g.mean_2904 == pytest.approx(v[:, 2].mean())
    one = M.change_interval(df.filter("arm = 'a'"), "prompt", "base", ["s1", "s2"], 300, 5, absolute=True).first()
    assert one.clusters == len({r[1] for r in rows if r[0] == "a"}) and one.low < one.mean < one.high and one.valid == 300 and one.mean == pytest.approx(got["a"].mae)


def test_scale_margin(spark):
    rows = [(f"p{i % 15}", 1.0 + i % 4, 0.05 * (i % 3)) for i in range(90)]
    df = spark.createDataFrame(rows, "prompt string, origin double, new double")
    r = M.scale_margin(df, "prompt", "origin", "new", 200, 1).first()
    o, n = np.mean([x[1] for x in rows]), np.mean([x[2] for x in rows])
    assert r.allowed == pytest.approx(0.1 * o) and r.ratio == pytest.approx(n / o) and r.passed and r.low < n - 0.1 * o < r.high
    r = M.scale_margin(df.withColumn("origin", -F.col("origin")), "prompt", "origin", "new", 50, 1).first()
    assert (r.allowed, r.ratio, r.passed) == (None, None, None)


def test_method_rows_and_their_difference(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(200):
        a, b = rng.choice(list("wxyz"), 2, replace=False)
        s = rng.normal(size=2)
        rows.append((str(a), str(b), float(s[0]), float(s[1]) if i % 10 else None, float(rng.choice([0, 0.5, 1])), "dev" if i % 2 else "test"))
    df = spark.createDataFrame(rows, "model_a string, model_b string, score_a double, score_b double, label double, split string")
    r = M.method_metrics(df).first()
    valid = [x for x in rows if x[3] is not None]
    hit = lambda x, m: (0.5 if abs(x[2] - x[3]) <= m else float(x[2] > x[3])) == x[4]
    test = [x for x in valid if x[5] == "test"]
    assert r.coverage == pytest.approx(len(valid) / 200) and r.test_acc0 == pytest.approx(np.mean([hit(x, 0) for x in test])) and r.test_tie_aware_acc == pytest.approx(np.mean([hit(x, r.tie_margin + 1e-9) for x in test]), abs=0.02)
    values = ["test_acc0", "coverage"]
    t = lambda acc: spark.createDataFrame([("d", acc, 1.0)], "dimension string, test_acc0 double, coverage double")
    c = M.compared(t(0.5), t(0.75), ["dimension"], values).first()
    assert (c.official_test_acc0, c.repair_test_acc0, c.delta_test_acc0, c.delta_coverage) == (0.5, 0.75, 0.25, 0.0)
    with pytest.raises(Exception, match="one side only"):
        M.compared(t(0.5), t(0.5).withColumn("dimension", F.lit("e")), ["dimension"], values).collect()
    with pytest.raises(Exception, match="no valid pairs"):
        M.method_metrics(df.filter("split = 'test'")).collect()


def test_pairs_of_annotations(spark):
    videos = {"lavie": "lavie/1.mp4", "videocraft": "videocrafter/1.mp4", "cog": "other/1.mp4"}
    anno = {"cog": {"lavie": 1.0, "videocraft": 0.5}, "lavie": {"cog": 0.0, "videocraft": 1.0}, "videocraft": {"lavie": 0.5}}
    df = spark.createDataFrame([(7, videos, anno)], "source_row int, videos map<string,string>, anno map<string,map<string,double>>")
    there = spark.createDataFrame([(p,) for p in videos.values()], "path string")
    got = {(r.generator_a, r.generator_b): r for r in M.annotated_pairs(df, there, F.lit("d/v")).collect()}
    assert set(got) == {("cog", "lavie"), ("cog", "videocraft"), ("lavie", "videocraft")}
    assert got["cog", "lavie"].reciprocal and not got["cog", "lavie"].usable and got["cog", "lavie"].video_a is None and got["cog", "lavie"].video_b == "d/v/lavie/1.mp4"
    assert not got["cog", "videocraft"].reciprocal and got["cog", "videocraft"].label_b_over_a is None
    assert got["lavie", "videocraft"].usable and not got["lavie", "videocraft"].reciprocal
    assert M.annotated_pairs(df, there.filter("path <> 'lavie/1.mp4'"), F.lit("d")).filter("usable").count() == 0
    for bad in ("/x.mp4", "a/../b", ""):
        with pytest.raises(Exception, match="unsafe source path"):
            M.annotated_pairs(spark.createDataFrame([(1, {"a": bad, "b": "b/1"}, {})], df.schema), there, F.lit("d")).collect()


def test_transforms(spark):
    rows = [(0, "scene", "an alley", "alley"), (1, "spatial", "a left of b", "on the left of"), (2, "spatial", "x on the top of y on the top of z", "on the top of"), (3, "object", "a dog", "dog"), (4, None, "p", "t"), (5, "scene", None, "t"), (6, "object", "a dog", None), (7, "scene", "the Kitchen", "kitchen")]
    got = {}
    for r in M.transform_matrix(spark.createDataFrame(rows, "id int, task string, prompt string, target string"), {"alley": "lane"}).collect():
        got.setdefault(r.id, {})[r.transform] = r
    assert [len(got[i]) for i in range(8)] == [3, 6, 6, 13, 1, 1, 13, 3]
    assert got[0]["synonym"].prompt == "a lane" and got[0]["class_swap"].target == "kitchen" and got[7]["class_swap"].prompt == "a ocean" and got[7]["synonym"].reason == "no_strict_synonym_in_frozen_lexicon"
    assert got[2]["prompt_swap"].prompt == "x on the bottom of y on the top of z" and got[2]["video_mirror"].axis == "vflip" and got[2]["video_mirror"].prompt == rows[2][2] and got[2]["video_mirror_joint"].expected == "invariant"
    assert got[1]["prompt_swap"].prompt == "a left of b" and got[1]["prompt_swap"].target == "on the right of"
    assert got[3]["target_occlusion_0.8"].expected == "fail_if_target_verified_invisible" and got[3]["background_occlusion_1.0"].level == 1.0
    assert not got[6]["identity"].eligible and got[6]["identity"].reason == "no_official_auxiliary_target"
