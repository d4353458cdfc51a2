import pytest
from pyspark.sql import functions as F

from tallyframe.operators import bootstrap as B
from tallyframe.operators import contracts as C
from tallyframe.operators import dataprep as D
from tallyframe.operators import relational as R


def test_contracts_raise(spark):
    a = spark.createDataFrame([(1, 0.5), (2, None)], "k int, v double")
    twice = a.unionByName(a)
    assert C.require_unique(a, ["k"]).count() == 2 and C.require_range(a, "v", 0, 1).count() == 2
    with pytest.raises(Exception, match="duplicate key"):
        C.require_unique(twice, ["k"]).collect()
    with pytest.raises(Exception, match="out of range"):
        C.require_range(a, "v", 0.6, 1).collect()
    b = spark.createDataFrame([(1, "x"), (3, "y")], "k int, w string")
    with pytest.raises(Exception, match="one side only"):
        C.strict_join(a, b, ["k"]).collect()
    assert C.strict_join(a, spark.createDataFrame([(1, "x"), (2, "y")], "k int, w string"), ["k"]).count() == 2
    C.closure(5, 3, 2)
    with pytest.raises(ValueError):
        C.closure(5, 3, 1)


def test_dataprep(spark):
    obs = spark.createDataFrame([("k", "a", 1), ("k", "b", 2), ("m", "a", 3), ("m", "a", 4)], "key string, label string, id int")
    got = {r.key: (r.label, r.ids, r.conflict) for r in D.merge_observations(obs, "key", "label", "id").collect()}
    assert got == {"k": (None, [1, 2], True), "m": ("a", [3, 4], False)}
    passes = spark.createDataFrame([(1, 0, "x"), (1, 1, "x"), (2, 0, "x"), (2, 1, "y"), (2, 2, "y"), (3, 0, "x"), (3, 1, "y")], "i int, n int, a string")
    assert {r.i: (r.answer, r.state) for r in D.arbitrate(passes, "i", "n", "a").collect()} == {1: ("x", "accepted"), 2: ("y", "arbitrated"), 3: (None, "rejected")}
    rows = spark.createDataFrame([("a", "g1"), ("b", "g1"), ("c", "g2")], "k string, g string")
    roles = {r.k: r.role for r in D.leakage_safe(rows, rows.filter("k = 'a'"), "k", "g", 1).collect()}
    assert roles["a"] == "reserved" and roles["b"] == "quarantine" and roles["c"] in ("dev", "train")


def test_identity_and_reviews(spark):
    inputs = spark.createDataFrame([(1, "a", "p"), (2, "b", None)], "id int, sha string, prompt string")
    scores = inputs.withColumn("score", F.lit(0.5))
    assert C.same_identity(scores, inputs, ["id"], ["sha", "prompt"]).count() == 2
    changed = scores.withColumn("sha", F.when(F.col("id") == 2, "x").otherwise(F.col("sha")))
    for bad, match in ((changed, "identity changed"), (scores.filter("id = 1"), "one side only"), (scores.unionByName(scores), "duplicate key")):
        with pytest.raises(Exception, match=match):
            C.same_identity(bad, inputs, ["id"], ["sha", "prompt"]).collect()
    review = spark.createDataFrame([(2, "b")], "id int, sha string")
    assert [r.id for r in C.reviewed(scores, review, ["id"], ["sha"]).collect()] == [2]
    for bad in ([(2, "x")], [(3, "c")]):
        with pytest.raises(Exception, match="review of other content"):
            C.reviewed(scores, spark.createDataFrame(bad, "id int, sha string"), ["id"], ["sha"]).collect()


def test_aliases(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(21)], "alias int, target int")
    assert {r.canonical for r in R.alias_closure(chain, "alias", "target").collect()} == {0}
    for n in (1, 2, 3, 7, 8):
        ring = spark.createDataFrame([(i, (i + 1) % n) for i in range(n)] + [(50, 0)], "alias int, target int")
        with pytest.raises(Exception, match="cycle"):
            R.alias_closure(ring, "alias", "target").collect()


def test_windows_and_gates(spark):
    n = spark.createDataFrame([(16,), (10,), (2,), (1,)], "t int")
    got = [r.w and [(x.width, x.first) for x in r.w] for r in n.select(R.fixed_windows(F.col("t")).alias("w")).collect()]
    assert got == [[(4, 0), (4, 6), (4, 12)], [(2, 0), (2, 4), (2, 8)], None, None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([0.0, -0.3, 0.3, 0.25, None])], "k int, v double")
    out = B.effects(rows, "k", "v", 200, 3)
    r = out.first()
    assert (r.n, r.signed_median, r.size_median, r.zero_effects) == (4, 0.125, 0.275, 1)
    assert out.select(B.gate("change").alias("g")).first().g == (r.size_median_low > 0.1)
    one = B.resampled(rows.withColumn("c", F.lit(1)), "c", ["v"], 10, 1).first()
    assert one.clusters == 1 and one.v_mean_low is None and one.v_median == 0.125


def test_macro_interval_counts_undefined_draws(spark):
    rows = spark.createDataFrame([("f1", "x", 1.0), ("f2", "y", 0.0), ("f3", "x", 0.0)], "f string, s string, v double")
    r = B.macro_interval(rows, "f", "s", ["x", "y"], "v", 200, 5).first()
    assert (r.families, r.estimate) == (3, 0.25) and 0 < r.bootstrap_valid < 200 and r.low <= r.estimate <= r.high
    r = B.macro_interval(rows, "f", "s", ["x", "y", "z"], "v", 20, 5).first()
    assert (r.estimate, r.bootstrap_valid, r.low) == (None, 0, None)
