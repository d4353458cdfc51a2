"""Consistency against numpy, degrees of motion by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import dimensions as D


def test_consistency_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 3)
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for c, n in (("a", 9), ("b", 2), ("c", 6)):
        x = rng.normal(size=(n, 5))
        gone = {2} if c == "c" else set()
        for i in range(n):
            rows += [(c, i, 0.0 if i in gone else float(w), x[i].tolist()) for w in (1, 2)] + [(c, i, 0.0, (-x[i] * 9).tolist())]
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        s = np.clip(u @ u.T, 0, None)
        for g in gone:
            s[g], s[:, g] = 0, 0
        want[c] = (np.diag(s, 1).mean(), s[0, 1:].mean(), s[np.triu_indices(n, 1)].mean(), n - len(gone))
    df = spark.createDataFrame(rows, "clip string, index int, weight double, vector array<double>").repartition(4)
    got = {r.clip: r for r in D.consistency(D.pooled(df)).collect()}
    assert all((got[c].local, got[c].anchored, got[c].pairs, got[c].valid) == pytest.approx(w) for c, w in want.items())
    s = {r.clip: r for r in D.subject_consistency(df).collect()}
    assert s["a"].score == pytest.approx((want["a"][0] + want["a"][2]) / 2) and (s["a"].status, s["c"].status) == ("succeeded", "partial")
    b = {r.clip: r for r in D.background_consistency(df).collect()}
    assert b["b"].score == pytest.approx(min(1, max(0, 1 - 1.75 * (1 - want["b"][2]))))
    with pytest.raises(Exception, match="two frames or more"):
        D.subject_consistency(df.filter("clip = 'a' and index = 0")).collect()
    with pytest.raises(Exception, match="finite and not zero"):
        D.subject_consistency(df.withColumn("vector", F.transform("vector", lambda x: x * 0))).collect()
    with pytest.raises(Exception, match="negative or none"):
        D.subject_consistency(df.withColumn("weight", -F.col("weight") - 1)).collect()


def test_degrees_of_motion(spark):
    schema = "clip string, index int, height int, width int, dt double, target string, apparent double, camera double, residual double"
    rows = [("a", i, 256, 256, 0.125, "any", 7.0 if i < 4 else 0.0, 5.0, 2.0) for i in range(15)] + [("b", i, 256, 256, 0.125, "camera", 7.0 if i < 3 else 0.0, 5.0, 2.0) for i in range(15)]
    rows += [("c", 0, 256, 256, 0.125, "subject", 0.0, 0.0, 3.0), ("d", 0, 256, 256, 0.125, "other", 9.0, 9.0, 9.0), ("e", 0, 256, 256, 0.125, "any", None, None, None)]
    got = {r.clip: r for r in D.dynamic_degree(spark.createDataFrame(rows, schema)).collect()}
    diagonal = 256 * 2**0.5
    assert got["a"].official_moves and not got["b"].official_moves  # four of sixteen frames are asked for
    assert got["a"].score == pytest.approx(7 * 4 / 15 / diagonal / 0.125**0.5) and got["b"].score == pytest.approx(5 / diagonal / 0.125**0.5) and got["a"].significant_share == pytest.approx(4 / 15)
    assert got["c"].official_moves and not got["c"].moves and got["c"].score == pytest.approx(3 / diagonal / 0.125**0.5)
    assert (got["d"].status, got["d"].score) == ("unresolved", None) and (got["e"].status, got["e"].score) == ("insufficient_transitions", None)
    with pytest.raises(Exception, match="several targets"):
        D.dynamic_degree(spark.createDataFrame([rows[0], (*rows[1][:5], "camera", *rows[1][6:])], schema)).collect()
    m = D.dataset_mean(D.dynamic_degree(spark.createDataFrame(rows, schema))).first()
    assert (m.clips, m.scored, m.mean) == (5, 3, None) and m.observed_mean is not None
    flow = spark.createDataFrame([([3.0, 4.0, 0.0, 1.0] * 20,)], "flow array<double>")
    assert flow.select(D.top_mean_of(F.col("flow")).alias("x")).first().x == 5.0
