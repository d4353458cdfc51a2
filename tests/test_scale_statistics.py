"""Quantiles, tau-b and bootstraps that split groups: against Spark's own, every pair, and
the law of the draws."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import concordance as K
from tallyframe.operators import quantiles as Q
from tallyframe.operators import resampling as B


def test_quantiles_equal_percentile(spark):
    rng = random.Random(1)
    rows = [("even", rng.uniform(-5, 5)) for _ in range(900)] + [("wide", rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300)) for _ in range(500)] + [("ties", float(rng.randint(0, 3))) for _ in range(700)]
    rows += [("one", 2.5), ("two", -1.0), ("two", 1.0), (None, 3.0), (None, 9.0), ("tiny", 5e-324), ("tiny", 1e-323), ("tiny", 0.0), ("ends", 1.7e308), ("ends", -1.7e308), ("ends", 0.1), ("null", None), ("even", None), ("same", 7.0), ("same", 7.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    p = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.731, "e": 1.0}
    got = {r.g: r for r in Q.exact_quantiles(df, ["g"], "v", p).collect()}
    want = df.filter("v is not null").groupBy("g").agg(*(F.percentile("v", F.lit(q)).alias(n) for n, q in p.items())).collect()
    assert set(got) == {r.g for r in want} and all(got[r.g][n] == r[n] for r in want for n in p)
    whole = Q.exact_quantiles(df.filter("abs(v) < 100"), [], "v", {"m": 0.5}).first()
    assert whole.m == df.filter("abs(v) < 100").agg(F.percentile("v", F.lit(0.5))).first()[0]
    assert Q.exact_quantiles(df.limit(0), ["g"], "v", p).count() == 0
    with pytest.raises(Exception, match="not finite"):
        Q.exact_quantiles(spark.createDataFrame([("x", float("nan"))], "g string, v double"), ["g"], "v", p).collect()


def test_many_groups_are_joined_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(Q, "FEW", 3)
    df = spark.range(3000).selectExpr("id % 40 AS g", "pow(id % 97, 3) / 7 AS v")
    got = Q.exact_quantiles(df, ["g"], "v", {"m": 0.5}).join(df.groupBy("g").agg(F.percentile("v", F.lit(0.5)).alias("want")), "g").collect()
    assert len(got) == 40 and all(r.m == r.want for r in got)


def plain_pairs(x, y, n):
    return sum(n[i] * n[j] * np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(len(x)) for j in range(i))


def test_signed_pairs_equal_every_pair():
    rng = np.random.default_rng(0)
    for k in range(60):
        m = int(rng.integers(0, 40))
        pairs = list({(int(a), int(b)) for a, b in rng.integers(0, 2 + k % 9, (m, 2))})
        x, y = (np.array([p[i] for p in pairs], float) for i in (0, 1))
        n = rng.integers(1, 5, len(pairs))
        assert K.signed_pairs(x, y, n) == plain_pairs(x, y, n)


@pytest.mark.parametrize("kind", ["continuous", "few levels", "hot value", "constant"])
@pytest.mark.parametrize("ranges", [1, 7])
def test_tau_b_equals_every_pair(spark, kind, ranges):
    rng = np.random.default_rng(3)
    x = rng.normal(size=250)
    y = x * 0.4 + rng.normal(size=250)
    if kind == "few levels":
        x, y = np.round(x), np.round(y * 2)
    if kind == "hot value":
        x[:120], y[60:150] = 0.25, -0.5
    if kind == "constant":
        x[:] = 1.0
    s = plain_pairs(x, y, np.ones(250))
    tx, ty = (sum(c * (c - 1) / 2 for c in np.unique(v, return_counts=True)[1]) for v in (x, y))
    pairs = 250 * 249 / 2
    df = spark.createDataFrame([*zip(x.tolist(), y.tolist(), strict=True), (None, 1.0), (float("nan"), 2.0)], "x double, y double").repartition(4)
    got = K.tau_b(df, "x", "y", ranges).first().tau_b
    assert got is None if kind == "constant" else got == pytest.approx(s / np.sqrt((pairs - tx) * (pairs - ty)), abs=1e-6)


def test_draws_have_the_law_of_a_bootstrap(spark):
    """Each of 60 clusters counted apart: a draw takes 60, every cluster once on average with
    the variance of a multinomial, whatever its bucket."""
    k, draws = 60, 400
    df = spark.range(k).selectExpr("id AS c", "1 AS v")
    sums = {f"m{i}": F.when(F.col("c") == i, 1) for i in range(k)}
    rows = B.resampled_sums(df, "c", sums, draws, 11, buckets=8).collect()
    m = np.array([[r[f"m{i}"] for i in range(k)] for r in sorted(rows, key=lambda r: r.b)])
    assert m.shape == (draws, k) and (m.sum(axis=1) == k).all() and rows[0].clusters == k
    expected = 1 / k * (1 - 1 / k) * k
    assert abs(m.mean(axis=0) - 1).max() < 4.5 * np.sqrt(expected / draws)
    assert abs(m.var(axis=0).mean() / expected - 1) < 0.05
    zero = (m == 0).mean()
    assert abs(zero - (1 - 1 / k) ** k) < 0.02
    c = np.corrcoef(m.T)
    assert abs(c[~np.eye(k, dtype=bool)].mean() + 1 / (k - 1)) < 0.01
    again = B.resampled_sums(df.repartition(7), "c", sums, draws, 11, buckets=8).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_ratios_and_deltas(spark):
    rng = np.random.default_rng(2)
    rows = [(f"c{i % 200}", float(rng.normal(3, 1)), float(rng.normal(2, 0.2)), None if i % 7 == 0 else float(rng.normal(5, 1))) for i in range(1000)]
    df = spark.createDataFrame([*rows, (None, 100.0, 1.0, 1.0)], "c string, a double, b double, d double")
    r = B.ratio_interval(df, "c", F.col("a"), F.col("b"), 500, 3).first()
    a, b = (sum(x[i] for x in rows) for i in (1, 2))
    per = {c: (sum(x[1] for x in rows if x[0] == c), sum(x[2] for x in rows if x[0] == c)) for c in {x[0] for x in rows}}
    error = np.sqrt(sum((p - a / b * q) ** 2 for p, q in per.values())) / b
    assert r.clusters == 200 and r.valid == 500 and r.estimate == pytest.approx(a / b)
    assert (r.high - r.low) / (2 * 1.96 * error) == pytest.approx(1, abs=0.12) and r.low < r.estimate < r.high
    d = B.common_delta(df, "c", "a", "d", 200, 3).first()
    common = [(x[1], x[3]) for x in rows if x[3] is not None]
    assert d.common == len(common) and d.delta == pytest.approx(sum(y - x for x, y in common) / len(common)) and d.low < d.delta < d.high
    one = spark.createDataFrame([("x", 1.0, 0.0), ("x", 2.0, -1.0)], "c string, a double, b double")
    r = B.ratio_interval(one, "c", F.col("a"), F.col("b"), 20, 1).first()
    assert (r.clusters, r.estimate, r.valid, r.low) == (1, None, 0, None)
    some = spark.createDataFrame([("x", 1.0, 1.0), ("y", 1.0, -1.0), ("z", 1.0, 1.0)], "c string, a double, b double")
    r = B.ratio_interval(some, "c", F.col("a"), F.col("b"), 300, 1).first()
    assert 0 < r.valid < 300 and r.estimate == 3.0
    assert B.resampled_sums(df.limit(0), "c", {"v": F.col("a")}, 5, 1).count() == 0
