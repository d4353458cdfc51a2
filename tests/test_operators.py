import math
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import relational as R
from tallyframe.operators import stats as K
from tallyframe.streaming import windows as S


def test_missing_side_stays(spark):
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "uid_a string, uid_b string")
    scores = spark.createDataFrame([("a", 0.0), ("b", 1.0)], "uid string, score double")
    got = {r.uid_b: (r.score_a, r.score_b) for r in R.pair_scores(pairs, scores).collect()}
    assert got == {"b": (0.0, 1.0), "c": (0.0, None)}


def test_tie_margin_equals_trying_every_margin(spark):
    rng = random.Random(3)
    for _ in range(3):
        rows = [(round(rng.random(), 1), round(rng.random(), 1), rng.choice([0.0, 0.5, 1.0])) for _ in range(40)]
        d = [(a - b, y) for a, b, y in rows]

        def accuracy(m, d=d):
            return sum((0.5 if abs(x) <= m else float(x > 0)) == y for x, y in d) / len(d)

        cands = sorted({0.0, *(abs(x) for x, _ in d)})
        best = max(map(accuracy, cands))
        margin = min(m for m in cands if accuracy(m) >= best - 1e-15)
        got = K.tie_margin(spark.createDataFrame(rows, "score_a double, score_b double, label double")).first()
        assert got.margin == pytest.approx(margin, abs=1e-8) and got.dev_accuracy == pytest.approx(best, abs=1e-6)


def test_kendall_by_all_pairs(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 6) / 2, rng.choice([0.0, 0.5, 1.0])) for _ in range(60)]
    c = d = tx = ty = 0
    for i, (x1, y1) in enumerate(rows):
        for x2, y2 in rows[:i]:
            s = (x1 - x2) * (y1 - y2)
            c, d, tx, ty = c + (s > 0), d + (s < 0), tx + (x1 == x2 and y1 != y2), ty + (y1 == y2 and x1 != x2)
    tau = (c - d) / ((c + d + tx) * (c + d + ty)) ** 0.5
    got = K.kendall_tau_b(spark.createDataFrame(rows, "x double, y double"), "x", "y").first().tau_b
    assert got == pytest.approx(tau, abs=1e-6)


def test_auc_by_all_pairs(spark):
    rows = [(1.0, True), (2.0, True), (2.0, False), (0.0, False)]
    got = K.auc_half_ties(spark.createDataFrame(rows, "v double, p boolean"), F.col("p"), "v").first()
    assert got.auc == pytest.approx((1 + 0 + 1 + 0.5) / 4)


def test_coverage_keeps_both_denominators(spark):
    df = spark.createDataFrame([("x", 0.0), ("x", None), ("y", 1.0)], "g string, score double")
    got = {r.g: tuple(r)[1:] for r in K.coverage_summary(df, ["g"]).collect()}
    assert got == {"x": (2, 1, 0.5, 0.0, None), "y": (1, 1, 1.0, 1.0, 1.0)}


def test_bootstrap_needs_two_clusters(spark):
    one = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "c string, v double")
    got = K.cluster_bootstrap(one, "c", "v", 20, 1).first()
    assert (got.clusters, got.estimate, got.low, got.high) == (1, 2.0, None, None)
    two = K.cluster_bootstrap(one.unionByName(spark.createDataFrame([("b", 5.0)], "c string, v double")), "c", "v", 50, 1).first()
    assert two.low <= two.estimate <= two.high


def test_runs_fill_and_conflicts(spark):
    e = spark.createDataFrame([(1, 1, "a", None), (1, 2, "a", 2.0), (1, 3, "b", None), (1, 4, "a", None)], "u int, t int, s string, v double")
    assert sorted((r.run, r.s, r.n) for r in R.runs(e, ["u"], ["t"], "s").collect()) == [(1, "a", 2), (2, "b", 1), (3, "a", 1)]
    assert [r.filled for r in R.forward_backward_fill(e, ["u"], ["t"], "v").orderBy("t").collect()] == [2.0] * 4
    c = spark.createDataFrame([("k", 1, 1), ("k", 0, 2), ("m", 1, 3), ("m", 1, 4)], "key string, label int, i int")
    assert [tuple(r) for r in R.conflict_free(c, "key", "label", "i").collect()] == [("m", 3, 1)]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 100), (7, 7)]
    got = {r.id: r.component for r in R.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and {got[i] for i in (100, 101, 102)} == {100}


def test_group_split_keeps_groups_whole(spark):
    rows = spark.createDataFrame([(f"g{i % 10}", i) for i in range(50)], "g string, i int")
    sides = {}
    for r in R.group_split(rows, "g", 20, 7).collect():
        sides.setdefault(r.g, set()).add(r.side)
    assert all(len(s) == 1 for s in sides.values()) and sum("dev" in s for s in sides.values()) == 2


def test_set_prf1_of_empty_sets(spark):
    df = spark.createDataFrame([([], []), (["a"], []), (["a", "b"], ["a"])], "p array<string>, g array<string>")
    assert [(r.precision, r.recall, round(r.f1, 4)) for r in K.set_prf1(df, "p", "g").collect()] == [(1.0, 1.0, 1.0), (0.0, 0.0, 0.0), (0.5, 1.0, 0.6667)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-01 00:{i:02d}:00", "click" if i % 2 else "view", float(i)) for i in range(0, 60, 7)]
    df = spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "e"))
    live = S.windowed(spark.readStream.schema(df.schema).parquet(str(tmp_path / "e")), "10 minutes")
    q = live.writeStream.format("memory").queryName("tf_live").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r.window.start, r.event_type, r.n, r.total)
    assert sorted(map(key, spark.table("tf_live").collect())) == sorted(map(key, S.windowed(df, "10 minutes").collect()))


def test_grid_gaps_and_baseline(spark):
    g = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), ("b", 1, None)], "base string, level int, v double")
    assert [tuple(r) for r in R.grid_gaps(g, ["base", "level"], [["base"], ["level"]]).collect()] == [("b", 2)]
    got = {(r.base, r.level): r.delta for r in R.to_baseline(g, ["base"], "level", 1, "v").collect()}
    assert got == {("a", 1): 0.0, ("a", 2): 2.0, ("b", 1): None}


def test_window_owner_by_trying_all(spark):
    rng = random.Random(9)
    rows = [(c, round(rng.uniform(0, 50), 3)) for c in "ab" for _ in range(40)]
    got = {(r.c, r.t): r.window for r in R.window_owner(spark.createDataFrame(rows, "c string, t double"), "c", "t", 10.0, 4.0).collect()}
    for c in "ab":
        ts = [t for x, t in rows if x == c]
        lo, hi = min(ts), max(ts)
        last = max(0, -int(-(hi - lo - 10) // 4))
        starts = [lo + min(k * 4.0, max(0.0, hi - lo - 10)) for k in range(last + 1)]
        for t in ts:
            inside = [(min(t - s, s + 10 - t), -k) for k, s in enumerate(starts) if s - 1e-9 <= t <= s + 10 + 1e-9]
            best = max(x for x, _ in inside)
            ties = [-k for x, k in inside if abs(x - best) < 1e-9]
            assert got[c, t] in ties


def test_tracks_follow_boxes_and_gaps(spark):
    rows = [(1, 0, 0, [0.0, 0.0, 4.0, 4.0]), (1, 0, 1, [10.0, 0.0, 14.0, 4.0]), (1, 1, 0, [10.5, 0.0, 14.5, 4.0]), (1, 2, 0, [0.5, 0.0, 4.5, 4.0]), (1, 9, 0, [0.5, 0.0, 4.5, 4.0])]
    df = spark.createDataFrame(rows, "clip long, frame int, det int, box array<double>")
    got = {(r.frame, r.det): r.track for r in R.track_boxes(df).collect()}
    assert got == {(0, 0): 0, (0, 1): 1, (1, 0): 1, (2, 0): 0, (9, 0): 2}


def test_paired_bootstrap_leaves_rows_without_both(spark):
    rows = [("a", 1.0, 2.0), ("a", None, 9.0), ("b", 2.0, 3.0), ("c", 0.0, 1.0)]
    got = K.paired_bootstrap(spark.createDataFrame(rows, "c string, a double, b double"), "c", "a", "b", 30, 1).first()
    assert tuple(got) == (3, 3, 1.0, 1.0, 1.0)


def test_correlation_of_what_does_not_vary(spark):
    rows = spark.createDataFrame([(0.5, 1.0), (0.5, 2.0), (0.5, 4.0)], "x double, y double")
    got = lambda df, a, b: df.agg(K.pearson(a, b).alias("r")).first().r
    assert math.isnan(got(rows, "x", "y")) and math.isnan(got(rows.limit(1), "x", "y")) and got(rows.limit(0), "x", "y") is None
    assert got(rows, "y", "y") == pytest.approx(1.0)


def test_methods_whose_labels_all_tie_match_sql(spark, tmp_path):
    """Labels that do not vary have no correlation, and no query fails over them."""
    import duckdb

    import __spark_entry__ as entry

    rng = random.Random(5)
    part = [(p, f"Brand#{p % 6}") for p in range(24)]
    items = [(rng.randrange(24), n % 7 + 1, rng.randrange(11) / 100, 0.03) for n in range(400)]
    spark.createDataFrame(part, "p_partkey long, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame(items, "l_partkey long, l_linenumber int, l_discount double, l_tax double").write.parquet(str(tmp_path / "lineitem.parquet"))
    db = duckdb.connect()
    for t in ("part", "lineitem"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("pairs_model_pearson", "pairs_kendall", "method_comparison"):
        got, want = tuple(entry.queries()[name](spark, str(tmp_path)).first()), db.execute(entry.oracle_sql()[name]).fetchall()[0]
        assert got == pytest.approx(want, nan_ok=True, abs=1e-9), name


@pytest.mark.parametrize("clips", [1, 3])
def test_tracks_do_not_depend_on_batches(spark, clips):
    rng = random.Random(clips)
    rows = [(c, f, d, [x, y, x + rng.randrange(1, 9), y + rng.randrange(1, 9)]) for c in range(clips) for f in range(60) for d in range(rng.randrange(5)) for x, y in [(rng.randrange(6) + 0.5, rng.randrange(6) + 0.25)]]
    df = spark.createDataFrame(rows, "clip long, frame int, det int, box array<double>")
    want = {(r.clip, r.frame, r.det): r.track for r in R.track_boxes(df).collect()}
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        small = R.track_boxes(df)
        assert "FlatMapGroups" not in small._jdf.queryExecution().toString()  # no call a clip
        assert {(r.clip, r.frame, r.det): r.track for r in small.collect()} == want and len(want) == len(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
