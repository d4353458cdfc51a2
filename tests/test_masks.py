"""Run-length masks against dense ones, noise that no split changes, plans of ladders."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import masks as M
from tallyframe.operators import perturbations as P

H, W = 7, 9


def runs_of(dense):
    flat = np.concatenate([[0], dense.ravel().astype(int), [0]])
    edges = np.flatnonzero(np.diff(flat)).reshape(-1, 2)
    return [(int(a), int(b - a)) for a, b in edges]


def grown(dense, r):
    out = np.zeros_like(dense)
    for y, x in np.argwhere(dense):
        out[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1] = True
    return out


def test_runs_equal_dense_masks(spark):
    rng = np.random.default_rng(0)
    rows, dense = [], {}
    for i in range(60):
        a, b = rng.random((2, H, W)) < rng.choice([0, 0.1, 0.5, 0.9, 1])
        dense[i] = a, b
        loose = [(s, n) for s, n in runs_of(a) for _ in range(2)] + [(s + 1, n - 1) for s, n in runs_of(a)]
        random.Random(i).shuffle(loose)
        rows.append((i, i % 7, loose, runs_of(b)))
    df = spark.createDataFrame(rows, f"i int, clip int, loose {M.RUNS}, b {M.RUNS}").withColumn("a", M.joined_runs(F.col("loose")))
    h, w = F.lit(H), F.lit(W)
    a, b = F.col("a"), F.col("b")
    out = df.select("i", "clip", "a", M.covered(a).alias("n"), M.dilated(a, h, w, 1).alias("d1"), M.dilated(a, h, w, 2).alias("d2"), M.inverted(a, h, w).alias("inv"), M.intersection(a, b, h, w).alias("both"), M.union(a, b).alias("any"))
    for r in out.collect():
        x, y = dense[r.i]
        for got, want in ((r.a, x), (r.d1, grown(x, 1)), (r.d2, grown(x, 2)), (r.inv, ~x), (r.both, x & y), (r["any"], x | y)):
            assert [tuple(s) for s in got] == runs_of(want)
        assert r.n == x.sum()
    union = {r.clip: [tuple(s) for s in r.a] for r in M.union_over_time(df, "clip", "a").collect()}
    assert union == {c: runs_of(np.any([dense[i][0] for i in range(60) if i % 7 == c], axis=0)) for c in range(7)}
    empty = spark.createDataFrame([(1, [])], f"clip int, runs {M.RUNS}")
    assert M.union_over_time(empty, "clip").first().runs == []


def test_boxes(spark):
    rng = random.Random(3)
    cases = []
    for _ in range(40):
        boxes = []
        for _ in range(rng.randint(0, 4)):
            x, y = rng.uniform(0, W - 1), rng.uniform(0, H - 1)
            boxes.append([x, y, rng.uniform(x + 0.01, W), rng.uniform(y + 0.01, H)])
        cases.append(boxes)
    df = spark.createDataFrame(list(enumerate(cases)), "i int, boxes array<array<double>>")
    for r in df.select("i", M.box_runs(F.col("boxes"), F.lit(H), F.lit(W)).alias("runs")).collect():
        dense = np.zeros((H, W), bool)
        for x1, y1, x2, y2 in cases[r.i]:
            dense[int(np.floor(y1)) : int(np.ceil(y2)), int(np.floor(x1)) : int(np.ceil(x2))] = True
        assert [tuple(s) for s in r.runs] == runs_of(dense)
    for bad in ([0, 0, W + 1, 1], [1, 1, 1, 2], [-1, 0, 1, 1], [0, 0, float("nan"), 1], [0, 0, 1], [0, 0, 1, None]):
        with pytest.raises(Exception, match="invalid detector rectangle"):
            spark.createDataFrame([([[float(x) if x is not None else None for x in bad]],)], "boxes array<array<double>>").select(M.box_runs(F.col("boxes"), F.lit(H), F.lit(W))).collect()


def test_foreground_is_suppressed(spark):
    rng = np.random.default_rng(1)
    x, mask = rng.integers(0, 256, (H, W, 3), dtype=np.uint8), rng.random((H, W)) < 0.3
    df = spark.createDataFrame([(H, W, bytearray(x.tobytes()), runs_of(mask))], f"height int, width int, pixels binary, runs {M.RUNS}")
    r = M.suppressed(df, (1, 2, 3)).first()
    want = x.copy()
    want[mask] = (1, 2, 3)
    assert np.array_equal(np.frombuffer(r.pixels, np.uint8).reshape(H, W, 3), want) and r.visible == pytest.approx(1 - mask.mean())
    with pytest.raises(ValueError):
        M.suppressed(df, (1, 2, 300))
    with pytest.raises(Exception, match="size of the frame"):
        M.suppressed(df.withColumn("width", F.lit(W - 1))).collect()


def frames(spark, n=6, h=16, w=24):
    rng = np.random.default_rng(2)
    x = rng.integers(60, 190, (n, h, w, 3), dtype=np.uint8)
    return x, spark.createDataFrame([(c, i, h, w, bytearray(x[i].tobytes())) for c in "ab" for i in range(n)], "clip string, index int, height int, width int, pixels binary")


def test_noise_is_the_same_under_any_split(spark):
    x, df = frames(spark)
    plan = spark.createDataFrame([(c, k, f, 9.0, s) for c in "ab" for k, (f, s) in enumerate((f, s) for f in P.FAMILIES for s in (3, 4))], "clip string, variant int, family string, amplitude double, seed int")
    digest = lambda frames, p: {tuple(r) for r in P.digests(P.perturbed(frames, p), ["clip", "variant"]).collect()}
    one = digest(df.coalesce(1), plan.coalesce(1))
    assert one == digest(df.repartition(7), plan.repartition(3))
    by = {(c, v): d for c, v, d in one}
    assert all(by["a", v] == by["b", v] for v in range(14)) and len({by["a", v] for v in range(2, 14)}) == 12 and by["a", 0] == by["a", 1]
    rows = {(r.variant, r["index"]): r for r in P.perturbed(df, plan).filter("clip = 'a'").collect()}
    for v, family in enumerate(f for f in P.FAMILIES for _ in (3, 4)):
        for i in range(6):
            after = np.frombuffer(rows[v, i].pixels, np.uint8).reshape(x[i].shape).astype(int) - x[i].astype(int)
            assert abs(after).max() <= 9 and rows[v, i].clipped == 0 and rows[v, i].difference == pytest.approx(abs(after).mean())
            if family.endswith("alternating"):
                assert np.sign(after[8, 12, 0]) == (-1) ** (i + (3, 4)[v % 2] % 2)
            if family.startswith("local"):
                assert not after[0, 0].any()
            if family == "clean":
                assert not after.any()
    with pytest.raises(Exception, match="unknown family"):
        P.perturbed(df, plan.withColumn("family", F.lit("other"))).collect()


def test_counted_values_are_uniform():
    u = np.concatenate([P.counted_uniform(7, f, 5000) for f in range(20)])
    assert u.min() >= -1 and u.max() < 1 and abs(u.mean()) < 0.01 and abs(u.var() - 1 / 3) < 0.01
    counts = np.histogram(u, 50, (-1, 1))[0]
    assert ((counts - 2000) ** 2 / 2000).sum() < 90
    assert abs(np.corrcoef(u[:-1], u[1:])[0, 1]) < 0.02 and abs(np.corrcoef(P.counted_uniform(1, 0, 5000), P.counted_uniform(2, 0, 5000))[0, 1]) < 0.05
    flat = P.enlarged(np.ones((12, 16, 3)), 30, 50)
    assert flat.shape == (30, 50, 3) and np.allclose(flat, 1)


def test_ladder_plans(spark):
    s = spark.createDataFrame([("x",)], "source string")
    full = P.ladder_plan(s, ["pixel_rgb", "global_random"], [2, 8], [1, 2], [0, 1, 3]).collect()
    assert len(full) == 9 + 3 * 9 + 2 * 2 and len({r.variant for r in full}) == len(full)
    strong = P.ladder_plan(s, ["pixel_rgb", "global_random"], [2, 8], [1, 2], [0, 1, 3], True).collect()
    assert len(strong) == 9 + 3 * 5 + 2 * 2 and {r.amplitude for r in strong if r.kind == "translation"} == {0.0, 8.0}
    assert {(r.motion, r.family, r.amplitude, r.seed) for r in full if r.kind == "oscillation"} == {(m, *v) for m in (1, 3) for v in (("clean", 0.0, 0), ("pixel_rgb", 8.0, 1))}


def test_cards_move_over_a_ground_that_stays(spark):
    image = np.random.default_rng(4).integers(0, 256, (40, 120, 3), dtype=np.uint8)
    one, three = (P.moving_card(image, s, 12, [0, 1, 3]) for s in (1, 3))
    still = P.moving_card(image, 0, 12, [0, 1, 3])
    assert (still == still[0]).all() and np.array_equal(one[0], three[0]) and np.array_equal(one[0], still[0])
    x = (120 - 20) // 2 - 11 * 3 / 2
    for t in range(12):
        for f, s in ((one, 1), (three, 3)):
            a, b = int(round(x)), int(round(x + s * t))
            assert np.array_equal(f[t, 15:25, b + 5 : b + 15], f[0, 15:25, a + 5 : a + 15])  # the card inside its soft edge
            assert np.array_equal(f[t, :10], f[0, :10]) and np.array_equal(f[t, 10:30, :a], f[0, 10:30, :a])
    back = P.moving_card(image, 3, 12, [0, 1, 3], oscillating=True)
    assert np.array_equal(back[8], back[0]) and np.array_equal(back[3], three[3]) and np.array_equal(back[5], three[3])
    with pytest.raises(ValueError, match="leaves the frame"):
        P.moving_card(image[:, :60], 6, 12, [6])
    df = spark.createDataFrame([("a", 40, 120, bytearray(image.tobytes()))], "clip string, height int, width int, pixels binary")
    plan = spark.createDataFrame([("a", 0, "static", 0), ("a", 1, "translation", 1), ("a", 2, "oscillation", 3)], "clip string, variant int, kind string, motion int")
    got = {(r.variant, r["index"]): np.frombuffer(r.pixels, np.uint8).reshape(40, 120, 3) for r in P.card_frames(df, plan, 12, [0, 1, 3]).collect()}
    assert len(got) == 36 and np.array_equal(got[0, 7], image) and np.array_equal(got[1, 5], one[5]) and np.array_equal(got[2, 9], back[9])
    assert np.allclose(P._areas(7, 3).sum(axis=1), 1) and np.allclose(P._areas(6, 3) @ np.arange(6), [0.5, 2.5, 4.5])


def test_runs_to_join_are_computed_once(spark):
    df = spark.createDataFrame([([(5, 2), (0, 3), (2, 3), (9, 1), (9, 0)],), ([],), (None,)], f"r {M.RUNS}")
    out = df.select(M.joined_runs(F.reverse("r")).alias("r"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("reverse(") == 1
    assert [None if x.r is None else [tuple(y) for y in x.r] for x in out.collect()] == [[(0, 7), (9, 1)], [], None]
