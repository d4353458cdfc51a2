"""Motion fields: what is smooth, what is not, and the warp against a plain loop."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import fields as K
from tallyframe.operators import motion as M

SCHEMA = "clip string, index int, height int, width int, flow array<double>, valid array<boolean>, dt double"
H, W = 6, 8


def rows(clip, vectors, dts=None, valid=None):
    out = []
    for i, v in enumerate(vectors):
        v = np.asarray(v if np.ndim(v) else (v, 0.0), float)
        flow = np.broadcast_to(v, (H, W, 2)) if v.shape == (2,) else v
        out.append((clip, i, H, W, flow.ravel().tolist(), valid, float(dts[i]) if dts else 1.0))
    return out


def plain_warp(field, shift, valid):
    height, width = field.shape[:2]
    out, ok = np.zeros_like(field), np.zeros((height, width), bool)
    for y in range(height):
        for x in range(width):
            sx, sy = x + shift[y, x, 0], y + shift[y, x, 1]
            if not (0 <= sx <= width - 1 and 0 <= sy <= height - 1):
                continue
            x0, y0 = math.floor(sx), math.floor(sy)
            parts = [(x0 + i, y0 + j, (sx - x0 if i else 1 - sx + x0) * (sy - y0 if j else 1 - sy + y0)) for i in (0, 1) for j in (0, 1)]
            parts = [p for p in parts if p[2] > K.TINY]
            if all(valid[b, a] for a, b, _ in parts):
                ok[y, x] = True
                out[y, x] = sum(w * field[b, a] for a, b, w in parts)
    return out, ok


def test_warp_equals_a_plain_loop():
    rng = np.random.default_rng(0)
    for _ in range(20):
        f, valid = rng.normal(size=(3, 5, 7, 2)), rng.random((3, 5, 7)) > 0.15
        shift = np.where(rng.random((3, 5, 7, 2)) < 0.3, rng.integers(-2, 3, (3, 5, 7, 2)), rng.normal(size=(3, 5, 7, 2)) * 2)
        out, ok = K.warp(f, shift, valid)
        for k in range(3):
            want, want_ok = plain_warp(f[k], shift[k], valid[k])
            assert (ok[k] == want_ok).all() and np.allclose(out[k], want)
    # Half a pixel along a ramp, and a masked column.
    ramp = np.stack([np.broadcast_to(np.arange(W, dtype=float), (H, W)), np.zeros((H, W))], axis=-1)[None]
    half = np.zeros((1, H, W, 2))
    half[..., 0] = 0.5
    out, ok = K.warp(ramp - [0.5, 0.0], half, np.ones((1, H, W), bool))
    assert ok[:, :, :-1].all() and not ok[:, :, -1].any() and np.allclose(out[ok], ramp[ok])
    one, gap = np.zeros((1, H, W, 2)), np.ones((1, H, W), bool)
    one[..., 0], gap[..., 3] = 1.0, False
    _, ok = K.warp(np.ones((1, H, W, 2)), one, gap)
    assert ok[..., :2].all() and not ok[..., 2].any() and not ok[..., -1].any()


@pytest.fixture(scope="module")
def scores(spark):
    angles = np.linspace(0, math.pi / 2, 8)
    clips = {
        "one": [1] * 8, "three": [3] * 8, "half": [0.5] * 8, "gradual": [1, 2, 3, 4, 5, 6, 7, 8], "abrupt": [1, 1, 1, 5, 1, 1, 1, 1], "stall": [1, 1, 1, 0, 1, 1, 1, 1], "jump": [1, 1, 1, 4, 1, 1, 1, 1],
        "curved": [(math.cos(a), math.sin(a)) for a in angles], "reversal": [(1, 0), (1, 0), (1, 0), (-1, 0), (1, 0), (1, 0), (1, 0), (1, 0)], "static": [0] * 4, "two": [1, 5], "single": [2], "still": [0] * 3,
    }
    every = [r for c, v in clips.items() for r in rows(c, v)]
    every += rows("physical", [1, 2, 3, 4, 5]) + rows("resampled", [2, 4, 6, 8, 10], [2] * 5) + rows("masked", [1, 9, 1, 7], valid=[False] * (H * W))
    df = spark.createDataFrame(every, SCHEMA).repartition(5)
    return {r.clip: r for r in M.motion_smoothness(df).collect()}, df


def test_smooth_motion_scores_higher(scores):
    s, _ = scores
    for name in ("one", "three", "half", "static", "still", "two", "single", "masked"):
        assert s[name].discontinuity < 1e-12 and s[name].score == pytest.approx(1.0)
    assert s["gradual"].score > s["abrupt"].score and s["one"].score > s["stall"].score and s["one"].score > s["jump"].score
    assert s["curved"].mean_direction > 0 and s["curved"].score > s["reversal"].score
    assert s["two"].status == s["single"].status == "insufficient_motion_states" and s["two"].fields == 2 and s["two"].mean_discontinuity is None
    assert s["physical"].score == pytest.approx(s["resampled"].score, abs=1e-12) and s["masked"].mean_motion == 0


def test_top_and_tail(spark, scores):
    _, df = scores
    steps = {}
    for r in M.changes(M.checked_fields(df)).collect():
        steps.setdefault(r.clip, []).append(r.discontinuity)
    tail = {r.clip: r for r in M.motion_smoothness(df, M.Smoothness(aggregation="mean_tail", tail_quantile=0.6)).collect()}
    for clip, r in scores[0].items():
        d = sorted(steps.get(clip, []), reverse=True)
        if len(d) >= 2:
            assert r.discontinuity == pytest.approx(sum(d[:3]) / len(d[:3])) and r.score == pytest.approx(math.exp(-r.discontinuity))
            k = max(1, math.ceil(0.4 * len(d) - 1e-12))
            assert tail[clip].discontinuity == pytest.approx(0.75 * sum(d) / len(d) + 0.25 * sum(d[:k]) / k)
    for bad in ({"aggregation": "median"}, {"top_k": 0}, {"top_k": -1}, {"top_k": True}, {"eps": 0.0}, {"magnitude_weight": 0.0, "direction_weight": 0.0}, {"tail_quantile": 1.5}):
        with pytest.raises(ValueError):
            M.Smoothness(**bad)


def test_acceleration_and_jerk(spark):
    df = spark.createDataFrame(rows("a", [0, 1, 3, 6], [1, 2, 1, 0.5]) + rows("b", [1]), SCHEMA)
    speed = [0, 0.5, 3, 12]
    got = {r["index"]: r for r in M.acceleration(df).collect()}
    assert sorted(got) == [1, 2, 3]
    for i, r in got.items():
        values, ok = np.array(r["values"]).reshape(H, W, 2), np.array(r.valid).reshape(H, W)
        dt = [1, 2, 1, 0.5]
        assert np.allclose(values[ok][:, 0], (speed[i] - speed[i - 1]) / dt[i]) and ok[:, : W - [0, 1, 3, 6][i - 1]].all() and not ok[:, W - [0, 1, 3, 6][i - 1] :].any()
    j = {r["index"]: r for r in M.jerk(df).collect()}
    assert sorted(j) == [2, 3]
    ok = np.array(j[3].valid).reshape(H, W)
    assert np.allclose(np.array(j[3]["values"]).reshape(H, W, 2)[ok][:, 0], (18 - 2.5) / 0.5) and ok.any()


@pytest.mark.parametrize("column,sql", [("dt", "0D"), ("dt", "double('nan')"), ("flow", "slice(flow, 1, 90)"), ("flow", "transform(flow, x -> double('inf'))"), ("width", "if(index = 1, 4, width)")])
def test_faulty_fields_fail_the_query(spark, column, sql):
    df = spark.createDataFrame(rows("a", [1, 1, 1]), SCHEMA).withColumn(column, F.expr(sql))
    with pytest.raises(Exception, match="dt has to be|shape|finite"):
        M.motion_smoothness(df).collect()


def test_flicker(spark):
    frames = spark.createDataFrame([("a", 0, [0, 10, 20]), ("a", 1, [30, 10, 20]), ("a", 2, [0, 0, 0]), ("b", 0, [5]), ("b", 1, [5])], "clip string, index int, pixels array<int>")
    got = {r.clip: r for r in M.flicker_score(frames).collect()}
    assert got["a"].score == pytest.approx((255 - (10 + 20) / 2) / 255) and got["b"].score == 1.0 and got["a"].steps == 2
    with pytest.raises(Exception, match="two frames"):
        M.flicker_score(frames.filter("index = 0")).collect()
    with pytest.raises(Exception, match="differ in size"):
        M.flicker_score(frames.withColumn("pixels", F.when(F.col("index") == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.col("pixels")))).collect()
