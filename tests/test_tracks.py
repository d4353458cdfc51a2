"""Camera fits on known motion, and evidence of tracks that is supported or is not."""

import numpy as np
import pytest

from tallyframe.functions import camera as K
from tallyframe.functions import tracks as P
from tallyframe.operators import tracks as T


def similar(h, w, angle=0.0, scale=1.0, tx=0.0, ty=0.0):
    """Motion about the middle of the field."""
    place = np.arange(w) + 1j * np.arange(h)[:, None]
    middle = (w - 1) / 2 + 1j * (h - 1) / 2
    moved = scale * np.exp(1j * angle) * (place - middle) + middle + tx + 1j * ty - place
    return np.stack([moved.real, moved.imag], axis=-1)


def shifted(part, by=5.0):
    flow = np.zeros((64, 64, 2))
    flow[:] = (2.0, 0.0)
    flow[part, part, 0] += by
    return flow


FIELDS = {
    "still": np.zeros((64, 64, 2)), "rotation": similar(64, 64, 0.05, 1, 2, -1), "zoom": similar(64, 64, 0, 1.04, 1, 2), "small object": shifted(slice(24, 40)), "large object": shifted(slice(12, 52)), "dominant object": shifted(slice(8, 56)),
    "parallax": np.stack([np.where(np.arange(64)[None, :] < 32, -3.0, 3.0) + np.zeros((64, 1)), np.zeros((64, 64))], axis=-1), "one pixel": np.full((1, 1, 2), 3.0), "thin": np.ones((1, 7, 2)),
}


@pytest.fixture(scope="module")
def decomposed(spark):
    rows = [(n, 0, f.shape[0], f.shape[1], f.ravel().tolist()) for n, f in FIELDS.items()]
    df = spark.createDataFrame(rows, "clip string, index int, height int, width int, flow array<double>")
    return {r.clip: r for r in T.decompose_motion(df.repartition(3)).collect()}, df


def test_cameras_and_objects(decomposed):
    d, df = decomposed
    assert d["still"].camera.maximum == pytest.approx(0, abs=1e-9) and d["still"].residual.maximum == pytest.approx(0, abs=1e-9)
    for name in ("rotation", "zoom"):
        assert d[name].residual.top5_mean < 1e-4 and d[name].inlier_ratio > 0.99 and not d[name].fallback
    a = d["rotation"].affine
    assert a[0] == pytest.approx(np.cos(0.05)) and a[3] == pytest.approx(np.sin(0.05)) and a[1] == pytest.approx(-a[3])
    for name in ("small object", "large object"):
        assert d[name].camera.top5_mean == pytest.approx(2.0, abs=1e-3) and d[name].residual.top5_mean > 4.9
    assert d["dominant object"].inlier_ratio < 0.75 and d["dominant object"].residual.top5_mean > 4.9
    assert d["parallax"].inlier_ratio < 0.75 and d["parallax"].residual.top5_mean > 1.0
    assert d["one pixel"].candidate_strategy == "initial_fit_failed" and d["one pixel"].residual.top5_mean == pytest.approx(np.hypot(3, 3)) and d["one pixel"].initial_candidate_count == 1
    assert d["thin"].fallback and "insufficient_consistent_candidates_using_initial" in d["thin"].fallback_reason
    again = {r.clip: r for r in T.decompose_motion(df.orderBy("clip").coalesce(1)).collect()}
    assert again == d
    off = {r.clip: r for r in T.decompose_motion(df, compensate=False).collect()}
    assert off["rotation"].camera.maximum == 0 and off["rotation"].residual == off["rotation"].apparent and off["zoom"].fallback_reason == "global_compensation_disabled"


def test_places_are_thinned_and_bad_fields_fail(spark):
    flow, how = K.decompose(similar(300, 200, 0.01), K.Camera(most=500))
    assert how["initial_candidate_count"] <= 600 and np.allclose(flow, similar(300, 200, 0.01), atol=1e-6)
    bad = spark.createDataFrame([("a", 0, 2, 2, [float("nan")] * 8)], "clip string, index int, height int, width int, flow array<double>")
    with pytest.raises(Exception, match="finite"):
        T.decompose_motion(bad).collect()


# ---- tracks --------------------------------------------------------------------------------


def evidence(spark, way=1.0, moved=0.0, still=1.0, cycle=0.0, inside=None, points=4):
    rows = [("c", i, 192, 256, 1 / 8, [way] * points, [moved] * points, [still] * points, [cycle] * points, [True] * points, inside or [True] * points) for i in range(3)]
    return spark.createDataFrame(rows, T.EVIDENCE)


def score(df, **config):
    return T.track_scores(df, T.Trajectory(**config)).first()


def test_scores_of_evidence(spark):
    s = score(evidence(spark, 2.0, 0.1, 0.01))
    assert s.score == 0 and s.status == "succeeded" and s.coverage == 1 and s.raw_tracks > 0
    assert [score(evidence(spark, w)).score for w in (1.0, 2.0, 4.0)] == pytest.approx([8 / 192, 16 / 192, 32 / 192])
    s = score(evidence(spark, moved=3.0, still=3.0))
    assert s.status == "insufficient_evidence" and s.score is None
    half = [False, False, True, True]
    assert score(evidence(spark, inside=half), min_coverage=0.5).score == pytest.approx(score(evidence(spark)).score / 2)
    assert score(evidence(spark, cycle=20.0)).score is None and score(evidence(spark, cycle=20.0, still=0.0)).score == 0
    s = score(evidence(spark, 0.2))
    assert s.score == 0 and s.verified_correspondence > 0 and s.valid_pairs == s.total_pairs == 12
    for bad in ("dt = 0D", "displacement = array(-1D)"):
        name, value = bad.split(" = ")
        with pytest.raises(Exception, match="positive time"):
            T.track_scores(evidence(spark).selectExpr(*(f"{value} AS {c}" if c == name else c for c in evidence(spark).columns))).collect()


@pytest.mark.parametrize("config", [{"patch_radius": 0}, {"noise_floor_pixels": -1}, {"min_coverage": 1.1}, {"improvement_ratio": 1.0}, {"illumination_sigma": 1.0}, {"blur_sigma": float("nan")}])
def test_bad_settings_fail(config):
    with pytest.raises(ValueError):
        T.Trajectory(**config)


def frames_of(spark, images, xy, radius):
    flags = [True] * len(xy[0])
    rows = [("c", t, t / 8, *i.shape[:2], bytearray(i.tobytes()), np.array(p, float).ravel().tolist(), np.array(p, float).ravel().tolist(), flags, flags) for t, (i, p) in enumerate(zip(images, xy, strict=True))]
    return spark.createDataFrame(rows, "clip string, index int, time double, height int, width int, pixels binary, tracks array<double>, reverse_tracks array<double>, visible array<boolean>, reverse_visible array<boolean>")


def test_brightness_is_no_motion_and_a_shift_is(spark):
    rng = np.random.default_rng(3)
    image = rng.integers(30, 210, (64, 64, 3), dtype=np.uint8)
    grid = np.array(T.query_grid(64, 64, 4, 4))
    false = [grid + [float(t > 0), 0] for t in range(4)]
    c = T.Trajectory(patch_radius=4)
    s = T.track_scores(T.track_evidence(frames_of(spark, [image, image + 10, image - 10, image], false, 4), c), c).first()
    assert s.score == 0 and s.coverage == 1
    wide = rng.integers(40, 210, (96, 120, 3), dtype=np.uint8)
    images = [np.ascontiguousarray(wide[:, 12 - 2 * t : 108 - 2 * t]) for t in range(4)]  # moves two pixels to the right
    grid = np.array(T.query_grid(96, 96, 4, 7))
    for light in (0.0, 6.0):
        c = T.Trajectory(illumination_sigma=light)
        e = T.track_evidence(frames_of(spark, images, [grid + [2.0 * t, 0] for t in range(4)], 7), c)
        s = T.track_scores(e, c).first()
        assert s.status == "succeeded" and s.score > 0.1 and s.moving_fraction > 0.6
    with pytest.raises(Exception, match="places that are none"):
        T.track_evidence(frames_of(spark, images, [grid * np.nan] * 4, 7)).collect()
    with pytest.raises(ValueError, match="too small"):
        T.query_grid(16, 64, 4, 7)


def test_patches_equal_plain_reading():
    rng = np.random.default_rng(5)
    image, at = rng.normal(size=(9, 11)) * 20, rng.uniform(-3, 12, (30, 2))
    reflect = lambda i, n: (abs(i) % (2 * n - 2)) if abs(i) % (2 * n - 2) < n else 2 * n - 2 - abs(i) % (2 * n - 2)
    got = P.patches(image, at, 1, 8.0)
    for k, (x, y) in enumerate(at):
        square = []
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                px, py = x + dx, y + dy
                x0, y0 = int(np.floor(px)), int(np.floor(py))
                square.append(sum(image[reflect(y0 + j, 9), reflect(x0 + i, 11)] * (px - x0 if i else 1 - px + x0) * (py - y0 if j else 1 - py + y0) for i in (0, 1) for j in (0, 1)))
        v = np.array(square) - np.mean(square)
        assert np.allclose(got[k], v / max(v.std(), 8.0))
    flat = P.blurred(np.ones((5, 6)), 1.2)
    assert np.allclose(flat, 1) and P.blurred(np.eye(9), 1.2).sum() == pytest.approx(9, rel=0.05)
