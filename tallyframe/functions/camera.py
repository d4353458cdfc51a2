"""The camera's part of a motion field, by a robust similarity (survey N01). Places are
complex numbers, so a similarity is one product and one sum."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


#: Places times tries that are compared at once; more does not stay in a core's cache.
CACHED = 4_000


@dataclass(frozen=True)
class Camera:
    """Most places compared, least candidates of the second fit, distance of an inlier,
    residuals allowed in scaled deviations, width of the border band, and the tries."""

    most: int = 20_000
    least: int = 12
    threshold: float = 2.0
    mad_scale: float = 3.0
    border: float = 0.25
    tries: int = 100
    refinements: int = 10
    seed: int = 0


def _similarity(src: np.ndarray, dst: np.ndarray) -> tuple[complex, complex] | None:
    """Least squares: dst = m * src + t; None for one place only."""
    if not len(src):
        return None
    s, d = src.mean(), dst.mean()
    spread = (abs(src - s) ** 2).sum()
    if not spread > 0:
        return None
    m = (np.conj(src - s) * (dst - d)).sum() / spread
    return m, d - m * s


def robust_similarity(src: np.ndarray, dst: np.ndarray, c: Camera) -> tuple[complex, complex, np.ndarray] | None:
    """The similarity through two places, of seeded tries, that most places agree with,
    fitted again to these until they stay the same; and which they are."""
    n = len(src)
    if n < 3:
        return None
    rng = np.random.default_rng([c.seed, n])
    a = rng.integers(0, n, c.tries)
    b = (a + rng.integers(1, n, c.tries)) % n
    m = (dst[b] - dst[a]) / (src[b] - src[a])
    t = dst[a] - m * src[a]
    size = max(1, CACHED // n)
    near = np.concatenate([(abs(m[i : i + size, None] * src + t[i : i + size, None] - dst) <= c.threshold).sum(axis=1) for i in range(0, c.tries, size)])
    best = int(near.argmax())
    m, t = m[best], t[best]
    inliers = abs(m * src + t - dst) <= c.threshold
    for _ in range(c.refinements):
        fit = _similarity(src[inliers], dst[inliers])
        if fit is None:
            break
        now = abs(fit[0] * src + fit[1] - dst) <= c.threshold
        if now.sum() < inliers.sum():
            break
        m, t = fit
        if (now == inliers).all():
            break
        inliers = now
    return m, t, inliers


def statistics(flow: np.ndarray, share: float = 0.05) -> dict[str, float]:
    """Of the lengths of a field: mean of the greatest ``share`` (one at least), mean, median
    and greatest."""
    size = np.hypot(flow[..., 0], flow[..., 1]).ravel()
    k = max(1, int(size.size * share))
    return {"top5_mean": float(np.partition(size, size.size - k)[-k:].mean()), "mean": float(size.mean()), "median": float(np.median(size)), "maximum": float(size.max())}


def _spread(x: np.ndarray) -> tuple[float, float]:
    middle = float(np.median(x))
    return middle, float(np.median(abs(x - middle)))


def decompose(flow: np.ndarray, c: Camera = Camera()) -> tuple[np.ndarray, dict]:
    """The field of a camera (height, width, 2) fitted to ``flow``, and how the fit went.

    A first fit over a grid of places; then those that agree with it, whose residual is no
    outlier by the median deviation, and that lie in the band along the border, are fitted
    again; without enough of them in the band, those anywhere; without enough at all the
    first fit stays.
    """
    height, width = flow.shape[:2]
    step = max(1, int(np.ceil(np.sqrt(height * width / c.most))))
    y, x = (g.ravel() for g in np.mgrid[0:height:step, 0:width:step])
    src = x + 1j * y
    dst = src + flow[y, x, 0] + 1j * flow[y, x, 1]
    out = {"initial_candidate_count": len(src), "candidate_count": 0, "inlier_ratio": 0.0, "fallback": True, "residual_mad": 0.0}
    first = robust_similarity(src, dst, c)
    if first is None:
        size = float(np.median(np.hypot(flow[..., 0], flow[..., 1])))
        return np.zeros_like(flow), out | {"affine": [1.0, 0.0, 0.0, 0.0, 1.0, 0.0], "candidate_strategy": "initial_fit_failed", "fallback_reason": "initial_fit_failed_no_compensation", "residual_median": size}
    m, t, inliers = first
    residual = abs(m * src + t - dst)
    middle, deviation = _spread(residual)
    agreed = inliers & (residual <= middle + c.mad_scale * max(1e-6, 1.4826 * deviation))
    bx, by = max(1.0, width * c.border), max(1.0, height * c.border)
    band = (x < bx) | (x >= width - bx) | (y < by) | (y >= height - by)
    chosen, strategy, reasons = agreed & band, "geometric_inlier_residual_consistent_border_band_prior", []
    if chosen.sum() < c.least:
        chosen, strategy = agreed, "geometric_inlier_residual_consistent_without_spatial_prior"
        reasons.append("insufficient_border_band_candidates")
    if chosen.sum() >= c.least:
        again = robust_similarity(src[chosen], dst[chosen], c)
        if again is None:
            reasons.append("refit_failed_using_initial")
        else:
            m, t = again[:2]
    else:
        reasons.append("insufficient_consistent_candidates_using_initial")
    residual = abs(m * src + t - dst)
    middle, deviation = _spread(residual)
    place = np.arange(width) + 1j * np.arange(height)[:, None]
    moved = m * place + t - place
    out |= {
        "affine": [m.real, -m.imag, t.real, m.imag, m.real, t.imag], "candidate_count": int(chosen.sum()), "inlier_ratio": float((residual <= c.threshold).mean()), "candidate_strategy": strategy,
        "fallback": bool(reasons), "fallback_reason": "; ".join(reasons) or None, "residual_median": middle, "residual_mad": deviation,
    }
    return np.stack([moved.real, moved.imag], axis=-1), out
