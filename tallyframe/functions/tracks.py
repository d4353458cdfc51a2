"""Whether a point moved or stood still, from the patches around it (survey N03)."""

from __future__ import annotations

import numpy as np


def grey(pixels: np.ndarray) -> np.ndarray:
    """Whole levels of brightness of (height, width, 3) bytes."""
    return np.floor(pixels.astype(float) @ [0.299, 0.587, 0.114] + 0.5)


def blurred(image: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur over four deviations a side; edges are mirrored at the outer pixel."""
    size = round(sigma * 8 + 1) | 1
    x = np.arange(size) - size // 2
    k = np.exp(-(x**2) / (2 * sigma**2))
    k /= k.sum()
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (size // 2, size // 2)
        padded = np.pad(image, pad, mode="reflect") if image.shape[axis] > 1 else np.pad(image, pad, mode="edge")
        image = np.apply_along_axis(np.convolve, axis, padded, k, mode="valid")
    return image


def prepared(pixels: np.ndarray, blur: float, illumination: float = 0.0) -> np.ndarray:
    g = grey(pixels)
    return blurred(g, blur) - (blurred(g, illumination) if illumination else 0.0)


def patches(image: np.ndarray, at: np.ndarray, radius: int, floor: float) -> np.ndarray:
    """(points, values) of squares around places (x, y), read between pixels, mirrored at
    the edges, with their mean taken off and over their deviation, or ``floor`` if that is
    more."""
    height, width = image.shape
    k = np.arange(-radius, radius + 1)
    x = at[:, 0, None, None] + k[None, None, :] + 0 * k[None, :, None]
    y = at[:, 1, None, None] + k[None, :, None] + 0 * k[None, None, :]

    def mirrored(i: np.ndarray, n: int) -> np.ndarray:
        if n == 1:
            return np.zeros_like(i)
        i = np.abs(i) % (2 * n - 2)
        return np.where(i >= n, 2 * n - 2 - i, i)

    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = x - x0, y - y0
    read = lambda dy, dx: image[mirrored(y0 + dy, height), mirrored(x0 + dx, width)]
    top, bottom = read(0, 0) * (1 - fx) + read(0, 1) * fx, read(1, 0) * (1 - fx) + read(1, 1) * fx
    out = (top * (1 - fy) + bottom * fy).reshape(len(at), -1)
    out = out - out.mean(axis=1, keepdims=True)
    return out / np.maximum(out.std(axis=1, keepdims=True), floor)


def pair_evidence(before: np.ndarray, after: np.ndarray, a: np.ndarray, b: np.ndarray, back_a: np.ndarray, back_b: np.ndarray, radius: int, floor: float) -> dict[str, np.ndarray]:
    """Of two prepared frames and the points' places in them (x, y), forward and back: how far
    each moved, how unlike its patch is at the new place and at the old one, how far the way
    back misses, and whether both places have a whole patch."""
    height, width = before.shape
    start = patches(before, a, radius, floor)
    unlike = lambda at: ((start - patches(after, at, radius, floor)) ** 2).mean(axis=1)
    inside = np.ones(len(a), bool)
    for p in (a, b):
        inside &= (p[:, 0] >= radius) & (p[:, 0] <= width - 1 - radius) & (p[:, 1] >= radius) & (p[:, 1] <= height - 1 - radius)
    miss = lambda p, q: np.hypot(*(p - q).T)
    return {"displacement": miss(b, a), "moving_error": unlike(b), "stationary_error": unlike(a), "cycle_error": np.maximum(miss(a, back_a), miss(b, back_b)), "inside_pair": inside}
