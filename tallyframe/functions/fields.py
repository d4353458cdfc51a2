"""Numpy kernels on stacks of 2-D fields, for use inside Arrow batches (survey N01, N02).

A stack has the shape (rows, height, width, components); displacements are (dx, dy) in
pixels, x to the right and y down. Masks have the shape (rows, height, width).
"""

from __future__ import annotations

import numpy as np

#: Weights of a corner up to this count as none.
TINY = float(np.finfo(np.float64).eps)


def warp(field: np.ndarray, shift: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``field`` read at x + shift(x), between four pixels, and where that is valid: inside
    the field, every pixel with weight valid. Nothing is clamped; invalid places hold 0."""
    rows, height, width = field.shape[:3]
    x = np.arange(width) + shift[..., 0]
    y = np.arange(height)[:, None] + shift[..., 1]
    ok = (x >= 0) & (x <= width - 1) & (y >= 0) & (y <= height - 1)
    x, y = np.where(ok, x, 0.0), np.where(ok, y, 0.0)
    left, top = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
    right, bottom = np.minimum(left + 1, width - 1), np.minimum(top + 1, height - 1)
    across, down = x - left, y - top
    row = np.arange(rows)[:, None, None]

    def line(at: np.ndarray, share: np.ndarray) -> np.ndarray:
        """One line of each pair, read between left and right; its pixels are checked."""
        for pixel, weight in ((left, (1 - across) * share), (right, across * share)):
            ok[...] &= (weight <= TINY) | valid[row, at, pixel]
        return field[row, at, left] + across[..., None] * (field[row, at, right] - field[row, at, left])

    upper, lower = line(top, 1 - down), line(bottom, down)
    out = upper + down[..., None] * (lower - upper)
    out[~ok] = 0.0
    return out, ok


def norm(field: np.ndarray) -> np.ndarray:
    return np.hypot(field[..., 0], field[..., 1])


def turn(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One minus the cosine between two fields, from 0 to 2; 0 where one of them is 0."""
    size = norm(a) * norm(b)
    cosine = np.divide((a * b).sum(axis=-1), size, out=np.ones_like(size), where=size > 0)
    return np.clip(1.0 - cosine, 0.0, 2.0)


def masked(values: np.ndarray, mask: np.ndarray) -> tuple[float, float, float, float]:
    """Mean, median, 0.9 quantile of the masked finite values of one field, and their share
    of all pixels; zeros for none."""
    chosen = values[mask]
    chosen = chosen[np.isfinite(chosen)]
    if not chosen.size:
        return 0.0, 0.0, 0.0, 0.0
    return float(chosen.mean()), float(np.median(chosen)), float(np.quantile(chosen, 0.9)), chosen.size / mask.size
