"""Perturbed frames and the plans of ladders (survey N05, M07). Noise is drawn by counter: a
value depends on the seed, the frame and the pixel alone, so it is the same under any split,
order or rerun, and in any engine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.tracks import blurred

FAMILIES = ("clean", "pixel_rgb", "correlated_rgb", "global_alternating", "global_random", "local_alternating", "local_random")
#: Nodes of the coarse noise that ``correlated_rgb`` reads between.
COARSE = (12, 16)


def counted_uniform(seed: int, frame: int, n: int) -> np.ndarray:
    """``n`` values in [-1, 1) of a frame: place i is an integer hash of seed, frame and i."""
    x = (np.uint64(seed % 2**32) * np.uint64(2654435761) + np.uint64(frame % 2**32) * np.uint64(2246822507) + np.arange(n, dtype=np.uint64) * np.uint64(3266489917)) % np.uint64(2**32)
    for shift, factor in ((16, 2146121005), (15, 2221713035)):
        x = ((x ^ (x >> np.uint64(shift))) * np.uint64(factor)) % np.uint64(2**32)
    return ((x ^ (x >> np.uint64(16))).astype(float)) / 2**31 - 1


def enlarged(coarse: np.ndarray, height: int, width: int) -> np.ndarray:
    """(h, w, channels) read at (height, width) by cubics between nodes, edges repeated."""
    for axis, n in ((0, height), (1, width)):
        old = coarse.shape[axis]
        at = (np.arange(n) + 0.5) * old / n - 0.5
        k = np.floor(at).astype(int)
        t = at - k
        a = -0.75
        near = lambda d: (a + 2) * d**3 - (a + 3) * d**2 + 1
        far = lambda d: a * d**3 - 5 * a * d**2 + 8 * a * d - 4 * a
        weights = (far(t + 1), near(t), near(1 - t), far(2 - t))
        shape = [1, 1, 1]
        shape[axis] = n
        coarse = sum(w.reshape(shape) * np.take(coarse, np.clip(k + i - 1, 0, old - 1), axis=axis) for i, w in enumerate(weights))
    return coarse


def noise(family: str, amplitude: float, seed: int, frame: int, height: int, width: int) -> np.ndarray:
    """What a family adds to frame number ``frame``: (height, width, 3), or what spreads to it."""
    if family == "clean":
        return np.zeros((1, 1, 1))
    if family == "pixel_rgb":
        return amplitude * counted_uniform(seed, frame, height * width * 3).reshape(height, width, 3)
    if family == "correlated_rgb":
        coarse = counted_uniform(seed, frame, COARSE[0] * COARSE[1] * 3).reshape(*COARSE, 3)
        return amplitude * np.clip(enlarged(coarse, height, width), -1, 1)
    place, _, kind = family.partition("_")
    if place not in ("global", "local") or kind not in ("alternating", "random"):
        raise ValueError(f"unknown family {family}")
    value = (-1.0) ** (frame + seed % 2) if kind == "alternating" else counted_uniform(seed, frame, 1)[0]
    mask = np.ones((height, width))
    if place == "local":
        mask[:] = 0
        mask[height // 4 : 3 * height // 4, width // 4 : 3 * width // 4] = 1
        mask = blurred(mask, 2.0)
    return amplitude * value * mask[..., None]


def perturbed(frames: DataFrame, plan: DataFrame) -> DataFrame:
    """Frames (clip, index, height, width, pixels as bytes of red, green and blue) under each
    row of ``plan`` (clip, variant, family, amplitude, seed): pixels, and the mean difference
    and the share that was cut at 0 or 255. Only looks change, never places."""
    both = frames.select("clip", "index", "height", "width", "pixels").join(plan.select("clip", "variant", "family", "amplitude", "seed"), "clip")
    kind = pa.struct([("pixels", pa.binary()), ("difference", pa.float64()), ("clipped", pa.float64())])

    @F.arrow_udf("struct<pixels:binary,difference:double,clipped:double>")
    def run(index: pa.Array, height: pa.Array, width: pa.Array, pixels: pa.Array, family: pa.Array, amplitude: pa.Array, seed: pa.Array) -> pa.Array:
        out = []
        for i, h, w, p, f, a, s in zip(*(c.to_pylist() for c in (index, height, width, pixels, family, amplitude, seed)), strict=True):
            before = np.frombuffer(p, np.uint8).reshape(h, w, 3).astype(float)
            raw = before + noise(f, a, s, i, h, w)
            after = np.rint(raw).clip(0, 255)
            out.append({"pixels": after.astype(np.uint8).tobytes(), "difference": float(abs(after - before).mean()), "clipped": float(((raw < 0) | (raw > 255)).mean())})
        return pa.array(out, kind)

    x = run("index", "height", "width", "pixels", "family", "amplitude", "seed")
    return both.withColumn("x", x).select("clip", "variant", "index", "height", "width", "family", "amplitude", "seed", "x.*")


def _areas(old: int, new: int) -> np.ndarray:
    """(new, old) weights that make a line of ``new`` pixels of one of ``old``, each the mean of
    what it covers."""
    edges = np.arange(new + 1) * old / new
    low, high = edges[:-1, None], edges[1:, None]
    share = np.clip(np.minimum(high, np.arange(old) + 1) - np.maximum(low, np.arange(old)), 0, None)
    return share / share.sum(axis=1, keepdims=True)


def moving_card(image: np.ndarray, speed: int, frames: int, speeds: list[int], oscillating: bool = False) -> np.ndarray:
    """(frames, height, width, 3): the image, halved to a square card with soft edges, moves
    ``speed`` pixels a frame over its own blurred copy; every speed begins where the fastest of
    ``speeds`` has room, and the card stays within the frame. Oscillating, it turns every four
    frames."""
    h, w = image.shape[:2]
    size = min(h, w) // 2
    card = np.einsum("ij,jkc,lk->ilc", _areas(h, size), image.astype(float), _areas(w, size))
    ground = np.stack([blurred(image[..., c].astype(float), 5.0) for c in range(3)], axis=-1)
    edge = np.ones((size, size))
    edge[[0, -1], :] = edge[:, [0, -1]] = 0
    soft = blurred(edge, 0.7)[..., None]
    begin, y = (w - size) // 2 - (frames - 1) * max(speeds) / 2, (h - size) // 2
    out = np.repeat(ground[None], frames, axis=0)
    for t in range(frames):
        x = int(round(begin + speed * (min(t % 8, 8 - t % 8) if oscillating else t)))
        if x < 2 or x + size > w - 2:
            raise ValueError("the card's path leaves the frame")
        part = out[t, y : y + size, x : x + size]
        out[t, y : y + size, x : x + size] = (1 - soft) * part + soft * card
    return np.rint(out).clip(0, 255).astype(np.uint8)


def card_frames(images: DataFrame, plan: DataFrame, frames: int, speeds: list[int]) -> DataFrame:
    """Images (clip, height, width, pixels) under each row of ``plan`` (clip, variant, kind,
    motion), a row a frame: static ones repeat the image, the others move its card."""
    both = images.select("clip", "height", "width", "pixels").join(plan.select("clip", "variant", "kind", "motion"), "clip")

    @F.arrow_udf("array<binary>")
    def run(height: pa.Array, width: pa.Array, pixels: pa.Array, kind: pa.Array, motion: pa.Array) -> pa.Array:
        out = []
        for h, w, p, k, m in zip(*(c.to_pylist() for c in (height, width, pixels, kind, motion)), strict=True):
            if k == "static":
                out.append([p] * frames)
            else:
                out.append([f.tobytes() for f in moving_card(np.frombuffer(p, np.uint8).reshape(h, w, 3), m, frames, speeds, k == "oscillation")])
        return pa.array(out, pa.list_(pa.binary()))

    made = run("height", "width", "pixels", "kind", "motion")
    return both.select("clip", "variant", "kind", "motion", "height", "width", F.posexplode(made).alias("index", "pixels"))


def ladder_plan(sources: DataFrame, families: list[str], amplitudes: list[float], seeds: list[int], motions: list[int], strongest_only: bool = False) -> DataFrame:
    """``sources`` with each variant of the static ladder: (variant, kind, motion, family,
    amplitude, seed). A still clip and each motion under no and every perturbation (with
    ``strongest_only`` moving clips only under none and the greatest), and each motion but the
    first going back and forth, clean and with the greatest pixel noise."""
    clean = ("clean", 0.0, 0)
    every = [clean, *((f, float(a), s) for f in families for a in amplitudes for s in seeds)]
    top = max(amplitudes)
    moving = [v for v in every if not strongest_only or v[1] in (0.0, float(top))]
    rows = [("static", 0, *v) for v in every] + [("translation", m, *v) for m in motions for v in moving] + [("oscillation", m, *v) for m in motions[1:] for v in (clean, ("pixel_rgb", float(top), seeds[0]))]
    names = ("kind", "motion", "family", "amplitude", "seed")
    array = F.array(*(F.struct(F.lit(k).alias("variant"), *(F.lit(v).alias(n) for n, v in zip(names, r, strict=True))) for k, r in enumerate(rows)))
    return sources.select("*", F.explode(array).alias("lp")).select(*sources.columns, "lp.*")


def digests(frames: DataFrame, by: list[str], order: str = "index") -> DataFrame:
    """The SHA-256 of the frames of each group in their order, from the digests of each."""
    each = F.sort_array(F.collect_list(F.struct(order, F.sha2("pixels", 256).alias("h"))))  # a digest a frame
    return frames.groupBy(*by).agg(F.sha2(F.array_join(F.transform(each, lambda x: x["h"]), ""), 256).alias("digest"))
