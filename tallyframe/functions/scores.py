"""Scalar and array formulas of scores (survey D01-D21) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of boxes [x1, y1, x2, y2]; 0 where the union is empty."""
    at = lambda c, i: F.element_at(c, i)
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(at(a, hi), at(b, hi)) - F.greatest(at(a, lo), at(b, lo)))
    area = lambda c: (at(c, 3) - at(c, 1)) * (at(c, 4) - at(c, 2))
    both = side(1, 3) * side(2, 4)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def center_distances(subject: Column, other: Column) -> tuple[Column, Column]:
    """Centre of ``other`` minus centre of ``subject``, x to the right, y down."""
    mid = lambda c, i: (F.element_at(c, i) + F.element_at(c, i + 2)) / 2
    return mid(other, 1) - mid(subject, 1), mid(other, 2) - mid(subject, 2)


def position_score(relation: Column, subject: Column, other: Column, signed: bool, threshold: float = 0.1) -> Column:
    """1 where the boxes stand in the relation and overlap by less than
    ``threshold``, ``threshold``/IoU where they overlap more, 0 where the other axis is as
    large. ``signed`` also asks for the direction."""
    dx, dy = center_distances(subject, other)
    across, iou = F.abs(dx) > F.abs(dy), box_iou(subject, other)
    down = F.abs(dy) > F.abs(dx)
    holds = F.when(relation == "left", across & (dx > 0)).when(relation == "right", across & (dx < 0)).when(relation == "above", down & (dy > 0)).when(relation == "below", down & (dy < 0))
    if not signed:
        holds = F.when(relation.isin("left", "right"), across).otherwise(down)
    return F.when(holds, F.when(iou < threshold, F.lit(1.0)).otherwise(F.lit(threshold) / iou)).otherwise(F.lit(0.0))


def softmin(values: Column, beta: float) -> Column:
    """-ln(mean(exp(-beta x))) / beta, cut to [0, 1]; null for an empty array."""
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(-F.lit(beta) * x)) / F.size(values)
    return F.when(F.size(values) > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), -F.log(mean) / beta)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is 0."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def condition_blend(scores: Column, alpha: float = 0.5) -> Column:
    """``alpha`` of the mean and the rest of the least."""
    mean = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x) / F.size(scores)
    return F.lit(alpha) * mean + F.lit(1 - alpha) * F.array_min(scores)


def calibrated(score: Column, gain: float) -> Column:
    """A deficit enlarged by ``gain``, cut to [0, 1]."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.lit(gain) * (1 - score)))


def discontinuity_score(d: Column) -> Column:
    """D09."""
    return F.when(d >= 0, F.exp(-d))


def intensity(displacement: Column, diagonal: Column, dt: Column, exponent: float = 0.5) -> Column:
    """Displacement in diagonals over elapsed time to a power; null unless dt > 0."""
    return F.when(dt > 0, displacement / diagonal / F.pow(dt, F.lit(exponent)))


def needed_frames(n: Column) -> Column:
    """A quarter of the frames, halves to the even number."""
    return F.bround(4 * n / 16.0).cast("int")


def outcome(difference: Column, margin: Column | float) -> Column:
    """1 or 0 for the sign, 0.5 within the margin, which counts as a tie."""
    m = margin if isinstance(margin, Column) else F.lit(margin)
    return F.when(F.abs(difference) <= m, 0.5).when(difference > 0, 1.0).when(difference < 0, 0.0)


def finite_score(score: Column, status: Column, good: tuple[str, ...] = ("succeeded",)) -> Column:
    """The score of a row that ended well, if it is a number; else null, never 0."""
    s = score.cast("double")
    return F.when(status.isin(*good) & ~F.isnan(s) & (F.abs(s) < float("inf")), s)


def all_substrings(tokens: Column, text: Column) -> Column:
    """Every token stands in the text, case and all."""
    return F.forall(tokens, lambda t: text.contains(t))


def any_of_top(labels: Column, scores: Column, target: Column, k: int = 5, least: float = 0.85) -> Column:
    """The target is among the first ``k`` with a score, rounded to 4 digits, of at
    least ``least``."""
    both = F.arrays_zip(F.slice(labels, 1, k).alias("l"), F.slice(scores, 1, k).alias("s"))
    return F.exists(both, lambda x: (x["l"] == target) & (F.bround(x["s"], 4) >= least))


def enough_moves(scores: Column, threshold: Column | float, needed: Column) -> Column:
    """At least ``needed`` scores above the threshold; false for no scores at all."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return (F.size(scores) > 0) & (F.size(F.filter(scores, lambda x: x > t)) >= needed)


def status_fold(statuses: Column) -> Column:
    """Failed before blocked; not_applicable only if all are; else verified."""
    has = lambda s: F.array_contains(statuses, s)
    none = F.forall(statuses, lambda s: s == "not_applicable")
    return F.when(has("failed"), "failed").when(has("blocked"), "blocked").when(none, "not_applicable").otherwise("verified")


def mirror(box: Column, width: Column) -> Column:
    """A half-open box mirrored left to right."""
    e = F.element_at
    return F.array(width - e(box, 3), e(box, 2), width - e(box, 1), e(box, 4))
