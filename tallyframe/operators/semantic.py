"""Scores of videos from detections, labels, classes and captions (survey F07-F10, D14, D15).

A video has a fixed number of frame slots. A slot without valid evidence is missing: it
stays in the denominator, and it confirms nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions import scores as S

SLOTS = 16


def valid_box(box: Column) -> Column:
    """Four finite numbers that enclose an area."""
    finite = F.forall(box, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    e = F.try_element_at
    at = lambda i: e(box, F.lit(i))
    return F.coalesce((F.size(box) == 4) & finite & (at(3) > at(1)) & (at(4) > at(2)), F.lit(False))


def valid_frame(frame: Column) -> Column:
    """A list of detections (label, box), every one with a label and a valid box."""
    return F.coalesce(F.forall(frame, lambda x: F.coalesce(F.trim(x["label"]) != "", F.lit(False)) & valid_box(x["box"])), F.lit(False))


def _slots(frames: Column, n: int, valid) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(valid(F.get(frames, i)), F.get(frames, i)))


def _count(states: Column, state: str) -> Column:
    return F.size(F.filter(states, lambda s: s == state))


def _result(score: Column, covered: Column, abstained: Column, n: int) -> Column:
    status = F.when(covered == n, "ok").otherwise("partial")
    return F.struct((score / n).alias("score"), (covered / n).alias("coverage"), (abstained / n).alias("abstention"), (1 - covered / n).alias("missing"), status.alias("status"))


def objects_states(entities: Column, frames: Column, n: int = SLOTS, least: float = 0.5) -> Column:
    """The state of each slot: missing, absent (an entity is not there), supported (each
    stands in a neighbouring slot too, boxes overlapping by ``least``), or unconfirmed."""

    def seen(name: Column, box: Column, other: Column) -> Column:
        return F.coalesce(F.exists(other, lambda b: (b["label"] == name) & (S.box_iou(box, b["box"]) >= least)), F.lit(False))

    def states(good: Column) -> Column:
        def one(frame: Column, i: Column) -> Column:
            before, after = F.get(good, i - 1), F.get(good, i + 1)
            there = F.forall(entities, lambda e: F.exists(frame, lambda a: a["label"] == e))
            sure = F.forall(entities, lambda e: F.exists(frame, lambda a: (a["label"] == e) & (seen(e, a["box"], before) | seen(e, a["box"], after))))
            return F.when(frame.isNull(), "missing").when(~there, "absent").when(sure, "supported").otherwise("unconfirmed")

        return F.transform(good, one)

    return F.get(F.transform(F.array(_slots(frames, n, valid_frame)), states), F.lit(0))


def objects_score(entities: Column, frames: Column, n: int = SLOTS, least: float = 0.5) -> Column:
    """score, coverage, abstention, missing and status from ``objects_states``; null
    without entities."""
    body = lambda s: _result(_count(s, "supported"), n - _count(s, "missing"), _count(s, "unconfirmed"), n)
    return F.when(F.size(entities) > 0, F.get(F.transform(F.array(objects_states(entities, frames, n, least)), body), F.lit(0)))


def labels_score(entities: Column, frames: Column, n: int = SLOTS) -> Column:
    """The share of slots whose labels hold every entity, exactly as written."""
    states = F.transform(_slots(frames, n, lambda f: f.isNotNull()), lambda f: F.when(f.isNull(), "missing").when(F.forall(entities, lambda e: F.array_contains(f, e)), "hit").otherwise("miss"))
    body = lambda s: _result(_count(s, "hit"), n - _count(s, "missing"), F.lit(0), n)
    return F.when(F.size(entities) > 0, F.get(F.transform(F.array(states), body), F.lit(0)))


def spatial_score(triples: Column, frames: Column, n: int = SLOTS, signed: bool = True) -> Column:
    """the mean over slots of the mean over relations of the best pair of distinct
    detections. A slot in which a box that matters is corrupt is missing."""
    matters = lambda f: F.filter(f, lambda x: F.exists(triples, lambda t: (t["subject"] == x["label"]) | (t["object"] == x["label"])))

    def best(t: Column, f: Column) -> Column:
        pairs = F.transform(f, lambda a, i: F.transform(f, lambda b, j: F.when((a["label"] == t["subject"]) & (b["label"] == t["object"]) & (i != j), S.position_score(t["relation"], a["box"], b["box"], signed)).otherwise(F.lit(0.0))))
        return F.array_max(F.concat(F.array(F.lit(0.0)), F.flatten(pairs)))

    valid = lambda f: F.coalesce(F.forall(matters(f), lambda x: valid_box(x["box"])), F.lit(False))
    scores = F.transform(_slots(frames, n, valid), lambda f: F.when(f.isNotNull(), F.aggregate(triples, F.lit(0.0), lambda s, t: s + best(t, matters(f))) / F.size(triples)))
    body = lambda s: _result(F.aggregate(s, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))), F.size(F.filter(s, lambda x: x.isNotNull())), F.lit(0), n)
    return F.when(F.size(triples) > 0, F.get(F.transform(F.array(scores), body), F.lit(0)))


def action_score(actions: Column, labels: Column, scores: Column) -> Column:
    """the mean over wanted actions of being among the first five classes with 0.85 or
    more; ``other`` scores nothing and counts as abstention. Null without classes."""
    hit = lambda a: F.when((a != "other") & S.any_of_top(labels, scores, a), 1.0).otherwise(0.0)
    total = F.aggregate(F.transform(actions, hit), F.lit(0.0), lambda s, x: s + x)
    others = F.size(F.filter(actions, lambda a: a == "other"))
    known = total / F.greatest(F.size(actions) - others, F.lit(1))
    out = F.struct((total / F.size(actions)).alias("score"), F.lit(1.0).alias("coverage"), (others / F.size(actions)).alias("abstention"), F.lit(0.0).alias("missing"), known.alias("known_class_score"), F.lit("ok").alias("status"))
    return F.when((F.size(actions) > 0) & (F.size(labels) > 0), out)


def scene_score(labels: Column, n: int = SLOTS) -> Column:
    """the share of slots judged supported; contradicted and insufficient are covered
    too, insufficient is abstention, anything else is missing."""
    wide = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(labels, i))
    covered = F.size(F.filter(wide, lambda x: x.isin("supported", "contradicted", "insufficient")))
    return _result(_count(wide, "supported"), covered, _count(wide, "insufficient"), n)


def scene_labels(tokens: Column, captions: Column, n: int = SLOTS) -> Column:
    """D16 for each slot: supported if every token stands in the caption, null without one."""
    slots = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(captions, i))
    return F.transform(slots, lambda c: F.when(c.isNotNull(), F.when(S.all_substrings(tokens, c), "supported").otherwise("contradicted")))
