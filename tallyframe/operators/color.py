"""The colour score of clips from captions bound to detections (survey F08)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import parsing as P
from tallyframe.functions import text as T


VARIANTS = ("repair", "binding_lexical", "binding")


def color_scores(frames: DataFrame, pairs: DataFrame, targets: DataFrame, things: dict[str, str], colors: dict[str, str], variant: str = "repair") -> DataFrame:
    """One row for each clip of ``targets`` (id, target, color).

    ``frames`` is (id, frame, status), ``pairs`` (id, frame, method, object, caption). A
    frame supports the clip if a caption of a detection of the target gives it the colour.
    Variants: ``repair`` divides by all frames; ``binding_lexical`` by those in which some
    colour is given to the target; ``binding`` also takes names and colours as they are
    written. A failed frame, or none at all, fails the clip; a target or colour that the
    vocabulary does not have is unsupported.
    """
    return color_variants(frames, pairs, targets, things, colors, [variant]).select("id", f"{variant}.*")


def color_variants(frames: DataFrame, pairs: DataFrame, targets: DataFrame, things: dict[str, str], colors: dict[str, str], variants: Sequence[str] = VARIANTS) -> DataFrame:
    """``color_scores`` of several variants in one pass: ``id``, and a struct for each variant."""
    if not set(variants) <= set(VARIANTS):
        raise ValueError("unknown colour variant")
    known = lambda table, c: F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.lower(T.normalize_space(c)))
    aimed = targets.select("id", "target", "color", known(things, F.col("target")).alias("want"), known(colors, F.col("color")).alias("hue"))
    aimed = aimed.withColumn("able", F.col("want").isNotNull() & F.col("hue").isNotNull())
    p = pairs.join(aimed.filter("able"), "id")
    caption = F.col("caption")
    rules = {}  # as named by the vocabularies, as written: (match, supported, usable)
    if "binding" in variants:
        rules["written"] = (F.col("object") == F.col("target"), F.contains(caption, F.col("color")), caption.rlike("|".join(P.PLAIN_COLORS)))
    if set(variants) != {"binding"}:
        find_things, find_colors = T.mention_spans(things), T.mention_spans(colors)
        # Captions repeat; each is judged once for a target and a colour.
        said = p.select("caption", "want", "hue").filter("caption IS NOT NULL").distinct().withColumn("things", find_things("caption")).withColumn("hues", find_colors("caption"))
        gives = lambda hue: P.color_support(caption, hue, F.col("want"), F.col("things"), F.col("hues"))["supported"]
        said = said.select("caption", "want", "hue", gives(F.col("hue")).alias("given"), F.exists(F.array_distinct(F.transform("hues", lambda m: m["label"])), gives).alias("some"))
        p = p.join(said, ["caption", "want", "hue"], "left")
        rules["named"] = (known(things, F.col("object")) == F.col("want"), F.col("given"), F.col("some"))
    # The shuffle takes flags, not texts.
    flags = {f"{rule}_{name}": F.coalesce(c, F.lit(False)) for rule, (match, supported, usable) in rules.items() for name, c in (("there", match), ("hit", match & supported), ("use", match & usable))}
    judged = p.select("id", "frame", F.coalesce(F.col("method") == "ambiguous", F.lit(False)).alias("vague"), *(c.alias(k) for k, c in flags.items()))
    seen = judged.groupBy("id", "frame").agg(*(F.max(k).alias(k) for k in ("vague", *flags)))
    f = frames.select("id", "frame", F.coalesce(F.col("status") == "succeeded", F.lit(False)).alias("ran")).join(seen, ["id", "frame"], "left")
    reason = lambda rule: F.when(~F.col("ran"), "runtime_failure").when(F.col(f"{rule}_hit"), "supported").when(F.col("vague"), "ambiguous_binding").when(F.col(f"{rule}_there"), "insufficient_color_evidence").otherwise("no_target_detection")
    f = f.withColumns({f"{rule}_reason": reason(rule) for rule in rules})

    def counts(rule: str) -> Column:
        count = lambda r: F.count_if(F.col(f"{rule}_reason") == r)
        return F.struct(
            F.count(F.lit(1)).alias("frames"),
            count("runtime_failure").alias("failures"),
            count("supported").alias("successes"),
            F.count_if(F.col("ran") & F.col(f"{rule}_use")).alias("conditional"),
            count("ambiguous_binding").alias("ambiguous"),
            count("insufficient_color_evidence").alias("insufficient"),
            count("no_target_detection").alias("absent"),
        ).alias(rule)

    out = aimed.select("id", "able").join(f.groupBy("id").agg(*(counts(rule) for rule in rules)), "id", "left")

    def scores(variant: str) -> Column:
        c = F.col("written" if variant == "binding" else "named")
        below = c["frames"] if variant == "repair" else c["conditional"]
        n = F.coalesce(c["frames"], F.lit(0))
        status = F.when(~F.col("able"), "unsupported").when((n == 0) | (c["failures"] > 0), "failed").when(below > 0, "succeeded").otherwise("dropped_by_condition")
        rates = {
            "score": F.when(status == "succeeded", c["successes"] / below),
            "conditional_rate": F.when(F.col("able"), F.try_divide(c["successes"], c["conditional"])),
            "lower_bound": F.when(F.col("able"), F.try_divide(c["successes"], c["frames"])),
        }
        kept = ("failures", "successes", "conditional", "ambiguous", "insufficient", "absent")
        return F.struct(n.alias("frames"), *(c[k].alias(k) for k in kept), status.alias("status"), *(x.alias(k) for k, x in rates.items())).alias(variant)

    return out.select("id", *(scores(v) for v in variants))
