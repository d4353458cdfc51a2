"""Reports that set methods side by side and pairs built from annotations (survey K12, K18,
M01, M06)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.scores import outcome
from tallyframe.operators import stats as K
from tallyframe.operators.concordance import tau_b
from tallyframe.operators.quantiles import exact_quantiles
from tallyframe.operators.resampling import interval, resampled_sums

QUANTILES = {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95}


def paired_statistics(rows: DataFrame, arm: str, base: str, changed: dict[str, str]) -> DataFrame:
    """A row an arm over rows that have the base value and that of every seed (``changed``:
    seed to column): means, mean change and mean absolute change, the base's deviation (of the
    population), range and quantiles, the greatest changes, and the changed mean by seed."""
    values = [base, *changed.values()]
    r = rows.dropna(subset=values).select(F.col(arm).alias(arm), *(F.col(v).cast("double").alias(v) for v in values))
    diffs = [F.col(c) - F.col(base) for c in changed.values()]
    n = len(diffs)
    mean = lambda xs: reduce(lambda a, b: a + b, xs) / n
    least, most = (F.least(*diffs), F.greatest(*diffs)) if n > 1 else (diffs[0], diffs[0])
    out = r.groupBy(arm).agg(
        F.count(F.lit(1)).alias("sources"), F.avg(base).alias("base_mean"), F.avg(mean([F.col(c) for c in changed.values()])).alias("changed_mean"), F.avg(mean(diffs)).alias("delta"), F.avg(mean([F.abs(d) for d in diffs])).alias("mae"),
        F.stddev_pop(base).alias("base_std"), F.min(base).alias("base_low"), F.max(base).alias("base_high"), F.min(least).alias("largest_drop"), F.max(most).alias("largest_increase"), F.max(F.greatest(F.abs(least), F.abs(most))).alias("maximum_change"),
        *(F.avg(c).alias(f"mean_{seed}") for seed, c in changed.items()),
    )
    return out.join(exact_quantiles(r, [arm], base, QUANTILES), arm)


def change_interval(rows: DataFrame, cluster: str, base: str, changed: list[str], draws: int, seed: int, absolute: bool = False) -> DataFrame:
    """The mean change (or its size) of one arm with its interval over clusters."""
    known = rows.dropna(subset=[cluster, base, *changed])
    parts = [F.col(c).cast("double") - F.col(base).cast("double") for c in changed]
    each = reduce(lambda a, b: a + b, [F.abs(p) if absolute else p for p in parts]) / len(parts)
    ends = interval(resampled_sums(known, cluster, {"s": each, "n": F.lit(1)}, draws, seed), F.col("s") / F.col("n"))
    return known.agg(F.avg(each).alias("mean")).join(F.broadcast(ends)).select("clusters", "mean", "valid", "low", "high")  # two tables of one row


def scale_margin(rows: DataFrame, cluster: str, origin: str, new: str, draws: int, seed: int, share: float = 0.1) -> DataFrame:
    """Whether the mean of ``new`` is at most ``share`` of that of ``origin``, defined only
    where the latter is positive, and the interval of what it has beyond."""
    known = rows.dropna(subset=[cluster, origin, new])
    o, n = F.avg(origin), F.avg(new)
    point = known.agg(F.when(o > 0, share * o).alias("allowed"), F.when(o > 0, n / o).alias("ratio"), F.when(o > 0, n <= share * o).alias("passed"))
    beyond = F.col(new).cast("double") - share * F.col(origin).cast("double")
    ends = interval(resampled_sums(known, cluster, {"s": beyond, "n": F.lit(1)}, draws, seed), F.col("s") / F.col("n"))
    return point.join(F.broadcast(ends))  # two tables of one row


def method_metrics(pairs: DataFrame) -> DataFrame:
    """One row of a method over pairs (model_a, model_b, score_a, score_b, label, split in
    dev and test): accuracies without a margin, the margin found on dev, the test accuracy
    under it, tau-b, coverage, and Pearson's correlation of the models' mean outcomes. A split
    without a valid pair fails the query. ``pairs`` is read several times."""
    d = F.col("score_a") - F.col("score_b")
    both = pairs.filter(d.isNotNull())
    hit = lambda m: (outcome(d, m) == F.col("label")).cast("double")
    of = lambda s, x: F.avg(F.when(F.col("split") == s, x))
    margin = K.tie_margin(both.filter("split = 'dev'")).select("margin")
    one = both.join(F.broadcast(margin)).agg(of("dev", hit(0.0)).alias("dev_acc0"), of("test", hit(0.0)).alias("test_acc0"), F.first("margin").alias("tie_margin"), of("test", hit(F.col("margin"))).alias("test_tie_aware_acc"), F.count(F.lit(1)).alias("valid_pairs"))  # one row
    tau = tau_b(both.filter("split = 'test'").select(d.alias("x"), F.col("label").alias("y")), "x", "y", flat=float("nan")).withColumnRenamed("tau_b", "kendall_tau_b")
    pearson = K.win_ratios(both).agg(K.pearson("win_ratio", "label_ratio").alias("pearson"))
    total = pairs.agg(F.count(F.lit(1)).alias("total_pairs"))
    out = one.join(tau).join(pearson).join(total).withColumn("coverage", F.col("valid_pairs") / F.col("total_pairs"))  # tables of one row
    known = F.col("dev_acc0").isNotNull() & F.col("test_acc0").isNotNull()
    return out.withColumn("dev_acc0", F.when(known, F.col("dev_acc0")).otherwise(F.raise_error(F.lit("no valid pairs of dev or test"))))


def compared(first: DataFrame, second: DataFrame, keys: list[str], values: list[str], names: tuple[str, str] = ("official", "repair")) -> DataFrame:
    """``values`` of two methods side by side with what the second has more, joined one to
    one; a key on one side only, or twice, fails the query."""
    from tallyframe.operators.contracts import strict_join

    sides = [t.select(*keys, *(F.col(v).alias(f"{n}_{v}") for v in values)) for t, n in zip((first, second), names, strict=True)]
    both = strict_join(*sides, keys)
    return both.select(*keys, *(c for v in values for c in (F.col(f"{names[0]}_{v}"), F.col(f"{names[1]}_{v}"), (F.col(f"{names[1]}_{v}") - F.col(f"{names[0]}_{v}")).alias(f"delta_{v}"))))


#: Generators whose folder has another name. Fixed values.
FOLDERS = {"videocraft": "videocrafter"}


def annotated_pairs(rows: DataFrame, available: DataFrame, folder: Column) -> DataFrame:
    """Annotations (source_row, videos: generator to path, anno: generator to generator
    to label) as a row each two generators, by name: both labels, whether they add up to one,
    and the places of both videos in ``folder``, null where ``available`` (path) lacks the path
    or its first folder is not the generator's. Every pair stays; ``usable`` tells those with
    both videos and a label. A path that is absolute or leads out fails the query."""
    safe = lambda p: (~p.startswith("/")) & (p != "") & ~F.exists(F.split(p, "/"), lambda x: x == "..")
    checked = F.when(F.forall(F.map_values("videos"), safe), F.col("videos")).otherwise(F.raise_error(F.lit("unsafe source path")))
    r = rows.withColumn("videos", checked)
    paths = r.select("source_row", F.explode("videos").alias("generator", "path"))
    home = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in FOLDERS.items() for x in kv)), F.col("generator")), F.col("generator"))
    have = available.select("path").distinct().withColumn("there", F.lit(True))
    found = paths.join(have, "path", "left").withColumn("ok", F.coalesce("there", F.lit(False)) & (F.substring_index("path", "/", 1) == home))
    # A handful of generators an annotation.
    each = found.groupBy("source_row").agg(F.array_sort(F.collect_list(F.struct("generator", "path", "ok"))).alias("g"))
    e = each.join(r.select("source_row", "anno"), "source_row")
    e = e.select("source_row", "anno", F.posexplode("g").alias("i", "a"), "g").select("source_row", "anno", "a", F.explode(F.slice("g", F.col("i") + 2, F.size("g"))).alias("b"))
    label = lambda x, y: F.try_element_at(F.try_element_at("anno", F.col(f"{x}.generator")), F.col(f"{y}.generator"))
    e = e.withColumns({"label_a_over_b": label("a", "b"), "label_b_over_a": label("b", "a")})
    reciprocal = F.coalesce(F.abs(F.col("label_a_over_b") + F.col("label_b_over_a") - 1.0) < 1e-8, F.lit(False))
    at = lambda s: F.when(F.col(f"{s}.ok"), F.concat(folder, F.lit("/"), F.col(f"{s}.path")))
    return e.select(
        "source_row", F.col("a.generator").alias("generator_a"), F.col("b.generator").alias("generator_b"), F.col("a.path").alias("path_a"), F.col("b.path").alias("path_b"), at("a").alias("video_a"), at("b").alias("video_b"),
        "label_a_over_b", "label_b_over_a", reciprocal.alias("reciprocal"), (F.col("a.ok") & F.col("b.ok") & F.col("label_a_over_b").isNotNull()).alias("usable"),
    )


#: Relations and their opposites, and the class that stands for every scene but itself and
#: the one for it. Fixed values.
OPPOSITE = {"on the left of": "on the right of", "on the right of": "on the left of", "on the top of": "on the bottom of", "on the bottom of": "on the top of"}
SCENE_SWAP = ("kitchen", "ocean")
_NO_TARGET, _NO_SYNONYM, _NO_DIRECTION = "no_official_auxiliary_target", "no_strict_synonym_in_frozen_lexicon", "outside_four_direction_protocol"
_ROW = "struct<transform:string,evidence_kind:string,prompt:string,target:string,eligible:boolean,reason:string,axis:string,control:string,level:double,expected:string>"


def transform_matrix(rows: DataFrame, synonyms: dict[str, str]) -> DataFrame:
    """Rows (task, prompt, target) with a row a transform: identity for all; scenes under a
    ``synonyms`` lexicon and under a fixed other class; spatial relations mirrored in the
    evidence, the video and the prompt; every other task under twelve occlusions. What cannot
    be done stays, with ``eligible`` false and the reason. A task or prompt that is null has the
    identity alone."""
    prompt, target = F.col("prompt"), F.col("target")
    known = target.isNotNull()
    none = F.lit(None).cast("string")

    def row(transform: str, prompt_=prompt, target_=target, eligible=known, reason=None, kind="original", axis=none, control=none, level=None, expected=None) -> Column:
        reason = F.when(~known, _NO_TARGET) if reason is None else reason
        text = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
        return F.struct(F.lit(transform).alias("transform"), F.lit(kind).alias("evidence_kind"), prompt_.alias("prompt"), target_.alias("target"), eligible.alias("eligible"), reason.alias("reason"), axis.alias("axis"), text(control).alias("control"), F.lit(level).cast("double").alias("level"), text(expected).alias("expected")).cast(_ROW)

    table = F.create_map(*(F.lit(x) for kv in synonyms.items() for x in kv)) if synonyms else F.create_map().cast("map<string,string>")
    bare = F.regexp_replace(F.lower(F.trim(prompt)), "^(a|an|the) ", "")
    other_name = F.try_element_at(table, bare)
    article = F.when(F.substring(other_name, 1, 1).isin(*"aeiou"), "an ").otherwise("a ")
    swap = F.when(bare != SCENE_SWAP[0], SCENE_SWAP[0]).otherwise(SCENE_SWAP[1])
    scene = F.array(
        row("synonym", F.when(other_name.isNotNull(), F.concat(article, other_name)).otherwise(prompt), other_name, other_name.isNotNull(), F.when(other_name.isNull(), _NO_SYNONYM), expected="invariant"),
        row("class_swap", F.concat(F.lit("a "), swap), swap, expected="sensitivity_if_replacement_absent"),
    )
    opposite = F.try_element_at(F.create_map(*(F.lit(x) for kv in OPPOSITE.items() for x in kv)), target)
    valid = opposite.isNotNull()
    axis = F.when(valid, F.when(target.rlike("left|right"), "hflip").otherwise("vflip"))
    at = F.instr(prompt, target)
    swapped = F.when(valid & (at > 0), F.overlay(prompt, opposite, at, F.length(target))).otherwise(prompt)
    why = F.when(~valid, _NO_DIRECTION)
    turned = ("evidence_mirror", "video_mirror")
    spatial = F.array(
        *(row(k, eligible=valid, reason=why, kind=k, axis=axis, expected="reverse_direction") for k in turned), row("prompt_swap", swapped, opposite, valid, why, axis=axis, expected="reverse_direction"),
        *(row(f"{k}_joint", swapped, opposite, valid, why, kind=k, axis=axis, expected="invariant") for k in turned),
    )
    hidden = F.array(*(row(f"{c}_occlusion_{lv}", kind="occlusion", control=c, level=lv, expected="fail_if_target_verified_invisible" if c == "target" else "control") for c in ("target", "background", "non_target") for lv in (0.0, 0.5, 0.8, 1.0)))
    empty = F.array().cast(f"array<{_ROW}>")
    more = F.when(F.col("task").isNull() | prompt.isNull(), empty).when(F.col("task") == "scene", scene).when(F.col("task") == "spatial", spatial).otherwise(hidden)
    keep = [c for c in rows.columns if c not in ("prompt", "target")]
    return rows.select(*keep, F.explode(F.concat(F.array(row("identity")), more)).alias("mx")).select(*keep, "mx.*")
