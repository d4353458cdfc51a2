"""Reports that are read as tables (survey K14, K17, K19)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cut-offs of a response: negligible, substantive, large, very large. Fixed values.
CUTS = (0.01, 0.05, 0.1, 0.2)


def finite(score: Column, status: Column) -> Column:
    """A succeeded, finite score in 0..1 (with room for rounding), else null; one outside
    fails the query."""
    v = F.when(status == "succeeded", score)
    ok = ~F.isnan(v) & v.between(-1e-6, 1.000001)
    return F.when(v.isNull(), v).when(ok, v).otherwise(F.raise_error(F.lit("invalid succeeded score")))


def stability(scores: DataFrame, cases: list[str], methods: list[str], position: str, clean: str = "clean", background: str = "background", subject: str = "subject", base: str = "official") -> DataFrame:
    """For each ``position`` and method how far scores move when the background or the
    subject is corrupted, against the ``base`` method.

    ``scores`` has a row a case (``cases`` and ``position``), variant, method with score and
    status. All cases stay in the denominator. Joint success: the base moves by 0.1 or more
    on the background, the method by at most 0.01, and not from 0 to 0; with response, the
    subject drops it by 0.05 or more too.
    """
    s = scores.withColumn("v", finite(F.col("score"), F.col("status")))
    at = lambda variant, method: F.max(F.when((F.col("variant") == variant) & (F.col("method") == method), F.col("v")))
    wide = s.groupBy(*cases, position).agg(at(clean, base).alias("oc"), at(background, base).alias("ob"), F.array(*(F.struct(F.lit(m).alias("method"), at(clean, m).alias("c"), at(background, m).alias("b"), at(subject, m).alias("s")) for m in methods)).alias("m"))
    x = wide.select(position, "oc", "ob", F.inline("m"))
    x = x.select(position, "method", F.abs(F.col("oc") - F.col("ob")).alias("origin"), F.abs(F.col("c") - F.col("b")).alias("moved"), (F.col("c") - F.col("s")).alias("drop"), F.coalesce((F.col("c") == 0) & (F.col("b") == 0), F.lit(False)).alias("zero"))
    joint = F.coalesce(~F.col("zero") & (F.col("origin") >= CUTS[2]) & (F.col("moved") <= CUTS[0]), F.lit(False))
    paired = F.col("origin").isNotNull() & F.col("moved").isNotNull()
    d, n = F.col("drop"), F.count(F.lit(1))
    x = x.withColumn("joint", joint).withColumn("paired", paired)
    return x.groupBy(position, "method").agg(
        n.alias("cases"),
        F.count_if("paired").alias("paired"),
        F.round(F.avg(F.when(F.col("paired"), F.col("origin"))), 6).alias("origin_mean"),
        F.round(F.avg(F.when(F.col("paired"), F.col("moved"))), 6).alias("moved_mean"),
        F.count("drop").alias("subject_scored"),
        F.count_if(d > 0).alias("positive"),
        F.count_if(d < 0).alias("wrong_direction"),
        F.count_if(F.abs(d) <= CUTS[0]).alias("negligible"),
        F.count_if(d > CUTS[0]).alias("drop_gt_001"),
        F.count_if(d >= CUTS[1]).alias("drop_ge_005"),
        F.count_if(d >= CUTS[2]).alias("drop_ge_010"),
        F.count_if(d > F.col("moved")).alias("subject_larger"),
        F.count_if("zero").alias("zero_to_zero"),
        F.count_if(F.col("paired") & (F.col("origin") >= CUTS[2])).alias("origin_ge_01"),
        F.count_if(F.col("paired") & (F.col("origin") >= CUTS[3])).alias("origin_ge_02"),
        F.count_if("joint").alias("joint_success"),
        F.round(F.count_if("joint") / n, 6).alias("joint_fraction"),
        F.count_if(F.col("joint") & (d >= CUTS[1])).alias("joint_with_response"),
    )


def _generator_fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import numpy as np

    for t in batches:  # one array a fit: a row a pair of generators
        for row in t["cells"]:
            cells = pd.DataFrame([c.asDict() if hasattr(c, "asDict") else c for c in row])
            names = sorted(set(cells["a"]) | set(cells["b"]))
            a, b = (np.searchsorted(names, cells[c].to_numpy(dtype=object)) for c in "ab")
            w, y = cells["w"].to_numpy(float), cells["wy"].to_numpy(float)
            design, right = np.zeros((len(names),) * 2), np.zeros(len(names))
            for i, sign in ((a, 1.0), (b, -1.0)):
                np.add.at(right, i, sign * y)
                for j, other in ((a, 1.0), (b, -1.0)):
                    np.add.at(design, (i, j), sign * other * w)
            yield pd.DataFrame({"generator": names, "coefficient": np.linalg.pinv(design, hermitian=True) @ right})


def generator_confound(pairs: DataFrame) -> DataFrame:
    """(role, correct, ordered): how far generators alone, fitted to the labels of the
    train pairs (generator_a, generator_b, role, label), tell the ordered pairs of each role.

    Weighted least squares of 2 * label - 1 on the difference of one-hot generators, the
    least solution; ordered and tied pairs weigh half each. The sums are over pairs of
    generators, a designed set of some dozens, and only they are solved for in one task.
    """
    y = 2 * F.col("label") - 1
    train = pairs.filter("role = 'train'").select(F.col("generator_a").alias("a"), F.col("generator_b").alias("b"), y.alias("y"))
    sums = train.groupBy("a", "b").agg(F.count_if(F.col("y") != 0).alias("n"), F.count_if(F.col("y") == 0).alias("t"), F.sum("y").alias("sy"))
    total = sums.agg(F.sum("n").alias("tn"), F.sum("t").alias("tt"))
    ordered = F.try_divide(F.lit(0.5), F.col("tn"))
    w = F.col("n") * F.coalesce(ordered, F.lit(0.0)) + F.col("t") * F.coalesce(F.try_divide(F.lit(0.5), F.col("tt")), F.lit(0.0))
    cells = sums.crossJoin(F.broadcast(total)).select(F.struct("a", "b", w.alias("w"), (F.col("sy") * F.coalesce(ordered, F.lit(0.0))).alias("wy")).alias("cell"))
    fit = cells.agg(F.collect_list("cell").alias("cells")).filter(F.size("cells") > 0).mapInPandas(_generator_fit, "generator string, coefficient double")
    side = lambda c: fit.select(F.col("generator").alias(f"generator_{c}"), F.col("coefficient").alias(f"c_{c}"))
    told = pairs.filter("label <> 0.5").groupBy("role", "generator_a", "generator_b").agg(F.count_if(F.col("label") > 0.5).alias("up"), F.count_if(F.col("label") < 0.5).alias("down"))
    told = told.join(side("a"), "generator_a", "left").join(side("b"), "generator_b", "left")
    lead = F.round(F.col("c_a") - F.col("c_b"), 12)
    right = F.when(lead > 0, F.col("up")).when(lead < 0, F.col("down")).otherwise(0)
    return told.groupBy("role").agg(F.sum(right).alias("correct"), F.sum(F.col("up") + F.col("down")).alias("ordered"))


def natural_population(videos: DataFrame, generator: str, methods: list[str]) -> DataFrame:
    """For each generator, and over all (null), and each method how many videos have a
    score and its mean over those and, if all have one, over the cohort; and beside the
    first method, where both have a score, the mean and median change and how many changed."""
    base = methods[0]
    long = videos.select(generator, F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.col(m).cast("double").alias("v"), (F.col(m) - F.col(base)).cast("double").alias("d")) for m in methods))).alias("x")).select(generator, "x.*")
    n = F.count(F.lit(1))
    return long.groupingSets([["method", generator], ["method"]], "method", generator).agg(
        n.alias("expected"),
        F.count("v").alias("defined"),
        (n - F.count("v")).alias("undefined"),
        F.round(F.avg("v"), 4).alias("mean_defined"),
        F.when(n == F.count("v"), F.round(F.avg("v"), 4)).alias("mean_full"),
        F.count("d").alias("common"),
        F.round(F.avg("d"), 4).alias("mean_delta"),
        F.round(F.percentile("d", F.lit(0.5)), 4).alias("median_delta"),
        F.count_if(F.abs("d") > 1e-12).alias("changed"),
    )
