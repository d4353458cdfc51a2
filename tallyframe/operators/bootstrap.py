"""Intervals by drawing clusters again, for statistics that have no sums (survey K03-K08).

A draw takes as many clusters as there are, each by a hash of seed, draw and slot, the
same in any engine. Draws are counted per cluster before members are joined, so a draw
costs a row a member at most; clusters are units of a design (prompts, families).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.text import hash_int
from tallyframe.operators.relational import cumulated


def multiplicities(rows: DataFrame, cluster: str, draws: int, seed: int) -> DataFrame:
    """(b, cluster, m): how often a draw takes each cluster it takes at all."""
    keys = rows.select(F.col(cluster).alias("bs_cluster")).distinct()
    numbered = cumulated(keys.withColumn("bs_one", F.lit(1).cast("long")), ["bs_cluster"], {"bs_one": "j"})
    k = keys.agg(F.count(F.lit(1)).alias("k"))
    slots = rows.sparkSession.range(draws).select(F.col("id").alias("b")).crossJoin(F.broadcast(k)).select("b", "k", F.explode(F.expr("sequence(0L, k - 1)")).alias("slot"))
    drawn = slots.groupBy("b", (hash_int(F.concat_ws(":", F.lit(str(seed)), "b", "slot")) % F.col("k")).alias("j")).agg(F.count(F.lit(1)).alias("m"))
    return drawn.join(numbered, "j").select("b", F.col("bs_cluster").alias(cluster), "m")


def _median(c: str, weight: str | None = None) -> Column:
    return F.percentile(c, F.lit(0.5), *([F.col(weight)] if weight else []))


def _interval(each: DataFrame, columns: list[str]) -> DataFrame:
    ends = [F.percentile(c, F.lit(q)).alias(f"{c}_{n}") for c in columns for n, q in (("low", 0.025), ("high", 0.975))]
    return each.agg(*ends)


def resampled(rows: DataFrame, cluster: str, values: list[str], draws: int, seed: int, digits: int = 4) -> DataFrame:
    """For each of ``values`` mean, median and their 95 % intervals; one set of
    draws for all. Only rows with all values count. Null intervals for one cluster."""
    kept = rows.dropna(subset=[cluster, *values]).select(cluster, *(F.col(v).cast("double").alias(v) for v in values))
    point = kept.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(cluster).alias("clusters"), *(F.avg(v).alias(f"{v}_mean") for v in values), *(_median(v).alias(f"{v}_median") for v in values))
    each = kept.join(multiplicities(kept, cluster, draws, seed), cluster).groupBy("b").agg(
        *((F.sum(F.col(v) * F.col("m")) / F.sum("m")).alias(f"{v}_mean") for v in values), *(_median(v, "m").alias(f"{v}_median") for v in values)
    )
    ends = _interval(each, [f"{v}_{s}" for v in values for s in ("mean", "median")])
    two = F.col("clusters") >= 2
    names = [f"{v}_{s}" for v in values for s in ("mean", "median")]
    out = [F.round(x, digits).alias(x) for x in names] + [F.when(two, F.round(f"{x}_{e}", digits)).alias(f"{x}_{e}") for x in names for e in ("low", "high")]
    return point.crossJoin(F.broadcast(ends)).select("n", "clusters", *out)


def effects(rows: DataFrame, key: str, value: str, draws: int, seed: int, digits: int = 4) -> DataFrame:
    """Medians of a signed effect and of its size with intervals over rows drawn again,
    and how many effects are zero."""
    both = rows.dropna(subset=[value]).select(F.col(key).alias("ef_key"), F.col(value).alias("signed"), F.abs(value).alias("size"))
    out = resampled(both, "ef_key", ["signed", "size"], draws, seed, digits)
    zero = both.agg(F.count_if(F.col("signed") == 0).alias("zero_effects"))
    return out.crossJoin(F.broadcast(zero)).select("n", "signed_median", "signed_median_low", "signed_median_high", "size_median", "size_median_low", "size_median_high", "zero_effects")


def gate(relation: str) -> Column:
    """Whether the row of ``effects`` meets a relation; null without rows."""
    c = F.col
    rules = {
        "change": (c("size_median") >= 0.20) & (c("size_median_low") > 0.10),
        "ordered_drop": (c("signed_median") >= 0.20) & (c("signed_median_low") > 0.10),
        "invariance": (c("size_median") <= 0.05) & (c("signed_median_low") <= 0) & (c("signed_median_high") >= 0),
    }
    return F.when(c("n") > 0, rules[relation])


def order_statistic_interval(rows: DataFrame, key: str, value: str, draws: int, seed: int) -> DataFrame:
    """The mean of ``value`` and the two means that stand 2.5 % and 97.5 % along the
    sorted means of ``draws`` draws of single rows."""
    kept = rows.dropna(subset=[value]).select(F.col(key).alias("bs_key"), F.col(value).cast("double").alias("v"))
    each = kept.join(multiplicities(kept, "bs_key", draws, seed), "bs_key").groupBy("b").agg((F.sum(F.col("v") * F.col("m")) / F.sum("m")).alias("r"))
    line = F.sort_array(F.collect_list("r"))  # one number a draw
    ends = each.agg(*(F.get(line, F.lit(int(q * (draws - 1)))).alias(n) for n, q in (("low", 0.025), ("high", 0.975))))
    return kept.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("estimate")).crossJoin(F.broadcast(ends)).select("n", "estimate", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def macro_interval(rows: DataFrame, cluster: str, stratum: str, strata: list, value: str, draws: int, seed: int) -> DataFrame:
    """The mean over ``strata`` of the mean in each, undefined where one is empty;
    undefined draws are left out and counted."""
    sums = rows.filter(F.col(stratum).isin(strata)).groupBy(cluster).agg(*(x.alias(f"{n}{i}") for i, s in enumerate(strata) for n, x in (("s", F.sum(F.when(F.col(stratum) == s, F.coalesce(F.col(value).cast("double"), F.lit(0.0))).otherwise(0.0))), ("n", F.count_if(F.col(stratum) == s)))))
    means = lambda w: [F.sum(F.col(f"s{i}") * w) / F.nullif(F.sum(F.col(f"n{i}") * w), F.lit(0)) for i in range(len(strata))]
    macro = lambda w: sum(means(w)[1:], means(w)[0]) / len(strata)  # noqa: E731 - null if a stratum is empty
    each = sums.join(multiplicities(sums, cluster, draws, seed), cluster).groupBy("b").agg(macro(F.col("m")).alias("r"))
    line = F.sort_array(F.collect_list("r"))  # one number a valid draw
    valid = F.count("r")
    at = lambda q: F.get(line, F.floor(F.lit(q) * (valid - 1)).cast("int"))
    ends = each.agg(valid.alias("bootstrap_valid"), at(0.025).alias("low"), at(0.975).alias("high"))
    point = sums.agg(F.count(F.lit(1)).alias("families"), macro(F.lit(1)).alias("estimate"))
    ok = (F.col("families") >= 2) & F.col("estimate").isNotNull()
    return point.crossJoin(F.broadcast(ends)).select("families", F.round("estimate", 6).alias("estimate"), F.when(ok, F.col("bootstrap_valid")).otherwise(0).alias("bootstrap_valid"), *(F.when(ok, F.round(x, 6)).alias(x) for x in ("low", "high")))
