"""Coverage-aware aggregates, agreement, correlation and bootstraps (survey F, K)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.functions.scores import outcome
from tallyframe.functions.text import hash_int
from tallyframe.operators.concordance import tau_b as kendall_tau_b  # noqa: F401 - F25
from tallyframe.operators.relational import cumulated


def coverage_summary(rows: DataFrame, by: list[str], score: str = "score", digits: int = 6) -> DataFrame:
    """full and defined denominators; the population mean is null unless every row
    has a score, the subset mean has a name of its own."""
    n, k = F.count(F.lit(1)), F.count(score)
    mean = F.round(F.avg(score), digits)
    return rows.groupBy(*by).agg(n.alias("total"), k.alias("defined"), F.round(k / n, 6).alias("coverage"), mean.alias("observed_subset_mean"), F.when(k == n, mean).alias("complete_mean"))


def pair_accuracy(pairs: DataFrame, by: list[str], margin: Column) -> DataFrame:
    """Share of valid pairs whose outcome is the label; all pairs stay in ``total``."""
    d = F.col("score_a") - F.col("score_b")
    hit = F.when(d.isNotNull(), (outcome(d, margin) == F.col("label")).cast("double"))
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count(d).alias("valid"), F.round(F.avg(hit), 6).alias("accuracy"))


def tie_margin(pairs: DataFrame) -> DataFrame:
    """The smallest margin of greatest accuracy, among 0 and all absolute differences.

    Counts per distinct difference are cumulated in one ordered pass instead of trying
    every margin on every pair: at margin m the ties up to m and the signs beyond count.
    """
    d = pairs.select(F.abs(F.col("score_a") - F.col("score_b")).alias("m"), (F.col("score_a") - F.col("score_b")).alias("d"), "label").filter("d is not null")
    by = d.groupBy("m").agg(F.count_if(F.col("label") == 0.5).alias("ties"), F.count_if(((F.col("d") > 0) & (F.col("label") == 1.0)) | ((F.col("d") < 0) & (F.col("label") == 0.0))).alias("signs"), F.count(F.lit(1)).alias("n"))
    zero = pairs.sparkSession.createDataFrame([(0.0, 0, 0, 0)], "m double, ties long, signs long, n long")
    by = by.unionByName(zero).groupBy("m").agg(F.sum("ties").alias("ties"), F.sum("signs").alias("signs"), F.sum("n").alias("n"))
    total = by.agg(F.sum("signs").alias("all_signs"), F.sum("n").alias("all_n"))
    tried = cumulated(by, ["m"], {"ties": "ties_before", "signs": "signs_before"}).crossJoin(F.broadcast(total))  # one row
    right = F.col("ties_before") + F.col("ties") + F.col("all_signs") - F.col("signs_before") - F.col("signs")
    best = tried.withColumn("right", right).agg(F.min_by("m", F.struct(-F.col("right"), "m")).alias("margin"), F.max("right").alias("right"), F.first("all_n").alias("n"))
    return best.select(F.round("margin", 9).alias("margin"), F.round(F.col("right") / F.col("n"), 6).alias("dev_accuracy"))


def pearson(x: str, y: str) -> Column:
    """an aggregate, Pearson's correlation of two columns: null without rows, NaN where a
    column does not vary (``corr`` fails there under ANSI rules)."""
    spread = F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y))
    return F.when(spread == 0, float("nan")).otherwise(F.try_divide(F.covar_pop(x, y), spread))


def win_ratios(pairs: DataFrame) -> DataFrame:
    """a pair gives its outcome to one model and the rest to the other."""
    p = outcome(F.col("score_a") - F.col("score_b"), 0.0)
    rows = pairs.select(F.explode(F.array(F.struct(F.col("model_a").alias("model"), p.alias("p"), F.col("label").alias("l")), F.struct(F.col("model_b").alias("model"), (1 - p).alias("p"), (1 - F.col("label")).alias("l")))).alias("x")).select("x.*")
    return rows.filter("p is not null").groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("win_ratio"), F.round(F.avg("l"), 6).alias("label_ratio"))


def auc_half_ties(rows: DataFrame, positive: Column, value: str) -> DataFrame:
    """probability that a positive's value exceeds a negative's, ties half, from
    counts per distinct value."""
    by = rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("q"))
    at = cumulated(by, [value], {"q": "below"})
    return at.agg(F.round(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)) / (F.sum("p") * F.sum("q")), 6).alias("auc"), F.sum("p").alias("positives"), F.sum("q").alias("negatives"))


def mid_rank(rows: DataFrame, column: str, rank: str) -> DataFrame:
    """``rows`` with the rank of a value, ties at the middle, from counts per distinct
    value; rows with a null value go."""
    counts = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("mr_n"))
    at = cumulated(counts, [column], {"mr_n": "mr_before"})
    return rows.join(at.select(column, (F.col("mr_before") + (F.col("mr_n") + 1) / 2.0).alias(rank)), column)


def cluster_bootstrap(rows: DataFrame, cluster: str, value: str, draws: int, seed: int, weight: Column | None = None) -> DataFrame:
    """95 % interval of a ratio of sums when whole clusters are drawn again.

    Clusters are reduced to their sums first; a draw takes as many clusters as there are,
    each by a hash of seed, draw and slot, the same in any engine. Fewer than two
    clusters give a null interval.
    """
    w = weight if weight is not None else F.lit(1.0)
    sums = rows.filter(F.col(value).isNotNull()).groupBy(F.col(cluster).alias("bs_cluster")).agg(F.sum(F.col(value).cast("double")).alias("bs_s"), F.sum(w.cast("double")).alias("bs_n"))
    k = sums.agg(F.count(F.lit(1)).alias("k"), F.sum("bs_s").alias("ts"), F.sum("bs_n").alias("tc"))
    numbered = cumulated(sums.withColumn("bs_one", F.lit(1).cast("long")), ["bs_cluster"], {"bs_one": "j"}).select("j", "bs_s", "bs_n")
    slots = rows.sparkSession.range(draws).select(F.col("id").alias("b")).crossJoin(F.broadcast(k)).select("b", "k", F.explode(F.expr("sequence(0L, k - 1)")).alias("slot"))
    drawn = slots.select("b", (hash_int(F.concat_ws(":", F.lit(str(seed)), "b", "slot")) % F.col("k")).alias("j"))
    each = drawn.join(numbered, "j").groupBy("b").agg((F.sum("bs_s") / F.sum("bs_n")).alias("r"))
    ends = each.agg(F.percentile("r", F.lit(0.025)).alias("lo"), F.percentile("r", F.lit(0.975)).alias("hi"))
    two = F.col("k") >= 2
    return k.crossJoin(ends).select(F.col("k").alias("clusters"), F.round(F.col("ts") / F.col("tc"), 6).alias("estimate"), F.when(two, F.round("lo", 6)).alias("low"), F.when(two, F.round("hi", 6)).alias("high"))


def top_mean(rows: DataFrame, by: str, value: str, order: str, count: Column, name: str) -> DataFrame:
    """the mean of the ``count`` greatest values of a group (all, if there are fewer). A
    fixed count is a limit by rank, which Spark applies before the shuffle too."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(value), order))
    return rows.withColumn("tm_rank", rank).filter(F.col("tm_rank") <= count).groupBy(by).agg(F.avg(value).alias(name))


def set_prf1(rows: DataFrame, predicted: str, gold: str) -> DataFrame:
    """precision, recall and F1 of sets per row; two empty sets agree fully."""
    tp = F.size(F.array_intersect(predicted, gold))
    p = F.when(F.size(predicted) > 0, tp / F.size(predicted)).otherwise(F.when(F.size(gold) == 0, 1.0).otherwise(0.0))
    r = F.when(F.size(gold) > 0, tp / F.size(gold)).otherwise(F.when(F.size(predicted) == 0, 1.0).otherwise(0.0))
    return rows.withColumns({"tp": tp, "precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)})


def power_law(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """slope of ln y on ln x over positive values; null for fewer than two distinct x."""
    ok = rows.filter((F.col(x) > 0) & (F.col(y) > 0))
    return ok.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.when(F.count_distinct(x) >= 2, F.regr_slope(F.log(y), F.log(x))).alias("exponent"))


def paired_bootstrap(rows: DataFrame, cluster: str, a: str, b: str, draws: int, seed: int) -> DataFrame:
    """Mean of ``b`` minus mean of ``a`` over rows that have both, with the 95 %
    interval when clusters are drawn again, one set of draws for both columns."""
    both = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    sums = both.groupBy(F.col(cluster).alias("bs_cluster")).agg(F.sum(F.col(a).cast("double")).alias("bs_a"), F.sum(F.col(b).cast("double")).alias("bs_b"), F.count(F.lit(1)).alias("bs_n"))
    k = sums.agg(F.count(F.lit(1)).alias("k"), F.sum("bs_a").alias("ta"), F.sum("bs_b").alias("tb"), F.sum("bs_n").alias("tn"))
    numbered = cumulated(sums.withColumn("bs_one", F.lit(1).cast("long")), ["bs_cluster"], {"bs_one": "j"}).select("j", "bs_a", "bs_b", "bs_n")
    slots = rows.sparkSession.range(draws).select(F.col("id").alias("b")).crossJoin(F.broadcast(k)).select("b", "k", F.explode(F.expr("sequence(0L, k - 1)")).alias("slot"))
    drawn = slots.select("b", (hash_int(F.concat_ws(":", F.lit(str(seed)), "b", "slot")) % F.col("k")).alias("j"))
    each = drawn.join(numbered, "j").groupBy("b").agg(((F.sum("bs_b") - F.sum("bs_a")) / F.sum("bs_n")).alias("r"))
    ends = each.agg(F.percentile("r", F.lit(0.025)).alias("lo"), F.percentile("r", F.lit(0.975)).alias("hi"))
    two = F.col("k") >= 2
    return k.crossJoin(ends).select(F.col("k").alias("clusters"), F.col("tn").alias("n"), F.round((F.col("tb") - F.col("ta")) / F.col("tn"), 4).alias("delta"), F.when(two, F.round("lo", 4)).alias("low"), F.when(two, F.round("hi", 4)).alias("high"))

