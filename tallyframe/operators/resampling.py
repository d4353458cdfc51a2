"""Bootstraps over any number of clusters (survey K04, K09, K10).

A draw of as many clusters as there are is a multinomial count of the clusters. It is drawn
from the top: clusters lie in buckets by a hash, a binary tree over the buckets halves a
draw's number at each node by a binomial of the node's own seed, and the clusters of a bucket
share what reaches it. A task needs the path to its bucket and the clusters in it, no list of
all slots and no number of all clusters.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.sources.session import ensure_checkpoint_dir

#: Most buckets; their sizes are known to the driver.
BUCKETS = 4096


def _reach(sizes: np.ndarray, bucket: int, draws: int, seed: int) -> np.ndarray:
    """How many clusters each draw takes from ``bucket``; the number of buckets is a power of
    two. Every task that walks through a node draws the same there."""
    low, high, taken = 0, len(sizes), np.full(draws, int(sizes.sum()), np.int64)
    while high - low > 1:
        mid, whole = (low + high) // 2, int(sizes[low:high].sum())
        share = int(sizes[low:mid].sum()) / whole if whole else 0.0
        left = np.random.default_rng([seed, low, high]).binomial(taken, share)
        taken, low, high = (left, low, mid) if bucket < mid else (taken - left, mid, high)
    return taken


def resampled_sums(rows: DataFrame, cluster: str, sums: dict[str, Column], draws: int, seed: int, buckets: int | None = None) -> DataFrame:
    """(b, clusters, and each of ``sums`` over the clusters that draw b takes, as often as it
    takes them); the same for the same clusters, however the rows lie. Rows without a cluster
    go; null values count as none."""
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    wanted = min(BUCKETS, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = 1 << max(0, wanted - 1).bit_length()
    names = list(sums)
    each = rows.filter(F.col(cluster).isNotNull()).groupBy(F.col(cluster).cast("string").alias("rs_cluster")).agg(*(F.coalesce(F.sum(c.cast("double")), F.lit(0.0)).alias(n) for n, c in sums.items()))
    each = each.withColumn("rs_bucket", F.pmod(F.xxhash64("rs_cluster"), F.lit(buckets)).cast("int")).checkpoint()
    sizes = np.zeros(buckets, np.int64)
    for r in each.groupBy("rs_bucket").agg(F.count(F.lit(1)).alias("k")).collect():  # a row a bucket
        sizes[r["rs_bucket"]] = r["k"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["rs_bucket"].iloc[0])
        values = pdf.sort_values("rs_cluster")[names].to_numpy()
        rng = np.random.default_rng([seed, len(sizes), bucket, 1])
        out = np.zeros((draws, len(names)))
        for b, m in enumerate(_reach(sizes, bucket, draws, seed)):
            out[b] = np.bincount(rng.integers(0, len(values), m), minlength=len(values)) @ values
        return pd.DataFrame(out, columns=names).assign(b=np.arange(draws))

    schema = ", ".join([*(f"`{n}` double" for n in names), "b long"])
    parts = each.groupBy("rs_bucket").applyInPandas(run, schema)
    return parts.groupBy("b").agg(F.lit(int(sizes.sum())).alias("clusters"), *(F.sum(n).alias(n) for n in names))


def interval(draws: DataFrame, statistic: Column, least: int = 2) -> DataFrame:
    """One row: clusters, valid (draws whose statistic is defined), low and high at 2.5 % and
    97.5 % of those; no interval for fewer than ``least`` clusters."""
    each = draws.select("clusters", statistic.alias("r"))
    ends = each.agg(F.max("clusters").alias("clusters"), F.count("r").alias("valid"), F.percentile("r", F.lit(0.025)).alias("low"), F.percentile("r", F.lit(0.975)).alias("high"))  # a number a draw
    enough = F.col("clusters") >= least
    return ends.select("clusters", "valid", *(F.when(enough, F.col(c)).alias(c) for c in ("low", "high")))


def ratio_interval(rows: DataFrame, cluster: str, part: Column, whole: Column, draws: int, seed: int) -> DataFrame:
    """A ratio of sums with its interval; the estimate, or a draw, whose denominator is
    not positive is undefined, and undefined draws do not count."""
    sums = {"part": part, "whole": whole}
    ratio = F.when(F.col("whole") > 0, F.col("part") / F.col("whole"))
    point = rows.filter(F.col(cluster).isNotNull()).agg(F.sum(part.cast("double")).alias("part"), F.sum(whole.cast("double")).alias("whole")).select(ratio.alias("estimate"))
    ends = interval(resampled_sums(rows, cluster, sums, draws, seed), ratio)
    return point.join(F.broadcast(ends)).select("clusters", "estimate", "valid", "low", "high")  # two tables of one row


def common_delta(rows: DataFrame, cluster: str, a: str, b: str, draws: int, seed: int) -> DataFrame:
    """Mean of ``b`` less mean of ``a`` over the rows that have both, beside each one's
    mean over all its rows, and the interval of the former."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    of = lambda c: F.when(both, F.col(c).cast("double"))
    sums = {"sa": of(a), "sb": of(b), "n": both.cast("int")}
    delta = F.when(F.col("n") > 0, (F.col("sb") - F.col("sa")) / F.col("n"))
    known = rows.filter(F.col(cluster).isNotNull())
    point = known.agg(F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.count_if(both).alias("common"), F.avg(F.when(both, F.col(b).cast("double") - F.col(a).cast("double"))).alias("delta"))
    ends = interval(resampled_sums(rows, cluster, sums, draws, seed), delta)
    return point.join(F.broadcast(ends)).select("clusters", "common", "mean_a", "mean_b", "delta", "valid", "low", "high")
