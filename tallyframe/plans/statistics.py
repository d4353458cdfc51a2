"""Statistics whose groups are split over tasks: quantiles, tau-b, bootstraps of many clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import concordance as K
from tallyframe.operators import resampling as B
from tallyframe.operators.quantiles import exact_quantiles
from tallyframe.plans.registry import query, read


@query("""SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.01), 4) AS q01, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50, round(quantile_cont(l_extendedprice, 0.999), 4) AS q999 FROM lineitem GROUP BY 1, 2""")
def price_quantiles(spark, d):  # a handful of groups, each of many values
    q = {"q01": 0.01, "q50": 0.5, "q999": 0.999}
    out = exact_quantiles(read(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_extendedprice"), ["l_returnflag", "l_linestatus"], "l_extendedprice", q)
    return out.select("l_returnflag", "l_linestatus", *(F.round(n, 4).alias(n) for n in q))


@query("""WITH x AS (SELECT p_partkey AS i, p_retailprice AS x, (p_partkey * 7919) % 1009 + p_size / 64 AS y FROM part),
s AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y)) AS s, sum(CASE WHEN a.x = b.x THEN 1 ELSE 0 END) AS tx, sum(CASE WHEN a.y = b.y THEN 1 ELSE 0 END) AS ty, count(*) AS n FROM x a JOIN x b ON a.i < b.i)
SELECT round(s / sqrt((n - tx)::DOUBLE * (n - ty)), 6) AS tau_b FROM s""")
def price_concordance(spark, d):  # both columns of about as many levels as rows
    y = (F.col("p_partkey") * 7919) % 1009 + F.col("p_size") / 64
    return K.tau_b(read(spark, d, "part", "p_partkey", "p_retailprice", "p_size").select(F.col("p_retailprice").alias("x"), y.alias("y")), "x", "y", flat=float("nan"))


@query()
def order_ratio_bootstrap(spark, d):  # K10: an order is a cluster; its law is held against theory in tests
    li = read(spark, d, "lineitem", "l_orderkey", "l_extendedprice", "l_discount")
    out = B.ratio_interval(li, "l_orderkey", F.col("l_extendedprice") * F.col("l_discount"), F.col("l_extendedprice"), 200, 7)
    return out.select("clusters", "valid", *(F.round(c, 6).alias(c) for c in ("estimate", "low", "high")))


@query()
def order_delta_bootstrap(spark, d):  # K09: of lines of an order that have both figures
    li = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_tax", "l_discount")
    li = li.select("l_orderkey", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_tax")).alias("a"), F.when(F.col("l_linenumber") % 2 != 0, F.col("l_discount")).alias("b"))
    out = B.common_delta(li, "l_orderkey", "a", "b", 200, 7)
    return out.select("clusters", "common", "valid", *(F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "delta", "low", "high")))
