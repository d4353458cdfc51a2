"""Exact quantiles of groups of any size by refining counted ranges (survey F16, F21).

A quantile lies between two ranks. Each round counts the values of a rank's range in bins,
which combine before the shuffle, and keeps the bin that holds the rank, narrowed to the
values in it; a range of one value is the answer. No task sees a group's values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.sources.session import ensure_checkpoint_dir

#: Bins of a range, ranges up to whose number their table is sent to every task, and rounds.
BINS, FEW, ROUNDS = 1024, 100_000, 400


def _same(names: list[str]) -> Column:
    """Equal to the columns of a table whose names ``_other`` made."""
    return reduce(lambda x, y: x & y, (F.col(n).eqNullSafe(F.col(f"o_{n}")) for n in names))


def _other(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumnsRenamed({n: f"o_{n}" for n in names})


def _linear(x: Column, lo: Column, hi: Column) -> Column:
    """0 to BINS in even steps; halves, as the width itself may be no number."""
    width = hi / 2 - lo / 2
    return F.when(width > 0, F.floor((x / 2 - lo / 2) / width * BINS)).otherwise(F.when(x > lo, BINS).otherwise(0))


def _scaled(x: Column) -> Column:
    """A number that grows with ``x`` by its order of magnitude."""
    return F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.log(F.abs(x)) + 746))


def exact_quantiles(rows: DataFrame, by: list[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """A row a group: for each name the quantile of its probability, read between the two
    nearest ranks as ``percentile`` does. Nulls do not count; a group with none but nulls has
    no row; a value that is not finite fails the query.

    Even and magnitude-wise bins take turns, so values of any spread need few rounds; the
    first value and the last of a range never share an even bin, so every range ends.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    keys = [f"q_key{i}" for i in range(len(by))]
    x = F.col(value).cast("double")
    finite = F.when(F.abs(x) < float("inf"), x).otherwise(F.raise_error(F.lit("a value is not finite")))
    v = rows.filter(F.col(value).isNotNull()).select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), finite.alias("x"))
    if not by:
        keys = ["q_key0"]
        v = v.withColumn("q_key0", F.lit(0))
    total = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    asked = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in probabilities.items()))).alias("a")
    at = total.select(*keys, "n", "lo", "hi", asked).withColumn("place", (F.col("n") - 1) * F.col("a.p"))
    ends = F.explode(F.array(F.struct(F.lit("low").alias("side"), F.floor("place").alias("rank")), F.struct(F.lit("high").alias("side"), F.ceil("place").alias("rank")))).alias("e")
    targets = at.select(*keys, F.col("a.name").alias("name"), "place", ends, "lo", "hi").select(*keys, "name", "place", "e.side", "e.rank", "lo", "hi").checkpoint()
    names = targets.columns
    for k in range(ROUNDS):
        open_ = targets.filter("lo < hi")
        ranges = open_.select(*keys, "lo", "hi").distinct().checkpoint()
        n = ranges.count()
        if not n:
            break
        r = _other(ranges, keys)
        inside = v.join(F.broadcast(r) if n <= FEW else r, _same(keys) & (F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi"))).select(*keys, "x", "lo", "hi")
        lo, hi = F.col("lo"), F.col("hi")
        bin_ = _linear(F.col("x"), lo, hi) if k % 2 == 0 else _linear(_scaled(F.col("x")), _scaled(lo), _scaled(hi))
        counts = inside.groupBy(*keys, "lo", "hi", F.least(bin_, F.lit(BINS - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("new_lo"), F.max("x").alias("new_hi"))
        w = Window.partitionBy(*keys, "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0)))  # BINS rows a range at most
        hit = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("c"))
        both = open_.join(_other(counts, [*keys, "lo", "hi"]), _same([*keys, "lo", "hi"]) & hit)
        moved = both.select(*keys, "name", "place", "side", (F.col("rank") - F.col("before")).alias("rank"), F.col("new_lo").alias("lo"), F.col("new_hi").alias("hi"))
        targets = targets.filter("lo >= hi").select(*names).unionByName(moved.select(*names)).checkpoint()
    else:
        raise RuntimeError("quantiles did not settle")
    of = lambda n, s: F.max(F.when((F.col("name") == n) & (F.col("side") == s), F.col("lo")))
    place = lambda n: F.max(F.when(F.col("name") == n, F.col("place")))

    def between(n: str) -> Column:
        p, low, high = place(n), of(n, "low"), of(n, "high")
        return F.when((F.ceil(p) == F.floor(p)) | (low == high), low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)

    out = targets.groupBy(*keys).agg(*(between(n).alias(n) for n in probabilities))
    return out.select(*(F.col(k).alias(c) for c, k in zip(by, keys, strict=False)), *probabilities)
