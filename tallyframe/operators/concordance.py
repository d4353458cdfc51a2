"""Kendall's tau-b of two columns of any number of levels (survey F25).

Pairs of rows are split by ranges of x and ranges of y. Pairs in different ranges of both
are told from the counts of the cells; pairs in one range of x, and pairs in one range of y
but different ranges of x, are counted within the range by merging. Values that hold many
rows are ranges of their own, in which no pair counts, so a range is never large.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.sources.session import ensure_checkpoint_dir

#: Most cuts of an axis; the cells, which meet in one task, are (2 x RANGES + 1)^2 at most.
RANGES = 1024


def signed_pairs(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """Concordant less discordant pairs of rows that stand ``n`` times each; no two rows are
    equal. Pairs equal in x or y count as none."""
    order = np.lexsort((y, x))
    x, y, n = x[order], np.unique(y[order], return_inverse=True)[1].astype(np.int64), n[order].astype(np.int64)
    size, levels, at, total = len(n), int(y.max(initial=0)) + 1, np.arange(len(n)), np.longdouble(0)
    width = 1
    while width < size:
        block, right = at // (2 * width), (at // width) % 2 == 1
        key = block * levels + y
        left = np.flatnonzero(~right)
        left = left[np.argsort(key[left], kind="stable")]
        keys, sums = key[left], np.concatenate([[0], np.cumsum(n[left])])
        mine, own = key[right], block[right] * levels
        less = sums[np.searchsorted(keys, mine)] - sums[np.searchsorted(keys, own)]
        more = sums[np.searchsorted(keys, own + levels)] - sums[np.searchsorted(keys, mine, "right")]
        total += (n[right].astype(np.longdouble) * (less - more)).sum()
        width *= 2
    # Rows of one x stand in the order of y, so all their pairs were taken as concordant.
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if size else np.zeros(0, int)
    each, squares = (np.add.reduceat(v.astype(np.longdouble), starts) if size else np.zeros(0) for v in (n, n.astype(np.longdouble) ** 2))
    return float(total - ((each**2 - squares) / 2).sum())


def _of_range(rows: pd.DataFrame) -> pd.DataFrame:
    """Pairs within a range of x; of a range of y those that lie in different ranges of x."""
    s = signed_pairs(rows["x"].to_numpy(), rows["y"].to_numpy(), rows["n"].to_numpy())
    if rows["axis"].iloc[0] == "y":
        s -= sum(signed_pairs(c["x"].to_numpy(), c["y"].to_numpy(), c["n"].to_numpy()) for _, c in rows.groupby("xr"))
    return pd.DataFrame({"s": [s]})


def _of_cells(cells: pd.DataFrame) -> pd.DataFrame:
    """Pairs in different ranges of both axes, from the counts of the cells."""
    grid = np.zeros((cells["xr"].max() + 1, cells["yr"].max() + 1), np.longdouble)
    grid[cells["xr"], cells["yr"]] = cells["n"]
    before = np.vstack([np.zeros_like(grid[:1]), np.cumsum(grid, axis=0)[:-1]])
    upto = np.cumsum(before, axis=1)
    less, more = upto - before, upto[:, -1:] - upto
    return pd.DataFrame({"s": [float((grid * (less - more)).sum())]})


def _located(counts: DataFrame, axis: str, ranges: int) -> DataFrame:
    """``counts`` with the range of ``axis``: odd for a cut itself, even between two cuts."""
    shares = [i / ranges for i in range(1, ranges)]
    cuts = counts.agg(F.percentile_approx(axis, F.array(*(F.lit(s) for s in shares)), 20 * ranges).alias("c")).first()["c"] if shares else []
    cuts = np.unique(np.array(cuts or [], float))

    @F.arrow_udf("int")
    def range_of(values: pa.Array) -> pa.Array:
        v = values.to_numpy(zero_copy_only=False)
        at = np.searchsorted(cuts, v)
        return pa.array(2 * at + (np.append(cuts, np.nan)[at] == v), pa.int32())

    return counts.withColumn(f"{axis}r", range_of(axis))


def tau_b(rows: DataFrame, x: str, y: str, ranges: int | None = None, flat: float | None = None) -> DataFrame:
    """One row: ``tau_b``, null for fewer than two rows and ``flat`` where a column does not
    vary. Rows with a null or no number in either column go."""
    ensure_checkpoint_dir(rows.sparkSession)
    ranges = ranges or min(RANGES, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    both = rows.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    counts = both.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    at = _located(_located(counts, "x", ranges), "y", ranges).checkpoint()
    near = None
    for axis in "xy":
        some = at.filter(F.col(f"{axis}r") % 2 == 0).select(F.lit(axis).alias("axis"), F.col(f"{axis}r").alias("r"), "xr", "x", "y", "n")
        near = some if near is None else near.unionByName(some)
    s = near.groupBy("axis", "r").applyInPandas(_of_range, "s double")
    cells = at.groupBy("xr", "yr").agg(F.sum("n").alias("n"))
    s = s.unionByName(cells.groupBy(F.lit(0).alias("one")).applyInPandas(lambda pdf: _of_cells(pdf), "s double"))
    pairs = lambda c: F.sum(F.col(c).cast("double") * (F.col(c) - 1) / 2)
    tied = lambda c: counts.groupBy(c).agg(F.sum("n").alias("k")).agg(pairs("k").alias(f"t{c}"), F.sum("k").cast("double").alias(f"n{c}"))
    one = s.agg(F.sum("s").alias("s")).join(tied("x")).join(tied("y"))  # three tables of one row
    every = F.col("nx") * (F.col("nx") - 1) / 2
    spread = F.sqrt((every - F.col("tx")) * (every - F.col("ty")))
    tau = F.when(F.col("nx") >= 2, F.coalesce(F.try_divide(F.col("s"), spread), F.lit(flat).cast("double")))
    return one.select(F.round(tau, 6).alias("tau_b"))
