"""Joins of intervals that overlap, and the choice of spans that do not (survey E13, C20).

An interval is half-open, [start, end); one that does not end after it starts is empty and
overlaps nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.sources.session import ensure_checkpoint_dir

#: Rows of one side that meet in one share of a bin.
SHARE = 50_000


def _level(start: str, end: str) -> Column:
    """The least k with a length of at most 2^k."""
    return F.ceil(F.log2(F.col(end).cast("double") - F.col(start).cast("double"))).cast("int")


def _binned(rows: DataFrame, keys: list[str], levels: list[int], own: str, start: str, end: str) -> DataFrame:
    """A row for each level of the other side (and, as every level is in the list, its own)
    that is not below the row's, and each bin of that level's width that the row touches;
    three bins at most."""
    at = F.explode(F.filter(F.array(*(F.lit(k) for k in levels)), lambda k: k >= F.col(own)))
    rows = rows.withColumn("iv_level", at)
    width = F.pow(F.lit(2.0), F.col("iv_level"))
    bin_ = lambda c: F.floor(F.col(c).cast("double") / width)
    return rows.withColumn("iv_bin", F.explode(F.sequence(bin_(start), bin_(end))))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], start: str = "start", end: str = "end", share: int = SHARE) -> DataFrame:
    """Pairs of intervals of equal ``keys`` that overlap, each once; a side's other columns
    begin with ``l_`` and ``r_``.

    An interval stands in bins as wide as itself, up to the next power of two, and the
    shorter of two also in the bins of the longer one's width; so lengths may differ by any
    factor and no width is chosen. A pair belongs to the bin of its later start. A bin with
    more than ``share`` rows of a side is dealt to shares of both sides; there are at most
    rows / ``share`` such bins, so their list is small. Null keys meet nothing.
    """
    n = {"l": "iv_l", "r": "iv_r"}
    side = {}
    for s, df in (("l", left), ("r", right)):
        named = df.select(*(F.col(c).alias(c if c in keys else f"{s}_{c}") for c in df.columns))
        named = named.filter((F.col(f"{s}_{end}") > F.col(f"{s}_{start}"))).dropna(subset=keys)
        side[s] = named.withColumn(n[s], _level(f"{s}_{start}", f"{s}_{end}"))
    levels = sorted({r[0] for s in side for r in side[s].select(n[s]).distinct().collect()})  # about 2,100 at most
    if not levels:
        levels = [0]
    for s in side:
        side[s] = _binned(side[s], keys, levels, n[s], f"{s}_{start}", f"{s}_{end}")
    bins = [*keys, "iv_level", "iv_bin"]
    counts = side["l"].select(*bins, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(side["r"].select(*bins, F.lit(0).alias("l"), F.lit(1).alias("r"))).groupBy(*bins).agg(F.sum("l").alias("iv_nl"), F.sum("r").alias("iv_nr"))
    hot = counts.filter(((F.col("iv_nl") > share) | (F.col("iv_nr") > share)) & (F.col("iv_nl") > 0) & (F.col("iv_nr") > 0))
    hot = hot.select(*bins, F.ceil(F.col("iv_nl") / share).cast("int").alias("iv_a"), F.ceil(F.col("iv_nr") / share).cast("int").alias("iv_b"))
    one, zero = F.lit(1), F.lit(0)
    for s, own, other in (("l", "iv_a", "iv_b"), ("r", "iv_b", "iv_a")):
        d = side[s].join(F.broadcast(hot), bins, "left")
        mine = F.pmod(F.monotonically_increasing_id(), F.coalesce(own, one)).cast("int")
        copies = F.explode(F.sequence(zero, F.coalesce(other, one) - 1))
        d = d.withColumn("iv_mine", mine).withColumn("iv_copy", copies)
        names = ("iv_mine", "iv_copy") if s == "l" else ("iv_copy", "iv_mine")
        side[s] = d.withColumn("iv_sa", F.col(names[0])).withColumn("iv_sb", F.col(names[1])).drop("iv_a", "iv_b", "iv_mine", "iv_copy")
    both = side["l"].join(side["r"], [*bins, "iv_sa", "iv_sb"])
    later = F.greatest(F.col(f"l_{start}").cast("double"), F.col(f"r_{start}").cast("double"))
    met = (F.col(f"l_{start}") < F.col(f"r_{end}")) & (F.col(f"r_{start}") < F.col(f"l_{end}"))
    once = (F.col("iv_level") == F.greatest("iv_l", "iv_r")) & (F.floor(later / F.pow(F.lit(2.0), F.col("iv_level"))) == F.col("iv_bin"))
    return both.filter(met & once).drop("iv_level", "iv_bin", "iv_sa", "iv_sb", *n.values())


def _running(rows: DataFrame, keys: list[str], at: str, sums: list[str], most: list[str]) -> DataFrame:
    """``rows``, one for each of ``keys`` and ``at``, with the sums and greatest values up to
    and with each row, as ``iv_to_`` and the name. No task sees more of a key than a range
    of the order: what is before a range is added up apart, one row a range and key."""
    ensure_checkpoint_dir(rows.sparkSession)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written once, as a second run could cut the ranges elsewhere.
    ranged = rows.repartitionByRange(n, *keys, at).withColumn("iv_part", F.spark_partition_id()).checkpoint()
    parts = ranged.groupBy(*keys, "iv_part").agg(*(F.sum(c).alias(c) for c in sums), *(F.max(c).alias(c) for c in most))
    earlier = Window.partitionBy(*keys).orderBy("iv_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, "iv_part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"iv_b_{c}") for c in sums), *(F.max(c).over(earlier).alias(f"iv_b_{c}") for c in most))
    own = Window.partitionBy(*keys, "iv_part").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({f"iv_to_{c}": F.sum(c).over(own) for c in sums} | {f"iv_to_{c}": F.max(c).over(own) for c in most})
    both = local.join(parts, [*keys, "iv_part"])
    total = {f"iv_to_{c}": F.col(f"iv_to_{c}") + F.col(f"iv_b_{c}") for c in sums} | {f"iv_to_{c}": F.greatest(f"iv_to_{c}", f"iv_b_{c}") for c in most}
    return both.withColumns(total).drop("iv_part", *(f"iv_b_{c}" for c in [*sums, *most]))


def overlap_totals(left: DataFrame, right: DataFrame, keys: list[str], value: str, start: str = "start", end: str = "end") -> DataFrame:
    """Of the pairs that ``overlap_join`` lists, for each of ``keys`` that has any: how many
    there are (``pairs``), the sums over them of either side's whole numbers ``value``
    (``l_sum``, ``r_sum``), and the longest stretch that a pair shares (``longest``).

    No pair is listed. A left interval overlaps the right ones that start before it ends,
    without those that end by its start; and after any time the longest stretch of pairs
    begun by then ends with the earlier of both sides' latest ends. So running sums over
    the times of a key suffice, and the work grows with the rows, not the pairs.
    """
    sides = []
    for s, df in (("l", left), ("r", right)):
        kept = df.filter(F.col(end) > F.col(start)).dropna(subset=keys)
        ends = F.array(*(F.struct(F.col(c).alias("iv_at"), F.lit(f"{s}_{c2}").alias("iv_kind")) for c, c2 in ((start, "opens"), (end, "closes"))))
        sides.append(kept.select(*keys, F.col(value).cast("long").alias("iv_value"), F.col(end).alias("iv_until"), F.explode(ends).alias("iv_x")).select(*keys, "iv_value", "iv_until", "iv_x.*"))
    kind = F.col("iv_kind")
    kinds = [f"{s}_{c}" for s in "lr" for c in ("opens", "closes")]
    wide = lambda c: c.cast("decimal(20,0)")  # noqa: E731  # products of sums pass 64 bits where their difference does not
    sums = {f"{k}_n": wide(F.count_if(kind == k)) for k in kinds} | {f"{k}_v": wide(F.coalesce(F.sum(F.when(kind == k, F.col("iv_value"))), F.lit(0))) for k in kinds}
    until = {f"{s}_until": F.max(F.when(kind == f"{s}_opens", F.col("iv_until"))) for s in "lr"}
    points = sides[0].unionByName(sides[1]).groupBy(*keys, "iv_at").agg(*(x.alias(k) for k, x in (sums | until).items()))
    t = _running(points, keys, "iv_at", ["r_opens_n", "r_opens_v", "r_closes_n", "r_closes_v"], ["l_until", "r_until"])
    begun = {x: F.col(f"iv_to_r_opens_{x}") - F.col(f"r_opens_{x}") for x in "nv"}  # before this time
    over = lambda mine, theirs: F.sum(F.col(f"l_closes_{mine}") * begun[theirs] - F.col(f"l_opens_{mine}") * F.col(f"iv_to_r_closes_{theirs}")).cast("long")
    shared = F.when(F.col("iv_to_l_until").isNotNull() & F.col("iv_to_r_until").isNotNull(), F.least("iv_to_l_until", "iv_to_r_until") - F.col("iv_at"))
    return t.groupBy(*keys).agg(over("n", "n").alias("pairs"), over("v", "n").alias("l_sum"), over("n", "v").alias("r_sum"), F.max(shared).alias("longest")).filter("pairs > 0")


def longest_first(spans: Column) -> Column:
    """Of an array of structs with ``start`` and ``end``: the longest, of equals the earliest,
    then the next that overlaps none of those taken, and so on; by place."""
    order = F.transform(spans, lambda s: F.struct((s["start"] - s["end"]).alias("length"), s["start"].alias("at"), s.alias("span")))
    none = F.filter(spans, lambda s: F.lit(False))
    free = lambda taken, s: ~F.exists(taken, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"]))
    chosen = F.aggregate(F.array_sort(order), none, lambda taken, x: F.when(free(taken, x["span"]), F.concat(taken, F.array(x["span"]))).otherwise(taken))
    return F.array_sort(chosen, lambda a, b: (a["start"] - b["start"]).cast("int"))
