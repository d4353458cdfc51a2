"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows lie in virtual partitions. How many rows of each partition go to each shard is
drawn first, from the multivariate hypergeometric law that a uniform permutation of
all rows would give (rows of the matrix sum to the partitions' sizes, columns to the
shards'). Each partition is then permuted on its own, its rows exchanged as the matrix
says, and each shard permuted again. Everything is a DataFrame expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.llm.common import free_name, ranked, text_or_empty, written


#: About how many rows a task permutes.
PARTITION = 100_000


def _uniform(*key: Column) -> Column:
    """A double in [0, 1) from a 64-bit hash."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") / F.lit(float(2**53))


def _ln_factorial(x: Column) -> Column:
    """ln x! by Stirling's series of ln gamma, ten steps up, where it is exact to rounding."""
    z = x + F.lit(11.0)
    product = x + F.lit(1.0)
    for k in range(2, 11):
        product = product * (x + F.lit(float(k)))
    series = F.lit(1.0) / (z * 12) - F.lit(1.0) / (z * z * z * 360) + F.lit(1.0) / (z * z * z * z * z * 1260)
    return (z - 0.5) * F.log(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + series - F.log(product)


def _ln_choose(n: Column, k: Column) -> Column:
    return _ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once: a transform of a one-element array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hypergeometric(u: Column, pool: Column, good: Column, draws: Column) -> Column:
    """How many of ``draws`` rows, drawn without replacement from ``pool`` rows of which
    ``good`` count, are good: the inverse of the distribution at ``u`` (longs, null-free).

    The search starts at the mode and takes one value above and one below at a time, first
    over eight standard deviations and twelve values, which hold all but 1e-15 of the mass,
    and only where they do not hold the value over all the rest. What no value takes is the
    sum's rounding and counts as the last one.
    """

    def search(v: Column) -> Column:
        n_, k_, d_ = v["pool"], v["good"], v["draws"]
        least = F.greatest(F.lit(0.0), d_ - (n_ - k_))
        most = F.least(k_, d_)
        mode = F.least(most, F.greatest(least, F.floor((d_ + 1) * (k_ + 1) / (n_ + 2)).cast("double")))
        spread = F.sqrt(F.greatest(F.lit(0.0), d_ * (k_ / n_) * (F.lit(1.0) - k_ / n_)))
        return F.struct(v["u"].alias("u"), n_.alias("pool"), k_.alias("good"), d_.alias("draws"), least.alias("least"), most.alias("most"), mode.alias("mode"), F.least(most - least, F.ceil(spread * 8).cast("double") + 12).cast("int").alias("steps"), (most - least).cast("int").alias("all"))

    def walk(v: Column) -> Column:
        n_, k_, d_, mode = v["pool"], v["good"], v["draws"], v["mode"]
        p = F.exp(_ln_choose(k_, mode) + _ln_choose(n_ - k_, d_ - mode) - _ln_choose(n_, d_))
        left = v["u"] - p
        state = lambda u, up, p_up, down, p_down, at: F.struct(u.alias("u"), up.alias("up"), p_up.alias("p_up"), down.alias("down"), p_down.alias("p_down"), at.alias("at"))
        begin = state(left, mode, p, mode, p, F.when(left < 0, mode).otherwise(F.lit(-1.0)))

        def step(s: Column, _: Column) -> Column:
            x, y = s["up"], s["down"]
            p_up = F.when(x < v["most"], s["p_up"] * ((k_ - x) * (d_ - x)) / ((x + 1) * (n_ - k_ - d_ + x + 1))).otherwise(F.lit(0.0))
            p_down = F.when(y > v["least"], s["p_down"] * (y * (n_ - k_ - d_ + y)) / ((k_ - y + 1) * (d_ - y + 1))).otherwise(F.lit(0.0))
            after = s["u"] - p_up
            at = F.when(s["at"] >= 0, s["at"]).when(after < 0, x + 1).when(after - p_down < 0, y - 1).otherwise(F.lit(-1.0))
            return state(after - p_down, F.least(x + 1, v["most"]), p_up, F.greatest(y - 1, v["least"]), p_down, at)

        end = lambda s: F.when(s["at"] >= 0, s["at"]).otherwise(s["up"]).cast("long")
        rest = lambda s: F.aggregate(F.sequence(v["steps"], v["all"]), s, step, end)
        near = F.aggregate(F.sequence(F.lit(0), v["steps"]), begin, step)
        return _let(near, lambda s: F.when((s["at"] >= 0) | (v["steps"] >= v["all"]), end(s)).otherwise(rest(s)))

    known = F.struct(u.alias("u"), pool.cast("double").alias("pool"), good.cast("double").alias("good"), draws.cast("double").alias("draws"))
    sure = F.when(pool <= 0, F.lit(0).cast("long")).when(good >= pool, draws).when(good <= 0, F.lit(0).cast("long"))
    return F.coalesce(sure, _let(_let(known, search), walk))


def _matrix(sizes: Column, room: Column, shards: int, key: Column) -> Column:
    """One row for each of ``sizes``: how many of its rows go to each shard, drawn one
    partition after another from what ``room`` the shards have left."""

    def one(state: Column, i: Column) -> Column:
        def cell(s: Column, j: Column) -> Column:
            good = F.get(state["room"], j)
            take = hypergeometric(_uniform(key, i, j), s["pool"], good, s["left"])
            return _let(take, lambda t: F.struct((s["pool"] - good).alias("pool"), (s["left"] - t).alias("left"), F.concat(s["row"], F.array(t)).alias("row")))

        pool = F.aggregate(state["room"], F.lit(0).cast("long"), lambda a, b: a + b)
        begin = F.struct(pool.alias("pool"), F.get(sizes, i).alias("left"), F.array().cast("array<bigint>").alias("row"))
        row = F.aggregate(F.sequence(F.lit(0), F.lit(shards - 1)), begin, cell, lambda s: s["row"])
        return _let(row, lambda r: F.struct(F.zip_with(state["room"], r, lambda a, b: a - b).alias("room"), F.concat(state["rows"], F.array(r)).alias("rows")))

    begin = F.struct(room.alias("room"), F.array().cast("array<array<bigint>>").alias("rows"))
    return F.aggregate(F.sequence(F.lit(0), F.size(sizes) - 1), begin, one, lambda s: s["rows"])


def communication_matrix(counts: DataFrame, shards: int, partitions: int, seed: int) -> DataFrame:
    """(part, ends): the running sums of each partition's row of the matrix.

    ``counts`` has (part, n). Drawn in two levels, groups of partitions first and then
    the partitions of each group in parallel, so no task draws more than about
    sqrt(partitions) rows of the matrix. It has ``partitions`` rows.
    """
    wide = max(1, math.isqrt(partitions))
    groups = -(-partitions // wide)
    all_parts = counts.sparkSession.range(partitions).select(F.col("id").cast("int").alias("part"))
    full = all_parts.join(counts, "part", "left").select("part", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.expr(f"cast(part div {wide} as int)").alias("g"))
    in_order = lambda c: F.transform(F.sort_array(F.collect_list(c)), lambda x: x["n"])
    by_group = full.groupBy("g").agg(in_order(F.struct("part", "n")).alias("sizes"), F.sum("n").alias("n"))
    top = by_group.agg(in_order(F.struct("g", "n")).alias("sizes"), F.sum("n").alias("total"))
    even = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda j: F.expr(f"total div {shards}") + F.when(j.cast("long") < F.col("total") % shards, F.lit(1)).otherwise(F.lit(0)))
    rooms = top.withColumn("room", even).select(F.posexplode(_matrix(F.col("sizes"), F.col("room"), shards, F.lit(seed))).alias("g", "room"))
    parts = by_group.join(rooms, "g").repartition(groups, "g")
    rows = parts.select("g", F.posexplode(_matrix(F.col("sizes"), F.col("room"), shards, F.struct(F.lit(seed + 1), F.col("g")))).alias("k", "row"))
    ends = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda j: F.aggregate(F.slice("row", 1, j), F.lit(0).cast("long"), lambda a, b: a + b))
    return rows.select((F.col("g") * wide + F.col("k")).cast("int").alias("part"), ends.alias("ends"))


def hypergeometric_shuffle(docs: DataFrame, shards: int = 24, partitions: int | None = None, seed: int = 20240607) -> DataFrame:
    """``docs`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in its shard).

    Shard sizes differ by one at most; given ``seed`` the result depends on the rows
    only, not on how Spark has split them. ``partitions`` virtual partitions hold about
    equal numbers of rows; unless given, as many as hold ``PARTITION`` rows each.
    A row is dealt and ordered by hashes of all its columns: rows with null or equal ids
    are dealt like any other, wholly equal rows are interchangeable, texts of any length
    are hashed whole, an empty table gives an empty one. Columns named shard or slot are
    replaced, as by ``withColumn``; other names cannot clash.
    """
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ("shard", "slot")))
    rows = docs.count()
    partitions = partitions or max(256, -(-rows // PARTITION))
    part, place, ends, mix = (free_name(docs.columns, x) for x in ("hg_part", "hg_place", "hg_ends", "hg_mix"))
    every = [F.col(f"`{c}`") for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))]
    dealt = docs.withColumn(part, F.pmod(F.xxhash64(F.lit(seed), *every), F.lit(partitions)).cast("int"))
    counts = dealt.groupBy(part).agg(F.count(F.lit(1)).alias("n")).withColumnRenamed(part, "part")
    matrix = communication_matrix(counts, shards, partitions, seed).withColumnsRenamed({"part": f"{part}_m", "ends": ends})
    permuted = Window.partitionBy(part).orderBy(F.xxhash64(F.lit(seed + 2), *every), *every)
    sent = dealt.withColumn(place, F.row_number().over(permuted).cast("long") - 1)
    sent = sent.join(matrix, F.col(part) == F.col(f"{part}_m"))
    sent = sent.withColumn("shard", F.size(F.filter(ends, lambda e: e <= F.col(place))).cast("int"))
    sent = written(sent.drop(part, f"{part}_m", place, ends), "sharding")
    sent = sent.withColumn(mix, F.xxhash64(F.lit(seed + 3), *every))
    return ranked(sent, ["shard"], [F.col(mix), *every], F.shiftright(mix, 20), max(32, -(-rows // (shards * PARTITION))), "slot").select(*(f"`{c}`" for c in docs.columns), "shard", "slot")


def query(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = hypergeometric_shuffle(rows)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
