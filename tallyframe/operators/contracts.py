"""Data contracts that fail the query instead of mending the data (survey L01-L08, E03, E18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require(rows: DataFrame, condition: Column, message: Column | str) -> DataFrame:
    """The rows, if the condition holds for each; a row for which it does not, or is null,
    fails the query with the message."""
    text = F.lit(message) if isinstance(message, str) else message
    checked = F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(F.raise_error(text))
    return rows.filter(checked)


def require_unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts combine before the shuffle, so a key that stands often is no hot task."""
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rq_n"))
    bad = require(n, F.col("rq_n") == 1, F.concat(F.lit("duplicate key "), F.to_json(F.struct(*keys))))
    same = [rows[k].eqNullSafe(bad[k]) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return rows.join(bad, on, "left_semi")


def require_range(rows: DataFrame, value: str, least: float, most: float) -> DataFrame:
    """Finite and in the range; null passes, as a missing score is no score."""
    v = F.col(value).cast("double")
    return require(rows, v.isNull() | (~F.isnan(v) & v.between(least, most)), F.concat(F.lit(f"{value} out of range: "), v.cast("string")))


def strict_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One to one on the keys; a missing, extra or repeated key fails the query."""
    a = left.withColumn("rq_l", F.lit(1))
    b = right.withColumn("rq_r", F.lit(1))
    both = require_unique(a, keys).join(require_unique(b, keys), keys, "full")
    return require(both, F.col("rq_l").isNotNull() & F.col("rq_r").isNotNull(), F.concat(F.lit("key on one side only: "), F.to_json(F.struct(*keys)))).drop("rq_l", "rq_r")


def closure(scanned: int, retained: int, quarantined: int, filtered: int = 0) -> None:
    """What was read is what was kept, set aside or filtered."""
    if scanned != retained + quarantined + filtered:
        raise ValueError(f"{scanned} rows read, {retained} kept, {quarantined} set aside, {filtered} filtered")


def same_identity(results: DataFrame, inputs: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """``results``, if they have each key of ``inputs`` exactly once and equal
    ``fields``; null equals null."""
    asked = inputs.select(*keys, *(F.col(f).alias(f"id_{f}") for f in fields))
    both = strict_join(results, asked, keys)
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"id_{f}"))
    return require(both, same, F.concat(F.lit("identity changed: "), F.to_json(F.struct(*keys)))).select(*results.columns)


def reviewed(rows: DataFrame, review: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """The rows that ``review`` names; a review without its row, named twice, or with
    other ``fields`` than the row, fails the query."""
    named = require_unique(review, keys).select(*keys, *(F.col(f).alias(f"rv_{f}") for f in fields))
    have = rows.withColumn("rv_there", F.lit(1))
    both = named.join(require_unique(have, keys), keys, "left")
    same = F.col("rv_there").isNotNull()
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"rv_{f}"))
    return require(both, same, F.concat(F.lit("review of other content: "), F.to_json(F.struct(*keys)))).select(*rows.columns)


def recomputed(published: DataFrame, fresh: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-12) -> DataFrame:
    """The keys and values in which ``published`` is not what was computed anew: more
    than ``tolerance`` apart, on one side only, or null on one side."""
    a = published.select(*keys, *(F.col(v).cast("double").alias(f"p_{v}") for v in values), F.lit(1).alias("rc_p"))
    b = fresh.select(*keys, *(F.col(v).cast("double").alias(f"f_{v}") for v in values), F.lit(1).alias("rc_f"))
    both = a.join(b, keys, "full")
    one = F.explode(F.array(*(F.struct(F.lit(v).alias("field"), F.col(f"p_{v}").alias("published"), F.col(f"f_{v}").alias("fresh")) for v in values)))
    apart = ~F.coalesce(F.abs(F.col("x.published") - F.col("x.fresh")) <= tolerance, F.col("x.published").isNull() & F.col("x.fresh").isNull())
    return both.select(*keys, (F.col("rc_p").isNull() | F.col("rc_f").isNull()).alias("alone"), one.alias("x")).filter(apart | F.col("alone")).select(*keys, "x.field", "x.published", "x.fresh")
