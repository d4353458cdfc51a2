"""Hooks for methods of one's own (survey 2.P, L02, H11): a function that scores batches of
inputs, and one that sums results up, both under a contract."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyframe.operators.contracts import require
from tallyframe.operators.relational import cumulated

#: Scores one batch of inputs: a row for each of them, in any order.
BatchEvaluator = Callable[[pd.DataFrame], pd.DataFrame]
#: What a result may be. Fixed values.
STATUSES = ("succeeded", "failed", "not_implemented", "unsupported")
RESULT = "status string, score double, error string"


def numbered(inputs: DataFrame, order: str) -> DataFrame:
    """``inputs`` with ``ordinal``, the place from 0 by a unique column, taken in ranges of the
    order; what is done with the rows may lose their order and sort by it again."""
    return cumulated(inputs.withColumn("ev_one", F.lit(1).cast("long")), [order], {"ev_one": "ordinal"}).drop("ev_one")


def run_evaluator(inputs: DataFrame, evaluator: BatchEvaluator, key: str, more: str = "", isolate: bool = False) -> DataFrame:
    """``inputs`` with the evaluator's columns: status, score, error and those of ``more``, a
    schema. The evaluator gets batches of inputs with their keys, in the order of the rows.

    It has to return each key of its batch exactly once, a status of ``STATUSES``, and a
    finite score where and only where it succeeded; else the query fails, naming the key.
    Its order does not matter: rows come back in that of the inputs. With ``isolate`` an
    error that it raises makes the rows of its batch failed ones instead.
    """
    made = StructType.fromDDL(", ".join(x for x in (RESULT, more) if x))
    names = made.names
    if taken := {n.lower() for n in names} & {c.lower() for c in inputs.columns}:
        raise ValueError(f"inputs have columns {sorted(taken)} of the results")
    schema = StructType([*inputs.schema.fields, *made.fields])

    def checked(batch: pd.DataFrame) -> pd.DataFrame:
        try:
            got = evaluator(batch.copy())
        except Exception as e:
            if not isolate:
                raise
            got = pd.DataFrame({key: batch[key], "status": "failed", "score": None, "error": f"{type(e).__name__}: {e}"})
        got = got.reindex(columns=[key, *names])
        asked, have = list(batch[key]), list(got[key])
        wrong = [k for k in have if k not in set(asked)] + [k for k in asked if k not in set(have)] + [k for k in dict.fromkeys(have) if have.count(k) != asked.count(k)] if sorted(map(str, have)) != sorted(map(str, asked)) else []
        if wrong or len(have) != len(asked):
            raise ValueError(f"results do not cover their inputs once: {wrong[:3]}")
        if len(set(asked)) != len(asked):
            raise ValueError("inputs repeat a key")
        for k, status, score in zip(got[key], got["status"], got["score"], strict=True):
            if status not in STATUSES:
                raise ValueError(f"unknown status {status!r} of {k}")
            if (status == "succeeded") != (score is not None and not pd.isna(score) and abs(float(score)) < float("inf")):
                raise ValueError(f"status and score of {k} do not agree")
        by_key = got.astype(object).where(got.notna(), None).set_index(key)[names]
        return pd.concat([batch.reset_index(drop=True), by_key.loc[asked].reset_index(drop=True)], axis=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield checked(batch)

    return inputs.mapInPandas(run, schema)


def covered_once(inputs: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Results that came from elsewhere, joined to the inputs they belong to, with
    the inputs' columns (``ordinal`` among them, to order by); a key that is missing, foreign or
    there twice fails the query."""
    n = results.groupBy(F.col(key).alias("ev_key")).agg(F.count(F.lit(1)).alias("ev_n"))
    both = inputs.select(F.col(key), F.lit(True).alias("ev_in")).join(n, F.col(key).eqNullSafe(F.col("ev_key")), "full")
    good = require(both, F.col("ev_in").isNotNull() & (F.coalesce("ev_n", F.lit(0)) == 1), F.concat(F.lit("results do not cover their inputs once: "), F.coalesce(F.col(key).cast("string"), F.col("ev_key").cast("string"), F.lit("null"))))
    rows = results.select(*(F.col(c) for c in results.columns if c not in inputs.columns or c == key)).withColumnRenamed(key, "ev_key")
    kept = inputs.join(good.select(F.col("ev_key").alias("ev_ok")), F.col(key).eqNullSafe(F.col("ev_ok")), "left_semi")
    return kept.join(rows, F.col(key).eqNullSafe(F.col("ev_key"))).drop("ev_key")


def summary(results: DataFrame, custom: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row of a run: status (not_implemented without results or with none but such,
    complete, partial or failed), counts, their map by status, and the mean of the scores of
    what succeeded; or what ``custom`` makes of the results."""
    if custom is not None:
        return custom(results)
    n = F.count(F.lit(1))
    of = lambda s: F.count_if(F.col("status") == s)
    good = F.when(F.col("status") == "succeeded", F.col("score"))
    one = results.agg(n.alias("total"), *(of(s).alias(f"is_{s}") for s in STATUSES), F.count(good).alias("valid_samples"), F.avg(good).alias("aggregate"), F.count("error").alias("errors"))
    c = F.col
    status = F.when((c("total") == 0) | (c("is_not_implemented") == c("total")), "not_implemented").when(c("is_succeeded") == c("total"), "complete").when(c("is_succeeded") > 0, "partial").otherwise("failed")
    counts = F.map_filter(F.map_from_arrays(F.array(*(F.lit(s) for s in STATUSES)), F.array(*(f"is_{s}" for s in STATUSES))), lambda _, v: v > 0)
    return one.select(status.alias("status"), "total", c("is_succeeded").alias("succeeded"), c("is_failed").alias("failed"), "valid_samples", "aggregate", "errors", counts.alias("status_counts"))


def scene_views(width: Column, height: Column) -> Column:
    """The four quarters of a frame as (name, left, top, right, bottom); halves of odd
    sizes go to the even pixel."""
    x, y = F.bround(width / 2.0).cast("int"), F.bround(height / 2.0).cast("int")
    zero, w, h = F.lit(0), width.cast("int"), height.cast("int")
    view = lambda n, *box: F.struct(F.lit(n).alias("name"), *(b.alias(k) for b, k in zip(box, ("left", "top", "right", "bottom"), strict=True)))
    return F.array(view("upper-left", zero, zero, x, y), view("upper-right", x, zero, w, y), view("lower-left", zero, y, x, h), view("lower-right", x, y, w, h))


def grounded_score(whole: Column, views: Column) -> Column:
    """(environment_mean, score): scores cut to [0, 1], the mean of the views' and that
    times the frame's. No views, or a score that is no finite number, fails the query."""
    finite = lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x)
    cut = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    ok = finite(whole) & (F.size(views) > 0) & F.forall(views, finite)
    mean = F.aggregate(views, F.lit(0.0), lambda s, x: s + cut(x)) / F.size(views)
    return F.when(ok, F.struct(mean.alias("environment_mean"), (cut(whole) * mean).alias("score"))).otherwise(F.raise_error(F.lit("scene evidence has to be finite, with one view or more")))
