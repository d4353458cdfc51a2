"""Building and splitting datasets (survey F31, H07, J03, K16, M05)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.functions.text import hash_int


def merge_observations(rows: DataFrame, key: str, label: str, identity: str) -> DataFrame:
    """one row a key; its label if all agree, else null; every identity is kept."""
    g = rows.groupBy(key).agg(F.count_distinct(label).alias("labels"), F.min(label).alias("one"), F.sort_array(F.collect_set(identity)).alias("ids"))
    return g.select(key, F.when(F.col("labels") == 1, F.col("one")).alias("label"), "ids", (F.col("labels") > 1).alias("conflict"))


def top_classes(rows: DataFrame, key: str, label: str, score: str, k: int = 5) -> DataFrame:
    """The ``k`` best classes of each key, ties by label. The rank's limit applies before
    the shuffle too, so no group is held whole."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), label))
    best = rows.withColumn("tc_rank", rank).filter(F.col("tc_rank") <= k)
    order = F.sort_array(F.collect_list(F.struct("tc_rank", F.col(label).alias("l"))))  # k rows
    return best.groupBy(key).agg(F.transform(order, lambda x: x["l"]).alias("top"))


def leakage_safe(rows: DataFrame, reserved: DataFrame, key: str, group: str, seed: int, one_in: int = 5) -> DataFrame:
    """Rows with a reserved key go to ``reserved``, groups that hold one to
    ``quarantine``; the other groups to dev, one in ``one_in`` by hash, or train."""
    hit = rows.join(reserved.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    touched = hit.groupBy(group).agg(F.bool_or("_hit").alias("_group_hit"))
    side = F.when(hash_int(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string"))) % one_in == 0, "dev").otherwise("train")
    role = F.when(F.col("_hit"), "reserved").when(F.col("_group_hit"), "quarantine").otherwise(side)
    return hit.join(touched, group).withColumn("role", role).drop("_hit", "_group_hit")


def qualified_groups(rows: DataFrame, group: str, status: str, members: int) -> DataFrame:
    """A group is eligible only with its full number of members, all qualified."""
    g = rows.groupBy(group).agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col(status) == "qualified").alias("qualified"))
    return g.withColumn("eligible", (F.col("members") == members) & (F.col("qualified") == members))


def arbitrate(passes: DataFrame, item: str, order: str, answer: str) -> DataFrame:
    """The first two passes if they agree, else the third if it agrees with either,
    else rejected."""
    rank = F.row_number().over(Window.partitionBy(item).orderBy(order, answer))
    first = passes.withColumn("ar_rank", rank).filter("ar_rank <= 3")
    a = first.groupBy(item).agg(F.transform(F.sort_array(F.collect_list(F.struct("ar_rank", answer))), lambda x: x[answer]).alias("a"))  # three rows
    at = lambda i: F.get("a", F.lit(i))
    agreed = F.when(at(0) == at(1), at(0)).when((at(2) == at(0)) | (at(2) == at(1)), at(2))
    state = F.when(agreed.isNull(), "rejected").when(at(0) == at(1), "accepted").otherwise("arbitrated")
    return a.select(item, agreed.alias("answer"), state.alias("state"))
