"""Connected components of a table of links, by contraction on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import shuffled, written


def connected_components(links: DataFrame) -> DataFrame:
    """(id, root) for every id of ``links`` (a, b): equal roots mean connected.

    Each round every node moves to the neighbour of least hash (or stays, if its own is
    the least), links are drawn between the nodes moved to, and the rest goes on. The
    hash order makes about half the nodes vanish in any round, chains included, so the
    rounds grow with the logarithm of the longest path. A hub's links meet in a
    map-side combined minimum, not in one task.
    """
    left = written(links.select("a", "b").filter("a <> b").distinct(), "links")
    roots = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
        moved = both.groupBy("a").agg(F.least(F.min(order("b")), F.first(order("a")))["v"].alias("to"))
        moved = written(moved.withColumnRenamed("a", "id"), "moved")
        if roots is None:
            roots = moved.withColumnRenamed("to", "root")
        else:
            step = moved.select(F.col("id").alias("root"), "to")
            roots = written(roots.join(shuffled(step), "root", "left").select("id", F.coalesce("to", "root").alias("root")), "roots")
        ends = moved.select(F.col("id").alias("a"), F.col("to").alias("ta")), moved.select(F.col("id").alias("b"), F.col("to").alias("tb"))
        left = left.join(shuffled(ends[0]), "a").join(shuffled(ends[1]), "b").filter("ta <> tb")
        left = written(left.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "links")
    return roots if roots is not None else left.select(F.col("a").alias("id"), F.col("b").alias("root"))
