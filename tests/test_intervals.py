"""Overlaps against every pair, shares of hot bins, spans against a plain walk."""

import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import intervals as I


def drawn(rng, n):
    out = []
    for i in range(n):
        s = rng.choice([rng.randint(-50, 50), rng.randint(-10**6, 10**6), rng.uniform(-3, 3)])
        out.append((rng.choice(["a", "b", None]), i, float(s), float(s) + rng.choice([0, -1, 0.001, 1, 3, 8, 100, 10**6, 2.5])))
    return out


@pytest.mark.parametrize("share", [3, 50_000])
def test_overlaps_equal_every_pair(spark, share):
    rng = random.Random(share)
    left, right = drawn(rng, 250), drawn(rng, 180)
    schema = "k string, id int, start double, end double"
    got = I.overlap_join(spark.createDataFrame(left, schema).repartition(3), spark.createDataFrame(right, schema), ["k"], share=share).collect()
    want = [(a[1], b[1]) for a in left for b in right if a[0] is not None and a[0] == b[0] and a[2] < a[3] and b[2] < b[3] and a[2] < b[3] and b[2] < a[3]]
    assert sorted((r.l_id, r.r_id) for r in got) == sorted(want) and len(want) > 1000
    assert set(got[0].asDict()) == {"k", "l_id", "l_start", "l_end", "r_id", "r_start", "r_end"}


@pytest.mark.parametrize("seed", [1, 2])
def test_totals_equal_the_sums_of_every_pair(spark, seed):
    rng = random.Random(seed)
    schema = "k string, id int, start double, end double"
    left, right = (spark.createDataFrame(drawn(rng, n), schema) for n in (250, 180))
    right = right.withColumn("k", F.when(F.col("k") == "b", "c").otherwise(F.col("k"))).unionByName(right.filter("id % 3 = 0"))
    got = {r.k: (r.pairs, r.l_sum, r.r_sum, r.longest) for r in I.overlap_totals(left, right, ["k"], "id").collect()}
    listed = I.overlap_join(left, right, ["k"]).groupBy("k")
    shared = F.max(F.least("l_end", "r_end") - F.greatest("l_start", "r_start"))
    want = {r[0]: tuple(r)[1:] for r in listed.agg(F.count(F.lit(1)), F.sum("l_id"), F.sum("r_id"), shared).collect()}
    assert got == want and set(want) == {"a", "b"}


def test_totals_of_more_pairs_than_can_be_listed(spark):
    """9e10 pairs under one key: the totals' work grows with rows."""
    rows = spark.range(300_000).selectExpr("1 AS k", "id", "id % 3 AS start", "id % 3 + 10 AS end")
    one = I.overlap_totals(rows, rows, ["k"], "id").collect()
    n = 300_000
    assert [tuple(r) for r in one] == [(1, n * n, n * sum(range(n)), n * sum(range(n)), 10)]
    apart = I.overlap_totals(rows, rows.selectExpr("k", "id", "start + 12 AS start", "end + 12 AS end"), ["k"], "id")
    assert apart.count() == 0 and I.overlap_totals(rows.limit(0), rows, ["k"], "id").count() == 0


def test_one_hot_bin_and_empty_sides(spark):
    rows = spark.range(400).selectExpr("1 AS k", "id", "id % 7 AS start", "id % 7 + 5 AS end")
    one = I.overlap_join(rows, rows.filter("id < 20"), ["k"], share=10)
    assert one.count() == sum(a % 7 < b % 7 + 5 and b % 7 < a % 7 + 5 for a in range(400) for b in range(20))
    assert I.overlap_join(rows.limit(0), rows, ["k"]).count() == 0 and I.overlap_join(rows, rows.filter("end < 0"), ["k"]).count() == 0


def test_longest_first(spark):
    rng = random.Random(2)
    cases = [[(s := rng.randint(0, 30), s + rng.randint(1, 9)) for _ in range(rng.randint(0, 8))] for _ in range(80)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, spans array<struct<start:int,end:int>>")
    for r in df.select("i", I.longest_first(F.col("spans")).alias("x")).collect():
        taken = []
        for s, e in sorted(cases[r.i], key=lambda x: (x[0] - x[1], x[0])):
            if all(e <= a or s >= b for a, b in taken):
                taken.append((s, e))
        assert [(x.start, x.end) for x in r.x] == sorted(taken)
