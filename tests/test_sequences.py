"""Runs and differences of a stream, out of order and late, equal those of the table."""

import datetime as dt
import os
import random

import pytest

from tallyframe.streaming import sequences as Q

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"
START = dt.datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, old)


def drawn(n=240):
    rng = random.Random(4)
    out, minute = [], 0.0
    for k in range(n):
        minute += rng.choice([0, 0.5, 1, 1, 2, 30])
        out.append((k, START + dt.timedelta(minutes=minute), rng.randint(1, 3), rng.choice(["a", "a", "b", None]), rng.choice([None, float(rng.randint(0, 9))])))
    return out


def streamed(spark, tmp_path, parts, build, name):
    """Each part is a file, and so a batch."""
    folder, seen = f"{tmp_path}/{name}-in", set()
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        for f in set(os.listdir(folder)) - seen:  # files are taken by age
            os.utime(f"{folder}/{f}", (1e9 + k, 1e9 + k))
        seen = set(os.listdir(folder))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}-in")
    q = build(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}-at").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return [tuple(r) for r in spark.table(name).collect()]


def shuffled_within(rows, minutes):
    """Out of order by less than ``minutes``, cut into four parts."""
    rng = random.Random(1)
    mixed = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=rng.uniform(0, minutes)))
    size = -(-len(mixed) // 4)
    return [mixed[i : i + size] for i in range(0, len(mixed), size)]


def test_stream_equals_table(spark, tmp_path, rocks):
    rows = drawn()
    end = rows[-1][1] + dt.timedelta(days=3)
    last = [(10_000, end, 9, "z", 0.0)]  # moves the watermark past all
    parts = [*shuffled_within(rows, 40), last]
    late = [[(20_000, START, 1, "late", 99.0)]]
    table = spark.createDataFrame(rows, SCHEMA)
    runs = lambda df: Q.state_runs(df, "user_id", "ts", "event_id", "event_type", "20 minutes", "1 hour")
    want = sorted(map(tuple, runs(table).collect()), key=str)
    got = streamed(spark, tmp_path, parts + late, runs, "runs")
    assert sorted((r for r in got if r[0] != "9"), key=str) == want and len(want) > 40
    steps = lambda df: Q.differences(df, "user_id", "ts", "event_id", "value", "1 hour")
    want = sorted(map(tuple, steps(table).collect()), key=str)
    got = streamed(spark, tmp_path, parts + late, steps, "steps")
    assert sorted((r for r in got if r[0] != "9"), key=str) == want


def test_runs_of_a_table(spark):
    rows = [(0, START, 1, "a", 1.0), (1, START, 1, "a", 2.0), (2, START + dt.timedelta(minutes=5), 1, "a", 4.0), (3, START + dt.timedelta(minutes=60), 1, "a", None), (4, START + dt.timedelta(minutes=61), 1, None, 1.0), (5, START, None, "a", 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [(r.state, r.n) for r in sorted(Q.state_runs(df, "user_id", "ts", "event_id", "event_type", "10 minutes").collect(), key=lambda r: r.first_us)] == [("a", 3), ("a", 1), (None, 1)]
    assert [r.difference for r in sorted(Q.differences(df, "user_id", "ts", "event_id", "value").collect(), key=lambda r: r.order)] == [None, 1.0, 2.0, None, None]
