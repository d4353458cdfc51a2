"""Sessions and first rows on a stream equal those of the table."""

import datetime as dt

from tallyframe.streaming import windows as W

ROWS = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m), u, t, 1.0) for k, (m, u, t) in enumerate([(0, 1, "a"), (5, 1, "b"), (60, 1, "a"), (61, 2, "c"), (62, 2, "a"), (300, 3, "b")])]
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def streamed(spark, tmp_path, build, name):
    spark.createDataFrame(ROWS, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/{name}-in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/{name}-in")
    q = build(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}-at").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_sessions_and_first_rows(spark, tmp_path):
    table = spark.createDataFrame(ROWS, SCHEMA)
    want = {(r.user_id, r.session_window.start, r.n) for r in W.sessions(table, "10 minutes").collect()}
    assert {(u, n) for u, _, n in want} == {(1, 2), (1, 1), (2, 2), (3, 1)}
    got = {(r.user_id, r.session_window.start, r.n) for r in streamed(spark, tmp_path, lambda s: W.sessions(s, "10 minutes", "1 minute"), "sess")}
    assert got == {x for x in want if x[0] != 3}  # the last session is still open
    first = {(r.event_type, r.event_id) for r in W.first_by_key(table, "event_type").collect()}
    assert first == {("a", 0), ("b", 1), ("c", 3)}
    rows = streamed(spark, tmp_path, lambda s: W.first_by_key(s, "event_type", "1 day"), "firsts")
    assert {(r.event_type, r.event_id) for r in rows} == first
