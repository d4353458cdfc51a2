"""The pipeline's decisions, and each query of the subpackage on the smallest tables."""

import os
import zlib

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from tallyframe.llm import common, entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


def test_stages_hand_on_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, DATA).toPandas(), docs.schema)
        now = {r.doc_id for r in docs.collect()}
        assert docs.columns == columns and now <= before, name
        before = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r.doc_id for r in packed} == before


def plain_packing(texts):
    """doc_id, piece, start, length, ids_crc32 of all pieces, and the fewest sequences that
    best fit, longest first, needs."""
    from test_token_operators import plain_best_fit, plain_tokenizer

    from tallyframe.llm.chunks import vocabulary_path

    t, rows, counts = plain_tokenizer(vocabulary_path("byte_bpe_50k.json")), [], {}
    for i, text in texts:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            rows.append((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            counts[b - a] = counts.get(b - a, 0) + 1
    return rows, plain_best_fit(counts, 2048)


def without_repeated_strings(rows, length=100):
    seen, out = set(), []
    for i, t in sorted(rows):
        data = t.encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - length + 1):
            s = data[k : k + length]
            gone[k : k + length] |= s in seen
            seen.add(s)
        out.append((i, bytes(np.frombuffer(data, np.uint8)[~gone]).decode("utf-8", "ignore")))
    return out


def test_run_equals_the_stages_by_brute_force(spark):
    """Quality by its SQL, toxicity by its query (a learned score), near-duplicates by
    comparing all pairs, repeats by looking at every string, packing piece by piece."""
    import duckdb
    from test_text_operators import components

    rows = corpus_pipeline.run(spark, DATA).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    good = {i for i, kept in db.sql(f"SELECT doc_id, kept FROM ({entry.SQL['op10_quality_rules']})").fetchall() if kept}
    clean = {r.doc_id for r in entry.op9_toxicity(spark, DATA).collect() if not r.predicted}
    left = [(i, docs[i]) for i in sorted(good & clean)]
    kept = [(i, docs[i]) for i, (_, c) in components(left, 5, 80).items() if i == c]
    want, sequences = plain_packing(without_repeated_strings(kept))
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(by) == sequences
    for spans in by.values():
        ends = np.cumsum([0, *(n for _, n in sorted(spans))])
        assert [o for o, _ in sorted(spans)] == ends[:-1].tolist() and ends[-1] <= 2048


def test_stages_on_odd_tables(spark, documents):
    """Nulls, blank and very long texts, equal ids, repeated rows, and columns named as the
    operators name theirs."""
    from test_text_operators import prose

    clean = " the of and to in is ".join(prose(12) for _ in range(6))
    other = " the of and to in is ".join(prose(12) for _ in range(6))
    # Long enough for many pieces, with nothing in it twice.
    long = " the of and ".join(prose(9) for _ in range(9000))
    names = dict.fromkeys("quality tx_score TX_TEXT n_spans N_BYTES kept_text sx_kept_text nd_component nd_id length offset sequence_id piece id root h".split(), 1)
    docs = documents([(1, clean), (1, clean), (2, clean), (3, None), (4, ""), (5, " \n\t"), (None, other), (6, long), (7, "short")], **names)
    columns, every = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{common.fresh_path(spark, 'odd')}"
        stage(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns, name
        every[name] = sorted((r.doc_id or 0) for r in docs.select("doc_id").collect())
        assert docs.filter("h <> 1 or TX_TEXT <> 1 or kept_text <> 1").count() == 0
    assert every["quality rules"] == [0, 1, 1, 2, 6] == every["toxicity"]
    assert every["minhash near-dedup"] == [0, 1, 1, 6] == every["suffix-array dedup"]
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    want, _ = plain_packing([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(map(str, (tuple(r)[:5] for r in rows))) == sorted(map(str, want))
    assert sum(r.doc_id == 6 for r in rows) > 10


def test_stages_on_empty_tables(spark, documents):
    docs = documents([])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, DATA).collect(), docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == 0


def test_no_table_that_grows_is_broadcast(spark, documents, monkeypatch):
    """Spark judges a table by its files. Of near copies these are small while the rows, those
    dealt to shares above all, are many: broadcast, they filled the driver's memory."""
    from test_text_operators import prose

    from tallyframe.llm import components, minhash, packing, suffixes

    plans = []

    def noted(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return common.written(df, name)

    for module in (minhash, components, suffixes):
        monkeypatch.setattr(module, "written", noted)
    text = prose(60)
    docs = documents([(i, f"copy{i} {text} end{i}" if i % 2 else prose(40)) for i in range(12)])
    for name, stage in (("near", minhash.dedup_filter), ("repeats", suffixes.dedup_texts)):
        out = stage(docs)
        plans.append((name, out._jdf.queryExecution().executedPlan().toString()))
        assert out.count() == (7 if name == "near" else 12)
    assert {"linked", "heads", "links", "runs", "near", "repeats"} <= {name for name, _ in plans}
    assert [name for name, plan in plans if "Broadcast" in plan] == []
    out = packing.best_fit(docs)
    assert out.count() == len(out.collect())
    joins = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x and "pk_place" in x]
    assert joins and not any("Broadcast" in x for x in joins)


def test_tables_in_the_shared_folder_can_be_forgotten(spark):
    made = common.written(spark.range(3), "some")
    assert made.count() == 3
    common.forget(spark)
    assert not os.path.exists(common._own_dir(spark).removeprefix("file:"))


def test_queries_are_registered():
    assert {k.split("_")[0] for k in entry.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert "pipeline" in __spark_entry__.queries()


@pytest.mark.parametrize("name", sorted(entry.SQL))
def test_sql_of_the_subpackage(spark, name):
    import duckdb

    df = entry.QUERIES[name](spark, DATA)
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    r = db.sql(entry.SQL[name])
    columns = r.columns
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(str(x[c]) for c in columns) for x in df.collect()) == sorted(tuple(map(str, x)) for x in r.fetchall())
