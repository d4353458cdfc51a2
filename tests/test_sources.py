import pytest

from tallyframe.sources import records as R


def test_jsonl_and_csv(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "s": "x"}\n\n{"id": 2}\n')
    assert sorted(tuple(r) for r in R.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id int, s string").collect()) == [(1, "x"), (2, None)]
    (tmp_path / "a.csv").write_text("k,v\na,1.5\n")
    assert [tuple(r) for r in R.read_csv(spark, str(tmp_path / "a.csv"), "k string, v double").collect()] == [("a", 1.5)]
    (tmp_path / "b.csv").write_text("k,v\na,zz\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        R.read_csv(spark, str(tmp_path / "b.csv"), "k string, v double").collect()


def test_manifest_ids(spark):
    rows = spark.createDataFrame([("a.mp4", "p", ["dynamics_degree"]), ("b.mp4", "p", ["color"])], "video string, prompt string, dimensions array<string>")
    got = R.manifest(rows).collect()
    assert [r.dimensions for r in got if r.video == "a.mp4"] == [["dynamic_degree"]] and len({r.id for r in got}) == 2
    with pytest.raises(Exception, match="duplicate id"):
        R.manifest(rows.unionByName(rows)).collect()


def test_numbered_videos(spark):
    p = spark.createDataFrame([("d/video_010.mp4",), ("d/video_002.mp4",), ("d/x.txt",)], "path string")
    assert [r.number for r in R.numbered_videos(p).collect()] == [2, 10]
    with pytest.raises(Exception, match="unexpected file"):
        R.numbered_videos(spark.createDataFrame([("d/clip.mp4",)], "path string")).collect()
    with pytest.raises(Exception, match="duplicate key"):
        R.numbered_videos(spark.createDataFrame([("d/video_001.mp4",), ("e/video_001.mp4",)], "path string")).collect()


def test_edges_and_captions(spark):
    img = spark.createDataFrame([(1, [("dog", "under", "table"), ("dog", "beneath", "table"), ("a", "over", "a"), ("a", "eats", "b"), (None, "over", "b")])], "image_id int, relationships array<struct<subject:string,predicate:string,object:string>>")
    assert [tuple(r) for r in R.relation_edges(img).collect()] == [(1, "dog", "below", "table", 0)]
    sides = spark.createDataFrame([(1, [("a", "on the left of", "b"), ("a", "over", "c")])], "image_id int, relationships array<struct<subject:string,predicate:string,object:string>>")
    assert [r.direction for r in R.relation_edges(sides).collect()] == ["left"]
    cap = spark.createDataFrame([("[/EN#c12/people/other A man] sees [/EN#0/other it] .",)], "caption string")
    r = R.tagged_captions(cap).first()
    assert r.text == "A man sees it ." and [(m.chain, m.phrase, m.positioned) for m in r.mentions] == [("c12", "A man", True), ("0", "it", False)]
    ph = spark.createDataFrame([(1, [" The Dog. ", "!"]), (2, ["?"])], "image_id int, phrases array<string>")
    assert [tuple(r) for r in R.region_phrases(ph).collect()] == [(1, ["the dog"])]


def test_prompts_shards_and_artifacts(spark, tmp_path):
    a, b = (spark.createDataFrame([(x,) for x in xs], "prompt string") for xs in (["a  b", ""], ["a b", "c"]))
    assert sorted((r.prompt, r.source) for r in R.prompt_union(a, b).collect()) == [("a b", 0), ("c", 1)]
    scores = spark.createDataFrame([(0, 1.0), (0, 2.0), (1, 3.0)], "shard int, score double")
    good = spark.createDataFrame([(0, True, "v1", 2), (1, True, "v1", 1)], "shard int, complete boolean, protocol string, n int")
    assert R.complete_shards(scores, good, "v1").count() == 3
    with pytest.raises(Exception, match="valid receipt"):
        R.complete_shards(scores, good.filter("shard = 0"), "v1").collect()
    one = R.write_content_addressed(scores, str(tmp_path), "scores")
    assert one == R.write_content_addressed(scores.repartition(5), str(tmp_path), "scores") != R.write_content_addressed(good, str(tmp_path), "scores")
    v = spark.createDataFrame([("d/a.mp4",), ("d/b.mp4",)], "video string")
    m = spark.createDataFrame([("a.mp4", 7)], "name string, fps int")
    assert sorted((r.video, r.fps) for r in R.with_metadata(v, m).collect()) == [("d/a.mp4", 7), ("d/b.mp4", None)]
    with pytest.raises(Exception, match="duplicate key"):
        R.with_metadata(v, m.unionByName(m)).collect()


def test_sinks_write_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "succeeded", 0.5, (7, [1])), (2, "failed", None, (8, []))], "id int, status string, score double, metric struct<fps:int,frames:array<int>>")
    R.write_results(rows, f"{tmp_path}/out")
    assert R.read_csv(spark, f"{tmp_path}/out/results.csv", "id int, status string, score double, fps int").count() == 2
    assert spark.read.json(f"{tmp_path}/out/summary.json").first().asDict() == {"complete": False, "requested": 2, "succeeded": 1}
    with pytest.raises(Exception, match="already exists"):
        R.write_results(rows, f"{tmp_path}/out")
    with pytest.raises(ValueError, match="fps"):
        R.write_results(rows.withColumn("fps", rows.id), f"{tmp_path}/other")
    flat = rows.select("id", "status", "score")
    R.write_once(flat, f"{tmp_path}/once")
    R.write_once(flat.repartition(3), f"{tmp_path}/once")
    with pytest.raises(ValueError, match="other rows"):
        R.write_once(flat.filter("id = 1"), f"{tmp_path}/once")
    assert R.content_digest(flat, 1) != R.content_digest(flat.unionByName(flat), 1)
    many = spark.range(3000).selectExpr("id", "id % 7 AS v")
    assert R.content_digest(many, 1) == R.content_digest(many.repartition(5), 1) != R.content_digest(many.filter("id < 2999"), 1)
    assert R.read_jsonl_or_empty(spark, f"{tmp_path}/none", "a int").count() == 0
    flat.filter("id > 5").write.parquet(f"{tmp_path}/empty")
    with pytest.raises(Exception, match="no rows"):
        R.read_projected(spark, f"{tmp_path}/empty", ["id"]).collect()


def test_documents_of_runs_and_builds(spark, tmp_path):
    rows = spark.createDataFrame([(1, "succeeded", 0.5)], "id int, status string, score double")
    R.write_results(rows, f"{tmp_path}/out", run={"seed": 7, "metric": "colour"})
    assert spark.read.text(f"{tmp_path}/out/run.json").first().value == '{"metric": "colour", "seed": 7}'
    t = spark.createDataFrame([(i, "ab"[i % 2], "x") for i in range(20)], "sample_id int, task string, text string")
    R.write_partitioned(t.filter("sample_id < 15"), t.filter("sample_id >= 15"), f"{tmp_path}/build", "task", {"seed": 1})
    m = spark.read.json(f"{tmp_path}/build/manifest.json").first()
    assert m.total == 20 and m.counts["candidates/a"] == 8 and m.parameters.seed == 1
    assert spark.read.json(f"{tmp_path}/build/candidates").count() == 15
