"""Arrays cut at every place equal the json module's; what is no array fails."""

import json
import random

import pytest

from tallyframe.sources import arrays as A


@pytest.fixture
def blocks(spark):
    """Sets the bytes of a block for one test."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def hostile(rng, deep=3):
    text = lambda: "".join(rng.choice(['"', "\\", ",", "[", "]", "{", "}", "é", "😀", "\n", "a", " ", "\\\"", ",,"]) for _ in range(rng.randint(0, 12)))
    kind = rng.randint(0, 5 if deep else 3)
    if kind == 5:
        return {text(): hostile(rng, deep - 1) for _ in range(rng.randint(0, 3))}
    if kind == 4:
        return [hostile(rng, deep - 1) for _ in range(rng.randint(0, 3))]
    return [text(), rng.randint(-9, 9), None, 1.5][kind]


@pytest.mark.parametrize("size", [40, 333, 1 << 20])
def test_elements_equal_the_json_module(spark, tmp_path, blocks, size):
    rng = random.Random(size)
    files = {f"f{k}.json": [hostile(rng) for _ in range(rng.choice([0, 1, 2, 40]))] for k in range(6)}
    files["empty.json"], files["nested.json"], files["strings.json"] = [], [[[]], [[[1]], {}]], [",", '",', "],[", "\\"]
    for k, (name, value) in enumerate(files.items()):
        (tmp_path / name).write_text(json.dumps(value, ensure_ascii=k % 2 == 0, indent=k % 3 or None) + " \n" * (k % 2), encoding="utf-8")
    blocks(size)
    got = {}
    for r in A.array_elements(spark, str(tmp_path)).collect():
        got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.element, json.loads(r.value)))
    assert {n: [x for _, x in sorted(v, key=lambda e: e[0])] for n, v in got.items()} == {n: v for n, v in files.items() if v}
    assert all([e for e, _ in sorted(v, key=lambda e: e[0])] == list(range(len(v))) for v in got.values())


def test_one_file_is_read_by_many_tasks(spark, tmp_path, blocks):
    rows = [{"id": i, "text": f'a "{i}", [b]' * (i % 9), "tags": ["x,y", str(i)]} for i in range(6000)]
    (tmp_path / "big.json").write_text(json.dumps(rows))
    blocks(32 << 10)
    df = A.read_json_elements(spark, str(tmp_path / "big.json"), "id long, text string, tags array<string>")
    assert A._pieces(spark, str(tmp_path)).rdd.getNumPartitions() > 10
    got = sorted(df.collect(), key=lambda r: r.element)
    assert [(r.id, r.text, r.tags) for r in got] == [(r["id"], r["text"], r["tags"]) for r in rows]
    assert [r.element for r in got] == [r["id"] for r in rows]


@pytest.mark.parametrize(
    "text", [" ", "[", "[1,2", '[{"a": "x', '["a,b', "[1,2]]", "[1] 2", "[1],[2]", "[1,2],", "{}", '{"a": 1}', "1,2", "[1,,2]", "[1,]", "[,]", "[[1],[2]", "]"]
)
@pytest.mark.parametrize("size", [3, 1000])
def test_what_is_no_array_fails(spark, tmp_path, blocks, text, size):
    (tmp_path / "x.json").write_text(text)
    blocks(size)
    with pytest.raises(Exception, match="does not end|never opened|after the array|at the top|empty element"):
        A.array_elements(spark, str(tmp_path / "x.json")).collect()


def test_objects_have_to_fit(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": "x"}]')
    (tmp_path / "b.json").write_text('[{"a": 1}, 7]')
    with pytest.raises(Exception, match="MALFORMED|Malformed|FAILFAST|CANNOT_PARSE"):
        A.read_json_elements(spark, str(tmp_path / "a.json"), "a int").collect()
    with pytest.raises(Exception, match="not an object"):
        A.read_json_elements(spark, str(tmp_path / "b.json"), "a int").collect()


def test_written_arrays(spark, tmp_path):
    df = spark.range(50).selectExpr("id", "concat('a\"', id) AS s").repartition(3)
    A.write_json_arrays(df.filter("id % 2 = 0"), str(tmp_path / "out"))
    files = [p for p in (tmp_path / "out").iterdir() if p.name.startswith("part") and p.stat().st_size]
    assert sum(len(json.loads(p.read_text())) for p in files) == 25 and len(files) == 3
    assert sorted(r.id for r in A.read_json_elements(spark, str(tmp_path / "out"), "id long, s string").collect()) == list(range(0, 50, 2))
