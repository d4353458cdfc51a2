"""Readers and writers of records (survey A01-A15, B02, B05)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tallyframe.functions.text import normalize_phrase, normalize_space
from tallyframe.operators.contracts import require_unique

#: Names of dimensions that mean the same. Fixed values.
DIMENSION_ALIASES = {"dynamics_degree": "dynamic_degree", "objects": "multiple_objects", "action": "human_action", "spatial": "spatial_relationship"}
#: Directions of relation predicates. Fixed values.
DIRECTIONS = {"left of": "left", "to the left of": "left", "on the left of": "left", "right of": "right", "to the right of": "right", "on the right of": "right", "above": "above", "below": "below", "under": "below", "underneath": "below", "beneath": "below"}


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A header row and the given types; a row that does not fit fails the read."""
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST")


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object a line; blank lines are skipped."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_jsonl_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Like ``read_jsonl``, but a file that is not there has no rows."""
    return read_jsonl(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_projected(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Only these columns of a Parquet table; a table without rows fails the query."""
    rows = spark.read.parquet(path).select(*columns)
    n = rows.agg(F.count(F.lit(1)).alias("n")).select(F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(F.lit(f"no rows in {path}"))).alias("_n"))
    return rows.join(F.broadcast(n), F.col("_n") > 0).drop("_n")  # one row


def manifest(rows: DataFrame) -> DataFrame:
    """(video, prompt, dimensions) rows with canonical dimensions and a derived id.
    An id that stands twice fails the query."""
    alias = F.create_map(*(F.lit(x) for kv in DIMENSION_ALIASES.items() for x in kv))
    dims = F.transform("dimensions", lambda d: F.coalesce(alias[d], d))
    out = rows.withColumn("dimensions", dims)
    out = out.withColumn("id", F.left(F.sha2(F.to_json(F.array(F.col("video"), F.col("prompt"), F.array_join("dimensions", ","))), 256), F.lit(24)))
    n = F.count(F.lit(1)).over(Window.partitionBy("id"))
    return out.withColumn("_n", n).withColumn("id", F.when(F.col("_n") == 1, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("duplicate id "), F.col("id"))))).drop("_n")


def with_metadata(videos: DataFrame, metadata: DataFrame) -> DataFrame:
    """Metadata joined by file name; videos without any stay, a name that has metadata
    twice fails the query."""
    name = F.element_at(F.split("video", "/"), -1)
    metadata = require_unique(metadata, ["name"])
    return videos.withColumn("_name", name).join(metadata.withColumnRenamed("name", "_name"), "_name", "left").drop("_name")


def numbered_videos(paths: DataFrame) -> DataFrame:
    """``video_NNN.mp4`` only, in order of the number; any other mp4, or a number that
    stands twice, fails the query."""
    base = F.element_at(F.split("path", "/"), -1)
    number = F.regexp_extract(base, r"^video_(\d{3,})\.mp4$", 1)
    strict = F.when(number != "", number.cast("int")).otherwise(F.raise_error(F.concat(F.lit("unexpected file "), base)))
    numbered = paths.filter(F.lower(base).endswith(".mp4")).withColumn("number", strict)
    return require_unique(numbered, ["number"]).orderBy("number", base)


def relation_edges(images: DataFrame) -> DataFrame:
    """Relationships (image_id, relationships) as edges with a direction; unknown
    predicates, missing names and self loops go, repeated edges count once."""
    direction = F.create_map(*(F.lit(x) for kv in DIRECTIONS.items() for x in kv))
    e = images.select("image_id", F.posexplode("relationships").alias("k", "r"))
    e = e.select("image_id", "k", F.col("r.subject").alias("subject"), direction[normalize_phrase(F.col("r.predicate"))].alias("direction"), F.col("r.object").alias("object"))
    e = e.filter("subject is not null and object is not null and direction is not null and subject <> object")
    return e.groupBy("image_id", "subject", "direction", "object").agg(F.min("k").alias("k"))


def region_phrases(images: DataFrame) -> DataFrame:
    """A10: normalised non-empty phrases of each image; images with none go."""
    phrases = F.filter(F.transform("phrases", normalize_phrase), lambda x: x != "")
    return images.select("image_id", phrases.alias("phrases")).filter(F.size("phrases") > 0)


def tagged_captions(rows: DataFrame) -> DataFrame:
    """``[/EN#chain/type phrase]`` captions as plain text and mentions."""
    tag = r"\[/EN#([^/\s]+)/([^\s]+) ([^\]]+)\]"
    parts = {n: F.regexp_extract_all("caption", F.lit(tag), F.lit(i)) for i, n in ((1, "chain"), (2, "kind"), (3, "phrase"))}
    mentions = F.transform(F.arrays_zip(*(c.alias(n) for n, c in parts.items())), lambda m: F.struct(m["chain"].alias("chain"), m["kind"].alias("kind"), m["phrase"].alias("phrase"), (m["chain"] != "0").alias("positioned")))
    return rows.withColumns({"text": normalize_space(F.regexp_replace("caption", tag, "$3")), "mentions": mentions})


def prompt_union(*sources: DataFrame) -> DataFrame:
    """Prompts of several sources (prompt), normalised, the first of each by source."""
    every = None
    for k, s in enumerate(sources):
        one = s.select(normalize_space(F.col("prompt")).alias("prompt"), F.lit(k).alias("source"))
        every = one if every is None else every.unionByName(one)
    return every.filter("prompt <> ''").groupBy(F.sha2("prompt", 256).alias("key")).agg(F.min(F.struct("source", "prompt")).alias("x")).select("key", "x.prompt", "x.source")


def complete_shards(scores: DataFrame, receipts: DataFrame, protocol: str) -> DataFrame:
    """Scores (shard, ...) of shards whose receipt (shard, complete, protocol, n) is
    complete, of the protocol, and counts the rows there are; any other fails the query."""
    n = scores.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))
    good = F.col("complete") & (F.col("protocol") == protocol) & (F.col("n") == F.col("rows"))
    checked = n.join(receipts, "shard", "left").select("shard", F.when(F.coalesce(good, F.lit(False)), True).otherwise(F.raise_error(F.concat(F.lit("shard without a valid receipt: "), F.col("shard").cast("string")))).alias("ok"))
    return scores.join(checked, "shard").filter("ok").drop("ok")


def expected_shards(scores: DataFrame, receipts: DataFrame, protocol: str, expected: DataFrame, key: str) -> DataFrame:
    """``complete_shards`` whose rows are, each once, the ids of ``expected``; one that is
    missing, foreign or there twice fails the query."""
    rows = complete_shards(scores, receipts, protocol)
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    both = expected.select(F.col(key), F.lit(1).alias("_in")).join(n, key, "full")
    checked = both.select(key, F.when((F.col("_n") == 1) & F.col("_in").isNotNull(), True).otherwise(F.raise_error(F.concat(F.lit("not scored exactly once: "), F.col(key).cast("string")))).alias("_ok"))
    return rows.join(checked, key).filter("_ok").drop("_ok")


def fixed_vocabulary(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    """Lines of a label, a tab and its number, as (id, label), labels in lower case
    without white space at the edges. Numbers that are not 0 to ``size`` - 1 (their own
    count, if none is given), each once, fail the query."""
    t = spark.read.text(path).filter("value <> ''")
    cut = F.length("value") - F.locate("\t", F.reverse("value")) + 1
    rows = t.select(F.expr("try_cast(substring_index(value, '\t', -1) AS int)").alias("id"), F.lower(F.trim(F.substring(F.col("value"), F.lit(1), cut - 1))).alias("label"))
    n = rows.agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("id").alias("_d"), F.min("id").alias("_a"), F.max("id").alias("_b"))
    want = F.lit(size) if size is not None else F.col("_n")
    good = (F.col("_n") == want) & (F.col("_d") == want) & (F.col("_a") == 0) & (F.col("_b") == want - 1)
    ok = n.select(F.when(F.coalesce(good, F.lit(False)), True).otherwise(F.raise_error(F.lit(f"numbers of {path} are not 0 and on, each once"))).alias("_ok"))
    return rows.join(F.broadcast(ok)).filter("_ok").drop("_ok")  # one row


def canonical_json(rows: DataFrame) -> DataFrame:
    """Each row as compact JSON with its keys in order."""
    return rows.select(F.to_json(F.struct(*(f"`{c}`" for c in sorted(rows.columns)))).alias("value"))


def content_digest(rows: DataFrame, each: int = 10_000) -> str:
    """The SHA-256 of a table, whatever its order or split: of the digests of groups of rows
    by the beginning of their own digests, about ``each`` rows a group."""
    hashes = canonical_json(rows).select(F.sha2("value", 256).alias("h"))
    digits, n = 0, rows.count()
    while n > each * 16**digits:
        digits += 1
    top = hashes.groupBy(F.left("h", F.lit(digits)).alias("g")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"))
    while digits > 3:  # levels of 4,096 groups, so that no list is long
        digits -= 3
        top = top.groupBy(F.left("g", F.lit(digits)).alias("g")).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("g", "h"))), lambda x: x["h"]), ""), 256).alias("h"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("g", "h"))), lambda x: x["h"]), "")
    return top.agg(F.sha2(F.concat(F.lit(f"{n}:"), whole), 256).alias("h")).first()["h"]


def write_content_addressed(rows: DataFrame, folder: str, kind: str) -> str:
    """Writes the rows under the SHA-256 of what they are and returns the path. Equal
    rows give the same path, and what is complete there is not written again."""
    path = f"{folder.rstrip('/')}/{kind}-{content_digest(rows)}"
    if not exists(rows.sparkSession, f"{path}/_SUCCESS"):
        canonical_json(rows).write.mode("overwrite").text(path)  # over a write that did not end
    return path


def write_once(rows: DataFrame, path: str) -> None:
    """Writes JSON lines to a fresh place. Equal rows may be written again, which does
    nothing; other rows raise ValueError."""
    if not exists(rows.sparkSession, path):
        canonical_json(rows).write.text(path)
        return
    there = rows.sparkSession.read.schema(rows.schema).json(path, mode="FAILFAST")
    if content_digest(there) != content_digest(rows):
        raise ValueError(f"{path} holds other rows")


def _document(spark: SparkSession, value: dict, path: str) -> None:
    """One JSON object in one file, keys in order."""
    spark.createDataFrame([(json.dumps(value, sort_keys=True, ensure_ascii=False),)], "value string").coalesce(1).write.text(path)


def write_results(rows: DataFrame, folder: str, first: tuple[str, ...] = ("id", "status", "score"), run: dict | None = None) -> None:
    """``rows`` with a struct ``metric`` spread into columns (a name that is there
    already raises ValueError), as results.jsonl with everything and results.csv with the
    scalars, ``first`` leading, summary.json, and what ``run`` says of the run as run.json.
    Nothing is written over."""
    out = rows
    if "metric" in rows.columns:
        inner = rows.schema["metric"].dataType.names
        if clash := sorted(set(inner) & set(rows.columns)):
            raise ValueError(f"metric has columns {clash} that rows have too")
        out = rows.select(*(c for c in rows.columns if c != "metric"), "metric.*")
    scalar = [c for c, kind in out.dtypes if not kind.startswith(("array", "map", "struct", "variant"))]
    order = [c for c in first if c in scalar] + [c for c in scalar if c not in first]
    canonical_json(out).write.text(f"{folder}/results.jsonl")
    out.select(*order).write.csv(f"{folder}/results.csv", header=True)
    n = F.count(F.lit(1))
    good = F.count_if(F.col("status") == "succeeded")
    out.agg(n.alias("requested"), good.alias("succeeded"), (n == good).alias("complete")).coalesce(1).write.json(f"{folder}/summary.json")
    if run is not None:
        _document(rows.sparkSession, run, f"{folder}/run.json")


def write_partitioned(candidates: DataFrame, quarantine: DataFrame, folder: str, task: str, parameters: dict | None = None) -> DataFrame:
    """Candidates and quarantined rows of each ``task`` in folders of their own, sorted
    within files by ``sample_id``, and the inventory (kind, task, n), which is written too; with
    ``parameters`` also a manifest of them and of all counts."""
    counts = None
    for kind, rows in (("candidates", candidates), ("quarantine", quarantine)):
        spread = F.pmod(F.xxhash64("sample_id"), F.lit(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        rows.repartition(task, spread).sortWithinPartitions(task, "sample_id").write.partitionBy(task).json(f"{folder}/{kind}")
        n = rows.groupBy(task).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), task, "n")
        counts = n if counts is None else counts.unionByName(n)
    counts.coalesce(1).write.json(f"{folder}/inventory")
    if parameters is not None:  # a row a kind and task
        found = {f"{r['kind']}/{r[task]}": r["n"] for r in counts.collect()}
        _document(candidates.sparkSession, {"parameters": parameters, "counts": found, "total": sum(found.values())}, f"{folder}/manifest.json")
    return counts


def read_json_array(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The elements of the top-level array in each file; a file cut short fails the
    query, what follows the array is not read. A file is read by one task: for small files.
    ``arrays.read_json_elements`` reads files of any size."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def find_metadata(spark: SparkSession, videos: str, explicit: str | None = None) -> str | None:
    """The path given, which must exist, else ``metadata.json`` in the folder of the
    videos, if it is there."""
    if explicit is not None:
        if not exists(spark, explicit):
            raise FileNotFoundError(explicit)
        return explicit
    beside = f"{videos.rstrip('/')}/metadata.json"
    return beside if exists(spark, beside) else None


def append_journal(rows: DataFrame, path: str) -> None:
    """Adds rows to a journal of JSON lines. Spark's commit makes either all of them or
    none visible; earlier entries are never touched."""
    canonical_json(rows).write.mode("append").text(path)


def latest_entries(journal: DataFrame, key: str, order: str) -> DataFrame:
    """The last entry of each key in a journal, by ``order``."""
    return journal.groupBy(key).agg(F.max_by(F.struct(*(F.col(c) for c in journal.columns if c != key)), order).alias("x")).select(key, "x.*")


def report_cells(report: DataFrame) -> DataFrame:
    """A report with lists, maps and structs as JSON in one cell."""
    flat = lambda c, kind: F.to_json(c).alias(c) if kind.startswith(("array", "map", "struct")) else F.col(f"`{c}`")
    return report.select(*(flat(c, kind) for c, kind in report.dtypes))


def write_report(report: DataFrame, folder: str, order: list[str]) -> None:
    """A report as report.csv and, as a table in Markdown, report.md, both in one file,
    sorted by ``order``; nothing is written over. A report has a row a group of a design."""
    cells = report_cells(report).orderBy(*order).coalesce(1)
    cells.write.csv(f"{folder}/report.csv", header=True)
    text = lambda c: F.coalesce(F.replace(F.replace(F.col(f"`{c}`").cast("string"), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")), F.lit(""))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(text(c) for c in cells.columns)), F.lit(" |"))
    head = [f"| {' | '.join(cells.columns)} |", f"| {' | '.join('---' for _ in cells.columns)} |"]
    rows = cells.select(line.alias("value"))
    top = report.sparkSession.createDataFrame([(x,) for x in head], "value string").coalesce(1)
    top.unionByName(rows).coalesce(1).write.text(f"{folder}/report.md")
