"""Sources and sinks over copies of the driver's tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.plans.registry import query, read
from tallyframe.sources import arrays as A
from tallyframe.sources import records as S
from tallyframe.sources.session import ensure_checkpoint_dir


def fresh(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tallyframe-io/{name}-{uuid.uuid4().hex}"


@query("SELECT p_partkey, p_brand, p_size, p_retailprice FROM part")
def csv_rows(spark, d):  # A01
    path = fresh(spark, "csv")
    read(spark, d, "part", "p_partkey", "p_brand", "p_size", "p_retailprice").write.csv(path, header=True)
    return S.read_csv(spark, path, "p_partkey long, p_brand string, p_size int, p_retailprice double")


@query("SELECT conv_id, turn, role, text FROM conversations")
def jsonl_rows(spark, d):  # A02, B02, B05: written under the digest of its rows and read back
    c = read(spark, d, "conversations", "conv_id", "turn", "role", "text")
    path = S.write_content_addressed(c, fresh(spark, "jsonl"), "turns")
    return S.read_jsonl(spark, path, c.schema).unionByName(S.read_jsonl_or_empty(spark, f"{path}-none", c.schema))


@query("""SELECT o_custkey AS id, CASE o_orderstatus WHEN 'F' THEN 'succeeded' ELSE 'failed' END AS status, o_totalprice AS score, o_orderpriority AS priority FROM orders""")
def result_rows(spark, d):  # B01: results written as JSON lines and CSV, the CSV read back
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.struct(F.col("o_orderpriority").alias("priority"), F.array("o_orderkey").alias("frames")).alias("metric"), F.col("o_totalprice").alias("score"), F.when(F.col("o_orderstatus") == "F", "succeeded").otherwise("failed").alias("status"))
    folder = fresh(spark, "results")
    S.write_results(o, folder)
    return S.read_csv(spark, f"{folder}/results.csv", "id long, status string, score double, priority string")


@query("SELECT CASE WHEN length(text) >= 40 THEN 'candidates' ELSE 'quarantine' END AS kind, lang AS task, count(*) AS n FROM documents GROUP BY 1, 2")
def build_inventory(spark, d):  # B06
    t = read(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), F.col("lang").alias("task"), "text")
    good = F.coalesce(F.length("text") >= 40, F.lit(False))
    return S.write_partitioned(t.filter(good), t.filter(~good), fresh(spark, "build"), "task")


@query("SELECT doc_id, lang FROM documents")
def projected_rows(spark, d):  # A13
    return S.read_projected(spark, f"{d}/documents.parquet", ["doc_id", "lang"])


@query("""SELECT 'clips/' || p_partkey || '.mp4' AS video, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END AS fps FROM part""")
def video_metadata(spark, d):  # A04
    p = read(spark, d, "part", "p_partkey", "p_size")
    file = F.concat(F.col("p_partkey").cast("string"), F.lit(".mp4"))
    return S.with_metadata(p.select(F.concat(F.lit("clips/"), file).alias("video")), p.filter("p_partkey % 3 <> 0").select(file.alias("name"), F.col("p_size").alias("fps"))).select("video", "fps")


@query("SELECT 'v/video_' || lpad(p_partkey::VARCHAR, 9, '0') || '.mp4' AS path, p_partkey::INT AS number FROM part")
def numbered_clips(spark, d):  # A05
    name = F.concat(F.lit("v/video_"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit(".mp4"))
    return S.numbered_videos(read(spark, d, "part", "p_partkey").select(name.alias("path")))


@query("""WITH r AS (SELECT l_orderkey AS image_id, 'c' || (l_partkey % 4) AS subject, 'c' || (l_suppkey % 4) AS object, ['left of', 'on the right of', 'above', 'over', 'beneath'][l_linenumber % 5 + 1] AS p FROM lineitem)
SELECT DISTINCT image_id, subject, CASE p WHEN 'left of' THEN 'left' WHEN 'on the right of' THEN 'right' WHEN 'above' THEN 'above' ELSE 'below' END AS direction, object FROM r WHERE subject <> object AND p <> 'over'""")
def relation_edges(spark, d):  # A09
    li = read(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    word = lambda c: F.concat(F.lit("c"), (F.col(c) % 4).cast("string"))
    predicate = F.get(F.array(*(F.lit(x) for x in ("left of", "on the right of", "above", "over", "beneath"))), (F.col("l_linenumber") % 5).cast("int"))
    images = li.groupBy(F.col("l_orderkey").alias("image_id")).agg(F.collect_list(F.struct(word("l_partkey").alias("subject"), predicate.alias("predicate"), word("l_suppkey").alias("object"))).alias("relationships"))
    return S.relation_edges(images).drop("k")


@query("""SELECT l_suppkey % 7 AS shard, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1""")
def sharded_scores(spark, d):  # A15: only shards whose receipt counts their rows
    li = read(spark, d, "lineitem", "l_suppkey", "l_quantity").select((F.col("l_suppkey") % 7).alias("shard"), "l_quantity")
    receipts = li.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).select("shard", F.lit(True).alias("complete"), F.lit("v1").alias("protocol"), "n")
    return S.complete_shards(li, receipts, "v1").groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"))


@query("SELECT p_partkey, p_name, p_size FROM part")
def json_arrays(spark, d):  # A08, A06: an array a task, in a folder metadata.json beside the videos
    path = fresh(spark, "array")
    p = read(spark, d, "part", "p_partkey", "p_name", "p_size")
    A.write_json_arrays(p.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey"), f"{path}/metadata.json")
    return A.read_json_elements(spark, S.find_metadata(spark, path), p.schema).select("p_partkey", "p_name", "p_size")


@query("""WITH l AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS k FROM part)
SELECT k AS element, p_partkey, 'a "' || p_partkey || '", [' || repeat(p_partkey || ',', (p_partkey % 5)::INT) || '\\' AS note FROM l""")
def one_array(spark, d):  # A08, H11: all parts as one array in one file, its order kept
    path = fresh(spark, "one")
    note = F.concat(F.lit('a "'), F.col("p_partkey"), F.lit('", ['), F.expr("repeat(concat(p_partkey, ','), int(p_partkey % 5))"), F.lit("\\"))
    ordered = read(spark, d, "part", "p_partkey").select("p_partkey", note.alias("note")).orderBy("p_partkey").coalesce(1)  # one file is written by one task
    A.write_json_arrays(ordered, path)
    return A.read_json_elements(spark, path, "p_partkey long, note string").drop("file")


@query("""WITH j AS (SELECT o_custkey AS item, o_orderkey AS seq, o_totalprice AS spent FROM orders) SELECT item, max(seq) AS seq, round(max_by(spent, seq), 2) AS spent FROM j GROUP BY 1""")
def journal_entries(spark, d):  # B03: three appends, then the last entry of each item
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("item"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("spent"))
    path = fresh(spark, "journal")
    for k in range(3):
        S.append_journal(o.filter(F.col("seq") % 3 == k), path)
    return S.latest_entries(S.read_jsonl(spark, path, o.schema), "item", "seq").select("item", "seq", F.round("spent", 2).alias("spent"))


@query("""WITH r AS (SELECT o_orderpriority AS priority, count(*) AS n, '[' || min(o_orderkey) || ',' || max(o_orderkey) || ']' AS ends FROM orders GROUP BY 1)
SELECT 'csv' AS form, priority, n, ends FROM r UNION ALL SELECT 'md', priority, n, ends FROM r""")
def report_files(spark, d):  # B07: read back from the CSV and from the Markdown
    o = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"), F.array(F.min("o_orderkey"), F.max("o_orderkey")).alias("ends"))
    folder = fresh(spark, "report")
    S.write_report(o, folder, ["priority"])
    csv = S.read_csv(spark, f"{folder}/report.csv", "priority string, n long, ends string")
    cell = lambda i: F.trim(F.get(F.split("value", r" \| "), F.lit(i)))
    md = spark.read.text(f"{folder}/report.md").filter("value not like '| priority%' and value not like '| ---%'")
    md = md.select(F.ltrim(cell(0), F.lit("| ")).alias("priority"), cell(1).cast("long").alias("n"), F.rtrim(cell(2), F.lit(" |")).alias("ends"))
    return csv.select(F.lit("csv").alias("form"), "*").unionByName(md.select(F.lit("md").alias("form"), "*"))
