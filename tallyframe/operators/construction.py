"""Builders of cohorts, conditions and weak labels (survey M02-M04, M07, M09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import parsing as P
from tallyframe.functions import text as T
from tallyframe.operators import contracts as C
from tallyframe.operators import relational as R


def conditions(plan: DataFrame, gold: DataFrame, keys: DataFrame, synonyms: dict[str, str]) -> DataFrame:
    """The rows of ``plan`` (id, kind, prompt, caption) with what ``gold`` (id, evidence,
    visual) says of them where it says one thing only, and with their family: what shares a
    key in ``keys`` (id, key), directly or through others. A prompt that is an article and a
    scene with a synonym comes again with it, as a row of its own (id + ":synonym")."""
    one = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).alias(c)
    said = gold.groupBy("id").agg(one("evidence"), one("visual"))
    # A key ties its rows to the first of them: as many links as rows, however frequent it is.
    first = keys.groupBy("key").agg(F.min("id").alias("b"))
    family = R.components(keys.join(first, "key").select(F.col("id").alias("a"), "b"))
    rows = plan.join(said, "id", "left").join(family, "id", "left").withColumn("family", F.coalesce("component", "id")).drop("component")
    rows = rows.select(F.col("id").cast("string").alias("source_id"), F.coalesce("kind", F.lit("unknown")).alias("condition"), F.col("evidence").alias("expected"), F.col("visual").alias("visual_expected"), "prompt", "caption", "family")
    bare = F.regexp_replace(T.normalize_phrase(F.col("prompt")), r"^(?:a|an|the) ", "")
    other = F.try_element_at(F.create_map(*(F.lit(x) for kv in synonyms.items() for x in kv)), bare)
    again = rows.withColumn("syn", other).filter("syn is not null").withColumn("original_prompt", F.col("prompt"))
    article = F.when(F.lower(F.left("syn", F.lit(1))).isin(*"aeiou"), "an ").otherwise("a ")
    again = again.withColumns({"prompt": F.concat(article, "syn"), "condition": F.lit("synonym"), "source_id": F.concat("source_id", F.lit(":synonym"))}).drop("syn")
    return rows.withColumn("original_prompt", F.lit(None).cast("string")).unionByName(again)


def length_families(seeds: DataFrame, bucket: str, buckets: list[str]) -> DataFrame:
    """Each seed once for every bucket of lengths but its own."""
    wanted = F.filter(F.array(*(F.lit(b) for b in buckets)), lambda b: F.coalesce(b != F.col(bucket), F.lit(True)))
    return seeds.withColumn("target_bucket", F.explode(wanted))


def weak_actions(classes: DataFrame) -> DataFrame:
    """A prompt for each class (label): kept where the label begins with a word in
    -ing, else set aside with the plainer sentence."""
    good = P.gerund_label(F.col("label"))
    prompt = F.when(good, F.concat(F.lit("A person is "), "label", F.lit("."))).otherwise(F.concat(F.lit("The action is "), "label", F.lit(".")))
    return classes.withColumns({"prompt": prompt, "kept": F.coalesce(good, F.lit(False))})


def weak_relations(edges: DataFrame, key: str, per_direction: int, seed: int) -> DataFrame:
    """Up to ``per_direction`` of the ``edges`` (key, subject, direction, object) of each
    direction, drawn by the hash of their key, with their sentence."""
    return R.pick_by_hash(edges.filter(F.col("direction").isin(*P.RELATION_TEMPLATES)), ["direction"], key, per_direction, seed).withColumn("prompt", P.relation_prompt(F.col("subject"), F.col("direction"), F.col("object")))


def merged_ledgers(rows: DataFrame, builds: DataFrame, shard: str, source: str, candidate: str, per_source: int) -> DataFrame:
    """The candidates of several builds as one ledger. It fails the query if builds
    (shard, protocol, sources) differ in protocol, a source or a candidate stands in two, or
    one lacks sources or candidates."""
    every = C.require_unique(rows, [candidate])
    have = rows.groupBy(shard, source).agg(F.count(F.lit(1)).alias("n"))
    home = C.require(have.groupBy(source).agg(F.count(F.lit(1)).alias("shards"), F.min("n").alias("n")), F.col("shards") == 1, "source in several builds")
    home = C.require(home, F.col("n") == per_source, "ledger without all candidates of a source").select(source)
    of = have.groupBy(shard).agg(F.count(F.lit(1)).alias("there"))
    protocol = builds.agg(F.min("protocol").alias("lo"), F.max("protocol").alias("hi"))
    full = builds.join(of, shard, "full").crossJoin(F.broadcast(protocol))  # one row
    full = C.require(full, (F.col("there") == F.col("sources")) & (F.col("lo") == F.col("hi")), F.concat(F.lit("build incomplete or of another protocol: "), F.col(shard).cast("string")))
    return every.join(home, source, "left_semi").join(full.select(shard), shard, "left_semi")


def sampled_windows(frames: Column, rate: Column, target: int = 8, length: int = 16) -> Column:
    """The first frames of the start, middle and end window of ``length`` samples on a
    grid of exactly ``target`` frames a second, as (interval, start, middle, end). A rate that
    has no such grid, or a clip too short for three windows, fails the query."""
    interval = F.greatest(F.lit(1), F.bround(rate / target).cast("long"))
    grid = F.ceil(frames / interval)
    exact = (rate > 0) & (F.abs(rate / interval - target) <= 1e-6)
    places = F.array(F.lit(0).cast("long"), F.floor((grid - length) / 2), grid - length)
    ok = F.coalesce(exact & (grid >= length) & (F.size(F.array_distinct(places)) == 3), F.lit(False))
    at = F.when(ok, places).otherwise(F.raise_error(F.lit("no exact grid, or too short for three windows")))
    return F.struct(interval.alias("interval"), *((F.get(at, F.lit(i)) * interval).alias(n) for i, n in enumerate(("start", "middle", "end"))))


def cohort(videos: DataFrame, prompts: DataFrame, name: str, count: int) -> DataFrame:
    """``videos`` (index, frames, fps) with their ``prompts`` (index, prompt), which must
    be the numbers below ``count``, once each on either side, the prompts distinct when
    normalised and not blank; with the windows of ``sampled_windows``."""
    one = C.strict_join(prompts, videos, ["index"])
    prompt = F.btrim(F.col("prompt"), F.lit(" \t\r\n"))
    one = C.require(one.withColumn("prompt", prompt), F.col("index").between(0, count - 1) & (F.col("prompt") != ""), "number or prompt outside the cohort")
    one = C.require_unique(one.withColumn("prompt_id", T.nfkc_key("prompt")), ["prompt_id"])
    total = one.agg(F.count(F.lit(1)).alias("n"))
    one = C.require(one.crossJoin(F.broadcast(total)), F.col("n") == count, "cohort of another size").drop("n")
    return one.select(F.concat_ws(":", F.lit(name), "index").alias("source_id"), "index", "prompt", "prompt_id", "frames", "fps", (F.col("frames") / F.col("fps")).alias("seconds"), sampled_windows(F.col("frames"), F.col("fps")).alias("windows"))
