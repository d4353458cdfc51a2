"""The corpus pipeline: quality rules, toxicity, near-duplicates, repeated passages and
packing, each over all that the stage before it kept.

Every stage takes tables with null ids and texts, empty, blank and very long texts, equal
ids, repeated rows and further columns of any names, and empty tables. A null or blank
text fails the quality rules. Copies that share an id are one document. All stages but the
last hand on every column as it is, only ``text`` and ``n_chars`` change where passages go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import minhash, packing, quality, suffixes, toxicity
from tallyframe.llm.common import fresh_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the table of rules rejects go."""
    return quality.quality_filter(docs)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.7 or more go. The model is fitted on the labelled rows
    of the whole ``documents`` table that are not held out, as in the query."""
    every = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.toxicity_filter(docs, toxicity.fit(every, labels), 0.7)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity of 0.8 or more."""
    return minhash.dedup_filter(docs, k=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 100-byte strings that start earlier in the corpus too go; rows stay."""
    return suffixes.dedup_texts(docs, 100)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All texts in as few sequences of at most 2048 tokens as best fit needs."""
    return packing.best_fit(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_documents),
    ("minhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("best-fit packing", best_fit_packing),
]

#: Neither MinHash groups nor repeated bytes can be told in SQL over whole tables; tests
#: hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = fresh_path(spark, f"stage-{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
