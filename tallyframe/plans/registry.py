"""Where the queries and their SQL are registered by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/{name}.parquet")
    return t.select(*columns) if columns else t


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt to all tasks: of tables with few bytes and much work a row, which a scan
    leaves in one task or a few."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
