"""What several operators of this subpackage share: tables in the shared folder,
names that clash with nothing, and the exact distributed rank."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of one Arrow batch that goes to Python. Rows of very long texts then
#: travel few at a time, so a worker's memory is bounded by this and one row.
ARROW_BATCH_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset and Spark runs on this machine alone (tests) a folder of this
    machine is made and set; on a cluster that raises ValueError.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tallyframe-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tallyframe/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def forget(spark: SparkSession) -> None:
    """Deletes all tables and files that this application has in the shared folder. For use
    once the results are stored: DataFrames of this subpackage read from there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again: cuts
    the lineage, is computed once, and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that moves both its sides and broadcasts neither. For tables that grow
    with the input: Spark judges them by the bytes of their files, of which rows in memory
    may take many times as many, and those of an ``explode`` any number."""
    return df.hint("merge")


def bounded_arrow(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session by bytes, not only by rows. The setting stays:
    it is read when a query runs, and that is after the operator has returned."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", str(2**31 - 1)).rstrip("bB") or 0) > ARROW_BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(taken: Iterable[str], name: str) -> str:
    """``name``, or ``name`` with underscores before it until no column has it."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ranked(df: DataFrame, keys: list[str], order: list[Column], spread: Column, buckets: int, rank: str) -> DataFrame:
    """Adds the exact rank (long, from 0, gapless) within ``keys``, without sorting
    a whole group in one task.

    ``spread`` deals the rows of a group to ``buckets`` buckets; a row's rank is the
    number of rows in earlier buckets of its group plus its place in its own bucket
    by ``order``. Only counts per group and bucket meet in one window.
    """
    b, n, before = (free_name(df.columns, x) for x in ("rk_bucket", "rk_n", "rk_before"))
    dealt = df.withColumn(b, F.pmod(spread, F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy(*keys, b).agg(F.count(F.lit(1)).alias(n))
    earlier = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn(before, F.coalesce(F.sum(n).over(earlier), F.lit(0))).drop(n)
    sizes = sizes.select(*(F.col(c).alias(f"{c}__r") for c in [*keys, b]), before)
    local = F.row_number().over(Window.partitionBy(*keys, b).orderBy(*order)).cast("long") - 1
    same = [dealt_col.eqNullSafe(F.col(f"{c}__r")) for c, dealt_col in ((c, F.col(c)) for c in [*keys, b])]
    on = same[0]
    for x in same[1:]:
        on = on & x
    out = dealt.withColumn(rank, local).join(sizes, on)
    return out.withColumn(rank, F.col(rank) + F.col(before)).drop(before, b, *(f"{c}__r" for c in [*keys, b]))
