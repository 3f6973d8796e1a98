"""What the operators share: tables, batches, checkpoints, the fold of a document."""

from __future__ import annotations

import ctypes
import sys
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows an Arrow batch holds at most; with texts of some MB a batch stays small.
BATCH_ROWS = 512
#: Bytes of text that one unit of Python work gathers before it is processed.
BLOCK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables under sf_dir, read by Spark alone (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Arrow batches of few rows and bytes, so that very long texts don't fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{2 * BLOCK_BYTES}")


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, a function for mapInArrow, that gives its memory back when its task ends: Python workers are kept for later tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def held_out(doc_id: Column) -> Column:
    """True for the fifth of documents whose labels are never learnt from; a null id is in none of the fifths."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Where that is unset, a local session (as in tests) gets a folder of this
    machine; on a cluster that would lose data, so it is an error.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder and not (context.master or "").split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut off from its lineage, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def steady(df: DataFrame) -> DataFrame:
    """df with rows that come in the same order whenever a task is run again: as it is from files, through a checkpoint after a shuffle."""
    plan = df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
    return checkpointed(df) if "Exchange" in plan or "Shuffle" in plan else df


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def labelled_sample(labels: DataFrame, column: str, bound: int | dict[int, int]) -> DataFrame:
    """(doc_id, label): at most bound labelled documents of the learning folds (of each label), in hash order.

    Null ids and labels are left out; a document labelled twice counts as 1
    only if every label says so.
    """
    rows = labels.select("doc_id", F.col(column).cast("int").alias("label")).where("doc_id is not null and label is not null")
    rows = rows.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"))
    if isinstance(bound, int):
        return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    zero, one = (rows.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in sorted(bound.items()))
    return zero.unionByName(one)
