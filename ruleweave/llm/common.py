"""Helpers shared by the operators: table reading and lineage cuts."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of narrow rows (a few longs each) that an operator sends to every executor; beyond it the same join shuffles.
BROADCAST_ROWS = 200_000

#: The white space that separates words; a word is a maximal run of other characters.
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD_TRIM = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, named by ``spark.checkpoint.dir``; a temporary one only where that is unset."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared folder, so that later plans start from reliable files."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcasting if it has at most ``limit`` rows; a larger one is joined by shuffling."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= limit else df


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, where it is used several times inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 0 modulo 5; also for a null id, which never trains."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))
