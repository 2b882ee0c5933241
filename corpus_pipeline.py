"""The corpus pipeline: quality, boilerplate lines, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and is judged on its own input: what it reads of ``docs`` is all that its
predecessor kept. All but the last return the columns of their ``docs``, whatever these are; columns that a stage doesn't
name are carried along. Null and empty texts are documents like others, rows without an id are judged by their text
alone, repeated rows go or stay together but where a stage says otherwise, and empty tables give empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweave.llm import decontam, line_dedup, packing, parity_join, quality
from ruleweave.llm.common import checkpoint_folder, settle, small, table
from ruleweave.llm.queries import CAPACITY, END_ID, vocabulary


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; without labels of both kinds, all scores are equal."""
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their boilerplate lines dropped and n_chars, where there is one, brought up to date."""
    own = {c: f"_own_{c}" for c in docs.columns if c.lower() in ("n_lines", "n_dropped")}
    out = line_dedup.drop_boilerplate(docs.withColumnsRenamed(own))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return out.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts: of the smallest id, of several texts with that id the one with the least hash.

    A row is known by its id and its text, so rows of one id with different texts are judged each for itself. Rows without
    an id come after all others of their group. Texts without words are in no group; of rows equal in id and text, one stays.
    """
    text = F.xxhash64("text")
    key = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), text.alias("t"))
    groups = parity_join.near_duplicates(docs.select(key.alias("key"), "text"), id_col="key")
    marks = groups.groupBy("key").agg(F.max(~F.col("component_id").eqNullSafe(F.col("key"))).alias("gone"), F.count("*").alias("n"))
    marks = settle(marks.where("gone or n > 1").select(F.col("key.id").alias("_nd_id"), F.col("key.t").alias("_nd_t"), "gone"))
    match = [F.col("doc_id").eqNullSafe(F.col("_nd_id")), text == F.col("_nd_t")]
    kept = docs.join(small(marks.select("_nd_id", "_nd_t")), match, "left_anti")
    again = marks.where("not gone").select("_nd_id", "_nd_t")
    if (rows := again.count()) > 0:
        kept = kept.unionByName(docs.join(small(again, rows), match, "left_semi").dropDuplicates(["doc_id", "text"]))
    return kept.select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item leaks; null and empty texts stay, repeated rows go or stay together."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed; a null or empty text is one piece of the end token, repeated rows are pieces each."""
    return packing.pack(packing.pieces(docs, vocabulary("word_bpe_49k.json"), END_ID, CAPACITY), CAPACITY)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: The classifier, the tokenizer and the packing can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _files(spark: SparkSession, path: str):
    """The file system of ``path`` and the path, as the cluster sees them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """Apply the stages to ``documents``; each one's result is written to the shared folder and read again.

    A stage's input is removed once its result is written. Given the ``folder`` of a run that broke off, the run goes on
    behind the last stage that was written as a whole.
    """
    folder = folder or f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    whole = lambda k: (lambda fs, at: fs.exists(at))(*_files(spark, f"{folder}/{k}/_SUCCESS"))
    done = max((k for k in range(len(STAGES)) if whole(k)), default=-1)
    docs = table(spark, sf_dir, "documents") if done < 0 else spark.read.parquet(f"{folder}/{done}")
    for k, (_, stage) in list(enumerate(STAGES))[done + 1 :]:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            fs, at = _files(spark, f"{folder}/{k - 1}")
            fs.delete(at, True)
    return docs
