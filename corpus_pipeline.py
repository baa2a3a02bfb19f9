"""A training-data pipeline over `documents`: filter, deduplicate, decontaminate, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of `documents`.  Lines and test items are looked at in documents
by doc_id and text; a null id is an id, and rows that repeat both are copies.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.llm.decontamination import clean
from civicspark.llm.features import learnable
from civicspark.llm.line_dedup import remove_lines
from civicspark.llm.minhash_dedup import near_duplicates
from civicspark.llm.packing import pack, pieces
from civicspark.llm.quality_classifier import keep_good
from civicspark.llm.scratch import drop, save, sent, small_batches

WORD = r"[^\x20\x09-\x0D]"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of good quality is at least 0.3."""
    small_batches(spark)
    return keep_good(docs, learnable(spark.read.parquet(f"{sf_dir}/labels.parquet")), 0.3)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their removed lines; one that had words and has none left goes."""
    small_batches(spark)
    before = docs.withColumn("_civicspark_had_words", F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    after = remove_lines(before).where("not _civicspark_had_words or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'").drop("_civicspark_had_words")
    return after.withColumn("n_chars", F.length("text").cast("long"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each group of near-duplicates."""
    small_batches(spark)
    found = near_duplicates(docs, shingle=5, percent=80)
    gone = found.groupBy(F.col("doc_id").alias("_civicspark_gone_id")).agg(F.bool_or("kept").alias("some")).where("not some").drop("some")
    docs = docs.join(sent(save(gone)), F.col("doc_id").eqNullSafe(F.col("_civicspark_gone_id")), "left_anti")
    # rows that repeat an id are looked at alone
    again = save(docs.groupBy(F.col("doc_id").alias("_civicspark_again_id")).agg(F.count("*").alias("k")).where("k > 1").drop("k"))
    if again.isEmpty():
        return docs
    same = F.col("doc_id").eqNullSafe(F.col("_civicspark_again_id"))
    return docs.join(sent(again), same, "left_anti").unionByName(docs.join(sent(again), same, "left_semi").dropDuplicates(["doc_id", "text"]))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    small_batches(spark)
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of the documents, each with its sequence and place."""
    small_batches(spark)
    return pack(pieces(docs, public_tokenizers.path("word_bpe_49k.json"), 2048), 2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]
#: SQL cannot express the trained classifier, nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir))
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
