"""Indexes that queries read: made once for a state of their table, then only searched."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from civicspark.operators import keyword_index, levels
from civicspark.session import shared_folder, small_batches


def stamp(spark: SparkSession, path: str) -> str:
    """A number for the files of a table as they are now: their names, sizes and times."""
    files = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    n, total = files.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(file_path, file_size, file_modification_time))"), F.lit(0))).first()
    return f"{n}-{total & (2**64 - 1):016x}"


def documents_index(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the keyword index of the documents, made at the first call."""
    small_batches(spark)
    source = f"{sf_dir}/documents.parquet"
    path = f"{shared_folder(spark)}/keyword-index/v{keyword_index.LAYOUT}/{stamp(spark, source)}"
    if levels.manifest(spark, path)["version"] < 0:
        docs = spark.read.parquet(source).where("doc_id is not null").select("doc_id", "text")
        keyword_index.write_batch(docs, path, 0, "doc_id", "text", ranges=max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return path
