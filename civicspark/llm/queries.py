"""Queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.llm.scratch import small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civicspark.llm.substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), window=35, digest=True)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civicspark.llm.minhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from civicspark.llm.tokens import prefix_counts

    counts = prefix_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep=False, budget=512)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"), "fits")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from civicspark.llm.packing import pack, pieces

    return pack(pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048), 2048)


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civicspark.llm.secrets import digest, find_secrets

    return digest(find_secrets(table(spark, sf_dir, "documents")))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civicspark.llm.features import held_out, learnable
    from civicspark.llm.quality_classifier import scores

    scored = scores(table(spark, sf_dir, "documents"), learnable(table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civicspark.llm.toxicity import severity

    return severity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civicspark.llm.quality_rules import quality

    return quality(table(spark, sf_dir, "documents")).drop("lang", "source")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civicspark.llm.decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civicspark.llm.line_dedup import removed_lines

    return removed_lines(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civicspark.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"), components=4).withColumn("deviation", F.expr("try_cast(deviation AS long)"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civicspark.llm.resampling import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), longest=1, buckets=10_000, percent=10, least=20, seed=2024)


#: Rules of op13_url_filters.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civicspark.llm.urls import judge, labelled

    return judge(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "rule string, verdict string"), labelled(spark))


QUERIES = {
    "op9_line_dedup": op9_line_dedup,
    "op5_decontamination": op5_decontamination,
    "op3_quality_rules": op3_quality_rules,
    "op6_toxicity": op6_toxicity,
    "op7_quality_classifier": op7_quality_classifier,
    "op1_secret_scans": op1_secret_scans,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op10_token_counts": op10_token_counts,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_url_filters": op13_url_filters,
}
