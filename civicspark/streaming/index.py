"""What an index must do anew, kept by a stream of catalogue changes: foreachBatch and a state of merged levels.

    rows/folder=N/bucket=K   (key, content_fp, version, batch): documents that batch N changed

A batch reads the state of its keys' buckets alone, in a bounded number of folders
whatever the number of batches (see `operators.levels`), and commits after it has
handed on what changed: a batch that runs again after a failure hands on the same
rows again, and one that is committed hands on nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.functions.text import fingerprint
from civicspark.operators import levels

BUCKETS = 64


def changed(batch: DataFrame, state: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of a batch, the last for each key, whose fingerprint differs from the state's."""
    last = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), "version").alias("r")).select("r.*")
    rows = last.withColumn("content_fp", fingerprint(text=F.col(text)))
    old = state.select(F.col(key).alias("_key"), F.col("content_fp").alias("_fp"))
    return rows.join(old, F.col(key) == F.col("_key"), "left").where(~F.col("content_fp").eqNullSafe(F.col("_fp"))).drop("_key", "_fp")


def _schema(kind: str) -> str:
    return f"key {kind}, content_fp string, version long, batch int, bucket int"


def _newest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.max_by(F.struct("content_fp", "version", "batch", "bucket"), "batch").alias("r")).select("key", "r.*")


def take_in(batch: DataFrame, number: int, path: str, key: str, text: str, on_change: Callable[[DataFrame], None] | None = None, buckets: int = BUCKETS, fan: int = levels.FAN) -> None:
    """Hand on the rows of a batch that change the state, then make them its state."""
    spark = batch.sparkSession
    state = levels.manifest(spark, path)
    if state["own"] and number <= state["own"]["batch"]:
        return
    own = state["own"] or {"key": dict(batch.dtypes)[key], "buckets": buckets}
    schema, folder = _schema(own["key"]), state["next"]
    state = levels.emptied(spark, state, lambda old: levels.write(spark.createDataFrame([], schema), path, "rows", old, "bucket"))
    bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(own["buckets"])).cast("int")
    touched = [b for (b,) in batch.select(bucket).distinct().collect()]  # as many as buckets at most
    held = _newest(levels.read(spark, path, "rows", state, schema).where(F.col("bucket").isin(touched)))
    out = changed(batch, held.select(F.col("key").alias(key), "content_fp"), key, text)
    rows = out.select(F.col(key).alias("key"), "content_fp", F.col("version").cast("long").alias("version"), F.lit(folder).alias("batch"), bucket.alias("bucket"))
    levels.write(rows.repartition("bucket").sortWithinPartitions("bucket", "key"), path, "rows", folder, "bucket")
    if on_change:
        new = levels.read(spark, path, "rows", state, schema, [folder]).select("key", F.col("version").alias("_version"))
        last = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), "version").alias("r")).select("r.*")
        on_change(last.join(new, F.col(key) == F.col("key"), "left_semi").withColumn("content_fp", fingerprint(text=F.col(text))))
    state = levels.commit(spark, path, levels.added(state, folder, {**own, "batch": number}))
    while full := levels.full_level(state, fan):
        level, numbers = full
        folder = state["next"]
        merged = _newest(levels.read(spark, path, "rows", state, schema, numbers)).select("key", "content_fp", "version", "batch", "bucket")
        levels.write(merged.repartition("bucket").sortWithinPartitions("bucket", "key"), path, "rows", folder, "bucket")
        state = levels.commit(spark, path, levels.merged(state, numbers, level, folder, state["own"]))


def index_stream(changes: DataFrame, state_path: str, key: str, text: str, checkpoint: str, on_change: Callable[[DataFrame], None] | None = None, buckets: int = BUCKETS):
    """Start the stream: each batch hands on the rows that change the state, and makes them its state."""

    def run(batch: DataFrame, number: int) -> None:
        take_in(batch, number, state_path, key, text, on_change, buckets)

    return changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def state(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, content_fp, version) as they stand."""
    found = levels.manifest(spark, path)
    rows = _newest(levels.read(spark, path, "rows", found, _schema(found["own"].get("key", "string"))))
    return rows.select(F.col("key").alias(key), "content_fp", "version")
