"""Tables between two steps of an operator, in the folder all executors share.

`save` writes a DataFrame as Parquet and reads it again: the lineage is cut, and
a lost executor costs one task, not the steps before.  The shuffle files behind
the table are removed once it is written.  The folder is the session's
spark.checkpoint.dir; where none is set, a session within one machine (as in
tests) gets a temporary one, and a cluster's is refused.  What a result may still
read stays until the interpreter ends.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KEPT: list[tuple[SparkSession, str]] = []
#: While a table is written: shuffle files go when their query has ended (Spark 4.1); batches of texts for Python stay small.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", BATCH: "2000"}
#: Rows of a table that is sent to all tasks at most.
SENT = 200_000


def folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='civicspark-')}"
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def small_batches(spark: SparkSession) -> None:
    """Batches of texts for Python of 2000 rows, unless the session has a number of its own."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, WRITING[BATCH])


def save(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = f"{folder(spark)}/civicspark/{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    _KEPT.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def sent(table: DataFrame, lists: str | None = None) -> DataFrame:
    """A saved table to join with: sent to all tasks if it has at most SENT rows (and ten times as many entries in `lists`), else shuffled."""
    entries = F.lit(0) if lists is None else F.coalesce(F.sum(F.size(lists)), F.lit(0))
    rows, values = table.agg(F.count("*"), entries).first()
    return F.broadcast(table) if rows <= SENT and values <= 10 * SENT else table


def drop(*tables: DataFrame) -> None:
    """Delete saved tables that nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, table._scratch_path)
        _KEPT[:] = [x for x in _KEPT if x[1] != table._scratch_path]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in _KEPT:
        with contextlib.suppress(Exception):  # the session may have ended
            _delete(spark, path)
