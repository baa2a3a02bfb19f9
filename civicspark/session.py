"""Session settings the library expects."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "civicspark", **settings: str) -> SparkSession:
    """A session with adaptive plans, UTC time and a state store with timers; settings override with dots written as two underscores."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers of a session, for clusters where it is not installed."""
    folder = Path(__file__).parent
    archive = shutil.make_archive(str(Path(tempfile.mkdtemp()) / "civicspark"), "zip", folder.parent, folder.name)
    spark.sparkContext.addPyFile(archive)


def small_batches(spark: SparkSession) -> None:
    """Batches of rows for Python of 2000 and of about 8 MB, as rows may be whole texts, unless the session has numbers of its own."""
    for name, (usual, own) in {"maxRecordsPerBatch": ("10000", "2000"), "maxBytesPerBatch": ("67108864b", "8m")}.items():
        if spark.conf.get(f"spark.sql.execution.arrow.{name}") == usual:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", own)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, what a query shuffled goes when it ends, not when the driver's memory is next cleared."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's spark.checkpoint.dir, on one machine a temporary one where none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='civicspark-')}"
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    return base


_MADE: list[tuple[SparkSession, str]] = []


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder within the shared one, for what a session makes and nothing reads after it; it goes when the interpreter ends."""
    path = f"{shared_folder(spark)}/{name}/{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def kept(df: DataFrame) -> DataFrame:
    """df written to a work folder and read again: its lineage ends there, and no executor's memory holds it."""
    path = work_folder(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _MADE:
        with contextlib.suppress(Exception):  # the session may have ended
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
