from __future__ import annotations

import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def same(spark_df, con, sql) -> None:
    """Equal columns and rows, whatever their order; floats to six places."""
    mine = spark_df.toPandas()
    cursor = con.execute(sql)
    names, theirs = [d[0] for d in cursor.description], cursor.fetchall()
    assert sorted(mine.columns) == sorted(names)

    def cell(v):
        if v is None or v != v or str(v) in ("NaT", "<NA>"):
            return "null"
        if isinstance(v, float) or type(v).__name__ in ("float64", "float32", "Decimal"):
            return f"{float(v) + 0.0:.6f}"
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return str(bool(v))
        if hasattr(v, "strftime"):
            return v.strftime("%Y-%m-%d %H:%M:%S.%f")
        try:
            return f"{float(v):.6f}" if not isinstance(v, str) else v
        except TypeError:
            return str(list(v))

    order = sorted(names)
    left = sorted([cell(v) for v in row] for row in mine[order].itertuples(index=False))
    at = [names.index(n) for n in order]
    right = sorted([cell(row[i]) for i in at] for row in theirs)
    assert len(left) == len(right)
    for x, y in zip(left, right, strict=True):
        assert x == y
