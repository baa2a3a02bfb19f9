"""Exact nearest vectors of many queries: blocks of queries against blocks of vectors, as matrix products.

Queries are dealt into blocks of about BLOCK by a hash of their key.  A block is the
only thing that is sent to all tasks, so what is sent does not grow with the number
of queries; each block is a pass over the vectors, whose best k of each task (not its
scores) are shuffled and written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civicspark.session import work_folder

#: Queries of a pass, about, and vectors that are multiplied with them at once.
BLOCK, ROWS = 2048, 2048


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Unit rows of a column of lists; 0 for one of another length, with a null, or of no length."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), size))
    rows = np.flatnonzero(sizes == size)
    if size and len(rows):
        flat = pc.list_flatten(column.take(pa.array(rows))).cast(pa.float64())
        out[rows] = pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False).reshape(-1, size)
    out[~np.isfinite(out).all(axis=1)] = 0
    norm = np.linalg.norm(out, axis=1)
    return out / np.where(norm, norm, 1)[:, None]


class Best:
    """The k best keys of each query so far: score down, key up."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.row, self.score, self.key = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.least = np.full(queries, -np.inf)

    def add(self, scores: np.ndarray, keys: np.ndarray) -> None:
        """scores: a row a query, a column a key; -inf is no candidate."""
        if scores.shape[1] > self.k:
            bar = np.maximum(self.least, np.partition(scores, -self.k, axis=1)[:, -self.k])
        else:
            bar = self.least
        row, column = np.nonzero((scores >= bar[:, None]) & (scores > -np.inf))
        row, score, key = np.append(self.row, row), np.append(self.score, scores[row, column]), np.append(self.key, keys[column])
        order = np.lexsort((key, -score, row))
        row = row[order]
        first = np.searchsorted(row, np.arange(len(self.least)))
        keep = np.arange(len(row)) - first[row] < self.k
        self.row, self.score, self.key = row[keep], score[order][keep], key[order][keep]
        full = np.bincount(self.row, minlength=len(self.least)) == self.k
        self.least[full] = self.score[np.searchsorted(self.row, np.flatnonzero(full), "right") - 1]


_OUT = pa.schema([("query", pa.int64()), ("key", pa.int64()), ("score", pa.float64())])


def _scored(shared, size: int, k: int, digits: int, self_too: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, matrix = shared.value
        best = Best(len(queries), k)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                part = part.filter(pc.and_(part.column(0).is_valid(), part.column(1).is_valid()))
                keys = part.column(0).to_numpy(zero_copy_only=False)
                scores = np.round(matrix @ _matrix(part.column(1), size).T, digits)
                if not self_too:
                    scores[queries[:, None] == keys] = -np.inf
                best.add(scores, keys)
        yield pa.RecordBatch.from_arrays([pa.array(queries[best.row]), pa.array(best.key), pa.array(best.score)], schema=_OUT)

    return run


def nearest_of_each(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, digits: int = 9, self_too: bool = False, block: int = BLOCK) -> DataFrame:
    """(query, key, score, rank) of the k vectors of highest cosine with each query vector; ties, after `digits` places, by key.

    queries: (key, vector), keys of whole numbers that are not repeated.  Rows
    without key or vector are left out on both sides; a vector of another length than
    a query's, or of no length, has the cosine 0.
    """
    spark = vectors.sparkSession
    folder = work_folder(spark, "nearest")
    rows = queries.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("query"), F.col(vector).cast("array<double>").alias("vector"), F.size(vector).alias("size"))
    counts = rows.groupBy("size").agg(F.count("*").alias("n")).collect()  # a row for each length of vectors
    many = F.create_map(*[x for size, n in counts or [(0, 1)] for x in (F.lit(size), F.lit(-(-n // block)))])
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("query"), many[F.col("size")]))
    dealt.write.partitionBy("size", "block").parquet(f"{folder}/queries")
    all_vectors = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    out = "query long, key long, score double"
    written = []
    for size, n in counts:
        for number in range(-(-n // block)):
            own = spark.read.schema("query long, vector array<double>, size int, block long").parquet(f"{folder}/queries").where((F.col("size") == size) & (F.col("block") == number))
            table = own.select("query", "vector").toArrow().combine_chunks()
            if not table.num_rows:
                continue
            held = table.column(1).combine_chunks()
            shared = spark.sparkContext.broadcast((table.column(0).to_numpy(), _matrix(held, size)))
            found = all_vectors.mapInArrow(_scored(shared, size, k, digits, self_too), out)
            best = Window.partitionBy("query").orderBy(F.desc("score"), "key")
            written.append(f"{folder}/hits/size={size}-block={number}")
            found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).write.mode("overwrite").parquet(written[-1])
            shared.unpersist()
    if not written:
        return spark.createDataFrame([], f"{out}, rank int")
    return spark.read.schema(f"{out}, rank int").parquet(*written)
