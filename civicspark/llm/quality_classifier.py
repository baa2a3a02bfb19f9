"""A quality classifier of supervised subword embeddings.

A document is the mean of the learned vectors of its hashed words and character
n-grams; a softmax over two classes follows.  Vectors and weights are trained
together by stochastic gradient descent in numpy, on a bounded sample of labelled
documents (SAMPLE of each label at most).  For scoring, each bucket's vector is
multiplied by the weights once: a table of BUCKETS numbers goes to the executors,
whatever the corpus's size.

Defined cases: a null or empty text scores by the class weights' bias alone;
rows that repeat an id are scored each; without labels of both kinds everything
scores 1; extra columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.llm import features as ft
from civicspark.llm import text as tx

SAMPLE, SIZE, ROUNDS, RATE = 1200, 16, 6, 0.5


def train(bags: list[tuple[int, np.ndarray, np.ndarray]], size: int = SIZE, rounds: int = ROUNDS, rate: float = RATE) -> tuple[np.ndarray, float]:
    """(each bucket's part in the log odds of label 1, the bias)."""
    if len({y for y, *_ in bags}) < 2:
        return np.zeros(ft.BUCKETS, np.float32), 50.0
    random = np.random.Generator(np.random.PCG64(7))
    vectors = random.uniform(-1 / size, 1 / size, (ft.BUCKETS, size)).astype(np.float32)
    weights = np.zeros((2, size), np.float32)
    bias = np.zeros(2, np.float32)
    steps, done = rounds * len(bags), 0
    for _ in range(rounds):
        for k in random.permutation(len(bags)):
            y, bucket, n = bags[k]
            step = rate * (1 - done / steps)
            done += 1
            share = n / max(n.sum(), 1)
            mean = share @ vectors[bucket]
            logits = weights @ mean + bias
            chance = np.exp(logits - logits.max())
            wrong = chance / chance.sum()
            wrong[y] -= 1
            back = wrong @ weights
            weights -= step * np.outer(wrong, mean)
            bias -= 0.1 * step * wrong
            vectors[bucket] -= step * np.outer(share * len(bucket) ** 0.5, back)
    return (vectors @ (weights[1] - weights[0])).astype(np.float32), float(bias[1] - bias[0])


_SCORED = pa.schema([("id", pa.int64()), ("score", pa.float64())])


def _chances(table: np.ndarray, bias: float, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The chance of label 1 of each text of a block."""
    rows = len(offsets) - 1
    total, n = np.zeros(rows), np.zeros(rows)
    for bucket, text in ft.features(data, offsets):
        total += np.bincount(text, table[bucket], rows)
        n += np.bincount(text, minlength=rows)
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + bias, -50, 50)))


def _scored(table: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in tx.blocks(batches):
            yield tx.record(_SCORED, batch.column(0), _chances(table, bias, data, offsets))

    return run


def scores(docs: DataFrame, labels: DataFrame, each: int = SAMPLE, id_col: str = "doc_id") -> DataFrame:
    """Per row of docs: its id and the chance of label 1, learned from labels (id, quality)."""
    table, bias = train(ft.sample(docs, labels, "quality", each, fold=False, id_col=id_col))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), "text")
    return rows.mapInArrow(_scored(table, bias), "id long, score double").withColumnRenamed("id", id_col)


def _kept(table: np.ndarray, bias: float, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in tx.blocks(batches):
            yield batch.filter(pa.array(_chances(table, bias, data, offsets) >= least))

    return run


def keep_good(docs: DataFrame, labels: DataFrame, least: float, each: int = SAMPLE, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs, with all their columns, that score at least `least`."""
    table, bias = train(ft.sample(docs, labels, "quality", each, fold=False, id_col=id_col))
    return docs.mapInArrow(_kept(table, bias, least), docs.schema)
