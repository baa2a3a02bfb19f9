"""Toxicity by cumulative-link ordinal regression.

P(severity > k) = sigmoid(w . x - t_k): one weight vector w is shared by the
ordered thresholds t_0 < t_1 < t_2.  x counts hashed words and character
n-grams (lower-cased), each capped at CAP occurrences a document.  The expected
severity is the sum of the P(severity > k).

Labels say toxic or not; the grades of toxic training documents come from how
many of the features marked by their log odds they hold, cut at terciles.
Training takes at most SAMPLE documents of each label.  Features without a
marked surplus in either label are left out and an L1 penalty, by proximal
gradient, empties most of the rest, so what goes to the executors are two arrays
of at most FEATURES entries.

Defined cases: a null or empty text has severity from the thresholds alone;
without labels of both kinds nothing is toxic; rows that repeat an id are scored
each; extra columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.llm import features as ft
from civicspark.llm import text as tx

SAMPLE, FEATURES, DEVIATIONS, CAP, GRADES = 1500, 5_000, 4.0, 4, 4

Bag = tuple[int, np.ndarray, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _marked(bags: list[Bag]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets whose shares of the labels' documents differ beyond chance, and which of them mark toxic ones."""
    n = np.zeros((2, ft.BUCKETS))
    for y, bucket, _ in bags:
        n[y, bucket] += 1
    docs = np.array([sum(1 for b in bags if b[0] == y) for y in (0, 1)], float)
    all_ = n.sum(0) / docs.sum()
    surplus = (n[1] / docs[1] - n[0] / docs[0]) / np.sqrt(np.maximum(all_ * (1 - all_), 1e-12) * (1 / docs).sum())
    names = np.argsort(-np.abs(surplus), kind="stable")[:FEATURES]
    names = np.sort(names[np.abs(surplus[names]) >= DEVIATIONS])
    return names, (surplus[names] > 0) & (n[1, names] / docs[1] > 10 * n[0, names] / docs[0])


def train(bags: list[Bag], rounds: int = 400, penalty: float = 5e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, their weights, thresholds)."""
    if len({y for y, *_ in bags}) < 2:
        return np.zeros(0, np.int64), np.zeros(0), np.full(GRADES - 1, 30.0)
    names, toxic = _marked(bags)
    row, col, value, marks = [], [], [], np.zeros(len(bags))
    for i, (_, bucket, n) in enumerate(bags):
        at = np.searchsorted(names, bucket)
        own = np.flatnonzero((at < len(names)) & (names[np.minimum(at, len(names) - 1)] == bucket))
        row.append(np.full(len(own), i))
        col.append(at[own])
        value.append(np.minimum(n[own], CAP))
        marks[i] = value[-1][toxic[at[own]]].sum()
    row, col, value = np.concatenate(row), np.concatenate(col), np.concatenate(value)
    y = np.array([b[0] for b in bags])
    grade = np.where(y == 1, 1 + np.searchsorted(np.quantile(marks[y == 1], [1 / 3, 2 / 3]), marks, "left"), 0)
    # balanced documents; features of one scale
    share = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    scale = np.sqrt(np.bincount(col, value**2 * share[row], len(names)))
    value = value / scale[col]
    v = np.ones(len(names))  # the largest curvature, by power iteration, sets the step
    for _ in range(30):
        v = np.bincount(col, value * (share * np.bincount(row, v[col] * value, len(bags)))[row], len(names))
        top = np.linalg.norm(v)
        v = v / max(top, 1e-9)
    step = 1 / max(top, 1e-9)
    w, cuts = np.zeros(len(names)), np.array([0.0, 1.0, 2.0])
    last, last_cuts, speed = w.copy(), cuts.copy(), 1.0
    for _ in range(rounds):  # proximal gradient with momentum
        faster = (1 + (1 + 4 * speed * speed) ** 0.5) / 2
        z, zc = w + (speed - 1) / faster * (w - last), cuts + (speed - 1) / faster * (cuts - last_cuts)
        last, last_cuts, speed = w, cuts, faster
        zc = np.maximum.accumulate(zc + np.arange(3) * 1e-3)
        score = np.bincount(row, z[col] * value, len(bags))
        above = _sigmoid(score[:, None] - zc)
        bounds = np.concatenate([np.ones((len(bags), 1)), above, np.zeros((len(bags), 1))], 1)
        at = np.arange(len(bags))
        likely = np.maximum(bounds[at, grade] - bounds[at, grade + 1], 1e-9)
        slope = np.concatenate([np.zeros((len(bags), 1)), above * (1 - above), np.zeros((len(bags), 1))], 1)
        low, high = slope[at, grade] / likely * share, slope[at, grade + 1] / likely * share
        back = high - low  # of the loss, by the score
        by_cut = np.array([low[grade == k + 1].sum() - high[grade == k].sum() for k in range(3)])
        w = z - step * np.bincount(col, value * back[row], len(names))
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        cuts = np.maximum.accumulate(zc - step * by_cut)
    used = np.flatnonzero(w)
    return names[used], w[used] / scale[used], cuts


_SCORED = pa.schema([("id", pa.int64()), ("score", pa.float64())])


def _scored(names: np.ndarray, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(ft.BUCKETS, -1, np.int64)
        place[names] = np.arange(len(names))
        for batch, data, offsets in tx.blocks(batches):
            keys = [np.zeros(0, np.int64)]
            for bucket, text in ft.features(lower(data), offsets):
                at = place[bucket]
                own = at >= 0
                keys.append(text[own] * len(names) + at[own])
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            total = np.zeros(batch.num_rows)
            if len(key):
                total = np.bincount(key // len(names), np.minimum(n, CAP) * weights[key % len(names)], batch.num_rows)
            yield tx.record(_SCORED, batch.column(0), total)

    lower = ft.lower
    return run


def severity(docs: DataFrame, labels: DataFrame, each: int = SAMPLE, id_col: str = "doc_id") -> DataFrame:
    """Per row of docs: its id, expected_severity (0 to 3), severity (the likeliest grade) and toxic (severity over 0 is likelier than not)."""
    names, weights, cuts = train(ft.sample(docs, labels, "toxic", each, fold=True, id_col=id_col))
    # training weighs both labels alike; the thresholds move to the labels' own shares
    one, zero = labels.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    cuts = cuts + (np.log(zero / one) if one and zero else 0)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), "text").mapInArrow(_scored(names, weights), "id long, score double")
    above = [1 / (1 + F.exp(F.lit(float(c)) - F.col("score"))) for c in cuts]
    chance = [1 - above[0], above[0] - above[1], above[1] - above[2], above[2]]
    best = F.greatest(*chance)
    grade = F.coalesce(*[F.when(c == best, i) for i, c in enumerate(chance)])
    return rows.select(F.col("id").alias(id_col), sum(above[1:], above[0]).alias("expected_severity"), grade.cast("int").alias("severity"), (above[0] >= 0.5).alias("toxic"))
