"""Hashed words and character n-grams of texts, a block at a time, and bounded training samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.llm import text as tx

#: Buckets that features are hashed into.
BUCKETS = 1 << 18
SIZES = (3, 4, 5, 6)
#: Buckets for a word that came one, two or three words before.
AGAIN = {1: 1, 2: 2, 3: 3}


def lower(data: np.ndarray) -> np.ndarray:
    """Lower case in ASCII and, in UTF-8, Latin 1."""
    out = tx.LOWER[data]
    if len(out) > 1:
        big = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][big] += 0x20
    return out


def _cuts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Parts of a block of about tx.BLOCK bytes: first text, texts, bytes, offsets; a longer text is cut at white space."""
    if len(data) <= 2 * tx.BLOCK:
        yield 0, len(offsets) - 1, data, offsets
        return
    for i in range(len(offsets) - 1):
        lo, end = int(offsets[i]), int(offsets[i + 1])
        while lo < end:
            hi = min(end, lo + tx.BLOCK)
            while hi < end and not tx.SPACE[data[hi]]:
                hi += 1
            yield i, 1, data[lo:hi], np.array([0, hi - lo])
            lo = hi


def features(data: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...] = SIZES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text) of each word, of each word that is the same as the one before (or two or three before), then of each n-gram of `sizes` bytes, by size.

    An n-gram starts at a character and lies in one word, whose edges count as a
    character.
    """
    for first, texts, part, at in _cuts(data, offsets):
        w = tx.words(part, at)
        text = first + w.text_of()
        yield (w.hashes >> np.uint64(20)).astype(np.int64) % BUCKETS, text
        for step, bucket in AGAIN.items():
            same = np.flatnonzero((w.hashes[step:] == w.hashes[:-step]) & (text[step:] == text[:-step]))
            yield np.full(len(same), bucket), text[same]
        padded = np.append(np.insert(part, at[:-1], 0x20), 0x20).astype(np.uint8)
        gap = tx.SPACE[padded]
        padded = np.where(gap, np.uint8(0x20), padded)
        text = first + np.repeat(np.arange(texts), np.diff(at) + 1)
        gaps = np.concatenate([[0], np.cumsum(gap)])
        n = len(padded)
        up, down = tx._POWERS[2].upto(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(tx._BYTE[padded] * up[:n], out=total[1:])
        begins = (padded & 0xC0) != 0x80
        for size in sizes:
            if n < size:
                continue
            i = np.flatnonzero(begins[: n - size + 1] & (gaps[size - 1 : n] - gaps[1 : n - size + 2] == 0))
            gram = tx.mix((total[i + size] - total[i]) * down[i] + np.uint64(size))
            yield (gram >> np.uint64(20)).astype(np.int64) % BUCKETS, text[np.minimum(i, len(text) - 1)]


_BAG = pa.schema([("id", pa.int64()), ("label", pa.int32()), ("buckets", pa.binary()), ("counts", pa.binary())])


def _bags(fold: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in tx.blocks(batches):
            if fold:
                data = lower(data)
            found = list(features(data, offsets))
            bucket, text = (np.concatenate([x[i] for x in found]) for i in (0, 1))
            order = np.argsort(text, kind="stable")
            bucket, text = bucket[order], text[order]
            edges = np.searchsorted(text, np.arange(batch.num_rows + 1))
            names, counts = [], []
            for i in range(batch.num_rows):
                own, n = np.unique(bucket[edges[i] : edges[i + 1]], return_counts=True)
                names.append(own.astype("<u4").tobytes())
                counts.append(np.minimum(n, 65535).astype("<u2").tobytes())
            yield tx.record(_BAG, batch.column(0), batch.column(1), names, counts)

    return run


def sample(docs: DataFrame, labels: DataFrame, label: str, each: int, fold: bool, id_col: str = "doc_id") -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(label, buckets, counts) of at most `each` labelled documents of either label, chosen by a hash of the id.

    Whole texts are counted, where they lie; only the counts come to the driver.  A
    document that is labelled both ways is not learnt from; of several texts of one
    id the one of least counts (as bytes) is taken.
    """
    labels = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).groupBy(id_col).agg(F.min(label).alias(label), F.max(label).alias("_most"))
    labels = labels.where(F.col(label) == F.col("_most")).select(id_col, label)
    chosen = [labels.where(F.col(label) == x).select(id_col, label).orderBy(F.xxhash64(id_col), id_col).limit(each) for x in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1]).select(F.col(id_col).alias("own"), F.col(label).cast("int").alias("label"))
    rows = docs.select(id_col, "text").join(F.broadcast(chosen), F.col(id_col) == F.col("own")).select(F.col(id_col).cast("long").alias("id"), "label", "text")
    bags = rows.mapInArrow(_bags(fold), "id long, label int, buckets binary, counts binary")
    bags = bags.groupBy("id").agg(F.min(F.struct("label", "buckets", "counts")).alias("b")).select("id", "b.*").toArrow().sort_by("id")  # a row an id
    return [(y, np.frombuffer(b, "<u4"), np.frombuffer(n, "<u2")) for y, b, n in zip(*(bags.column(x).to_pylist() for x in ("label", "buckets", "counts")), strict=True)]


def learnable(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The labels outside the held-out fold: rows whose crc32(id as text) modulo 5 is not 0."""
    return labels.where(~held_out(id_col))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
