"""Importance resampling of documents towards a target distribution.

Features are runs of 1 to `longest` consecutive words, hashed into buckets.  A
bucket's gain is the log ratio of its smoothed shares in the target and in the
corpus; a document's weight is the sum over its features; Gumbel noise, a hash of
the id, makes the greatest scores a sample without replacement.

Counting goes by segments: separators (white space and all else in ASCII that is
neither letter nor digit) part words, newlines are separators, so a text is cut into
its lines; equal lines of all documents become one row with their number (a task's
equal lines first), the features of each distinct line are counted once and
multiplied by it, and n-grams that reach over a line's end are counted apart, from
the documents.  Weights take one more pass over the texts with the table of gains.

Defined cases: a null or empty text has no feature and weight 0; rows that repeat an
id are scored each (among equal scores and ids any order); a null id is hashed as
the word "null"; an empty corpus or target counts 0 everywhere, so gains come from
smoothing alone.  Other columns are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civicspark.llm import text as tx
from civicspark.llm.scratch import save

#: Everything in ASCII that is neither a small letter nor a digit, once capitals are lowered.
SEPARATORS = tx.NOT_ALNUM
NEWLINE = np.zeros(256, bool)
NEWLINE[10] = True


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> 1), table >> 1)
    return table.astype(np.uint32)


_CRC = _crc_table()
_ALL = np.uint32(0xFFFFFFFF)


def _feed(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 states after the bytes data[starts[i]:ends[i]]: one byte of all words at a time, longest words first; what is over 64 bytes word by word."""
    order = np.argsort(starts - ends, kind="stable")
    state, at, size = state[order], starts[order], (ends - starts)[order]
    active, k = len(size), 0
    while k < 64 and (active := int(np.searchsorted(-size[:active], -k, "left"))):
        part = state[:active]
        state[:active] = _CRC[(part ^ data[at[:active] + k]) & 0xFF] ^ (part >> 8)
        k += 1
    for i in range(int(np.searchsorted(-size[:active], -k, "left"))):
        state[i] = np.uint32(zlib.crc32(data[at[i] + k : at[i] + size[i]], int(state[i] ^ _ALL))) ^ _ALL
    out = np.empty_like(state)
    out[order] = state
    return out


def features(data: np.ndarray, words: tx.Words, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By length n from 1: (index of the first word, bucket) of each run of n words of one text."""
    left = words.left()
    first = np.arange(len(words.hashes))
    state = _feed(np.full(len(first), _ALL), data, words.starts, words.ends)
    yield first, (state ^ _ALL) % np.uint32(buckets)
    for n in range(2, longest + 1):
        keep = left[first] >= n
        first, state = first[keep], state[keep]
        state = _CRC[(state ^ 0x20) & 0xFF] ^ (state >> 8)
        last = first + n - 1
        state = _feed(state, data, words.starts[last], words.ends[last])
        yield first, (state ^ _ALL) % np.uint32(buckets)


_LINES = pa.schema([("line", pa.binary()), ("k", pa.int64())])
_COUNTS = pa.schema([("bucket", pa.int32()), ("k", pa.int64())])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct lines of each block with their numbers; lines without a word are left out."""
    for _, data, offsets in tx.blocks(batches, size=4 * tx.BLOCK):
        data = tx.LOWER[data]
        cut = tx.words(data, offsets, NEWLINE)
        word = np.concatenate([[0], np.cumsum(~SEPARATORS[data])])
        some = np.flatnonzero(word[cut.ends] > word[cut.starts])
        if not len(some):
            continue
        inside = np.zeros(len(data) + 1, np.int8)
        inside[cut.starts[some]] += 1
        inside[cut.ends[some]] -= 1
        at = np.concatenate([[0], np.cumsum(cut.ends[some] - cut.starts[some])])
        whole = data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
        lines = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(at), pa.py_buffer(whole)])
        found = pc.value_counts(lines)
        yield tx.record(_LINES, found.field(0).cast(pa.binary()), found.field(1).cast(pa.int64()))


def _of_lines(longest: int, buckets: int):
    """Bucket counts of a task's lines (line, k), each feature counted k times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch, data, offsets in tx.blocks(batches, "line"):
            k, words = tx.column(batch, "k"), tx.words(data, offsets, SEPARATORS)
            of = words.text_of()
            for first, bucket in features(data, words, longest, buckets):
                # in parts that a double holds exactly: any count below 2**62 in two halves
                for shift in (0, 31):
                    part = (k[of[first]] >> shift) & 0x7FFFFFFF
                    if part.any():
                        total += np.bincount(bucket, part, buckets).astype(np.int64) << shift
        some = np.flatnonzero(total)
        yield tx.record(_COUNTS, some.astype(np.int32), total[some])

    return run


def _across_lines(longest: int, buckets: int):
    """Bucket counts of the n-grams of a task's texts that reach over a line's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, data, offsets in tx.blocks(batches):
            data = tx.LOWER[data]
            words = tx.words(data, offsets, SEPARATORS)
            line = np.concatenate([[0], np.cumsum(data == 10)])[words.starts]
            for n, (first, bucket) in enumerate(features(data, words, longest, buckets), 1):
                total += np.bincount(bucket[line[first + n - 1] > line[first]], minlength=buckets)
        some = np.flatnonzero(total)
        yield tx.record(_COUNTS, some.astype(np.int32), total[some])

    return run


def bucket_counts(docs: DataFrame, longest: int, buckets: int, text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    text = docs.select(F.col(text_col).alias("text"))
    lines = text.mapInArrow(_lines, "line binary, k long").groupBy("line").agg(F.sum("k").alias("k"))
    parts = lines.mapInArrow(_of_lines(longest, buckets), "bucket int, k long")
    if longest > 1:
        parts = parts.unionByName(text.mapInArrow(_across_lines(longest, buckets), "bucket int, k long"))
    out = np.zeros(buckets, np.int64)
    for b, k in parts.groupBy("bucket").agg(F.sum("k").alias("k")).collect():  # bounded: a number for each bucket
        out[b] = k
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))) of each bucket."""
    of, to = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1) * of / ((s + 1) * to))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


_WEIGHTS = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])


def _weights(table: np.ndarray, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in tx.blocks(batches):
            data = tx.LOWER[data]
            words = tx.words(data, offsets, SEPARATORS)
            n, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            of = words.text_of()
            for first, bucket in features(data, words, longest, len(table)):
                n += np.bincount(of[first], minlength=batch.num_rows)
                up = np.concatenate([[0], np.cumsum(table[bucket])])
                edges = np.searchsorted(first, words.first)
                weight += up[edges[1:]] - up[edges[:-1]]
            yield tx.record(_WEIGHTS, batch.column(0), words.counts, n, weight)

    return run


def _ranked(scored: DataFrame, percent: int) -> DataFrame:
    """scored with rank: 1, 2, 3, ... of the first floor(percent N / 100) of N `able` rows by falling score, then rising id; null for the rest.

    Rows are dealt out by range; a row's number is its number in its part and that of
    the rows in all earlier parts.  `row` tells equal rows apart, so that many of them
    are not one part.
    """
    spread = scored.repartitionByRange(F.desc("able"), F.desc("score"), F.asc_nulls_first("id"), F.asc("row"))
    dealt = save(spread.withColumn("part", F.spark_partition_id()))
    sizes = sorted((part, k, able) for part, k, able in dealt.groupBy("part").agg(F.count("*"), F.sum(F.col("able").cast("long"))).collect())  # a row a part
    wanted, at, before = sum(able for *_, able in sizes) * percent // 100, 0, []
    for part, k, _ in sizes:
        before.append((part, at))
        at += k
    offsets = dealt.sparkSession.createDataFrame(before, "part int, before long")
    order = Window.partitionBy("part").orderBy(F.desc("able"), F.desc("score"), F.asc_nulls_first("id"), "row")
    number = dealt.join(F.broadcast(offsets), "part").withColumn("number", F.col("before") + F.row_number().over(order))
    return number.withColumn("rank", F.when(F.col("number") <= wanted, F.col("number")).cast("long"))


def resample(
    docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, percent: int = 10, least: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of docs: id, n_features, weight, score, rank (from 1 among the drawn of at least `least` words, else null)."""
    table = gains(bucket_counts(docs, longest, buckets, text_col), bucket_counts(target, longest, buckets))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    weighed = rows.mapInArrow(_weights(table, longest), "id long, n_words long, n_features long, weight long")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weighed.select("id", "n_features", "weight", (F.col("weight") + noise.cast("long")).alias("score"), (F.col("n_words") >= least).alias("able"))
    # once written, rows keep their numbers, and no pass over the texts is needed to deal them out
    written = save(scored.withColumn("row", F.monotonically_increasing_id()))
    out = _ranked(written, percent).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
    return out
