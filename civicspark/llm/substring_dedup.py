"""Substring deduplication by level-wise doubling.

A window is `window` consecutive words of one document; a word goes when a
window that covers it also starts anywhere else.  Windows of half that length
come first, and only those that repeat are extended to twice the length:

1. Of the half-length windows inside each full window the one with the least
   hash stands for it.  Equal full windows have equal least halves, so a full
   window whose half does not repeat cannot repeat.  About one half-length
   window in nine is looked at.
2. Consecutive full windows with one least half form a run.  The words a run
   covers are compared as a whole: inside a longer shared passage the runs of
   all copies are the same, and all windows of a repeated run repeat.
3. The windows of other runs, with those of one copy of each repeated run as
   evidence, are compared one by one at full length.

Hashes at full length have 128 bits.  Counting is a partial aggregation and a
semi-join that Spark can split, so a passage in every document is no hot spot.

Defined cases: a null or empty text has no words and stays empty; texts shorter
than a window stay; a document is named by its id and text, rows that repeat both
are copies and get the same result, different texts of one id are different
documents; a null id is an id; extra columns are untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.llm import text as tx
from civicspark.llm.rows import KEY, keyed
from civicspark.llm.scratch import drop, save

_RUNS = "id long, key long, half long, twice int, a long, b long, at int, n int"
_RUNS_ARROW = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("half", pa.int64()), ("twice", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("at", pa.int32()), ("n", pa.int32())])
_WINDOWS = "a long, b long, id long, key long, at int, settled boolean"
_WINDOWS_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("id", pa.int64()), ("key", pa.int64()), ("at", pa.int32()), ("settled", pa.bool_())])


def _spans(words: tx.Words, starts: np.ndarray, sizes: np.ndarray, which: int) -> np.ndarray:
    """Hashes of the words starts..starts + sizes."""
    n = len(words.hashes)
    up, down = tx._POWERS[which].upto(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words.hashes * up[:n], out=total[1:])
    return tx.signed(tx.mix((total[starts + sizes] - total[starts]) * down[starts] + sizes.astype(np.uint64)))


def _runs(window: int):
    half = (window + 1) // 2
    inside = window - half + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in tx.blocks(batches):
            w = tx.words(data, offsets)
            whole = w.left() >= window
            if not whole.any():
                continue
            gram = tx.grams(w.hashes, half)
            least = tx.sliding(gram, inside)
            doc = w.text_of()
            new = whole.copy()
            new[1:] &= ~whole[:-1] | (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
            at = np.flatnonzero(new)
            n = np.add.reduceat(whole.astype(np.int64), at)
            # a half-length window that stands twice in one run repeats, too
            stands = np.flatnonzero(tx.sliding(np.where(whole, least, 0)[::-1], inside, np.maximum)[::-1] == gram)
            again = np.zeros(len(gram) + 1, np.int64)
            pair = stands[:-1][gram[stands[:-1]] == gram[stands[1:]]]
            again[pair + 1] = 1
            again = np.cumsum(again)
            twice = again[np.minimum(at + n + inside - 1, len(gram))] > again[at]
            size = n + window - 1
            yield tx.record(
                _RUNS_ARROW, batch.column(0).take(pa.array(doc[at])), batch.column(1).take(pa.array(doc[at])), tx.signed(least[at]), np.where(twice, 2, 1).astype(np.int32),
                _spans(w, at, size, 1), _spans(w, at, size, 2), (at - w.first[doc[at]]).astype(np.int32), n.astype(np.int32),
            )

    return run


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + np.repeat(starts - before, sizes)


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in tx.blocks(batches):
            w = tx.words(data, offsets)
            at, of = tx.lists(batch, "at")
            n, _ = tx.lists(batch, "n")
            settled, _ = tx.lists(batch, "settled")
            doc = np.repeat(np.arange(batch.num_rows), np.diff(of))
            place = _ranges(w.first[doc] + at, n)
            row = np.repeat(doc, n)
            one, two = tx.grams(w.hashes, window, 1), tx.grams(w.hashes, window, 2)
            yield tx.record(_WINDOWS_ARROW, tx.signed(one[place]), tx.signed(two[place]), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), (place - w.first[row]).astype(np.int32), np.repeat(settled, n))

    return run


def _kept(window: int, schema: pa.Schema, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in tx.blocks(batches):
            w = tx.words(data, offsets)
            at, of = tx.lists(batch, "at")
            n, _ = tx.lists(batch, "n")
            doc = np.repeat(np.arange(batch.num_rows), np.diff(of))
            cover = np.zeros(len(w.hashes) + 1, np.int64)
            lo = w.first[doc] + at
            np.add.at(cover, lo, 1)
            np.add.at(cover, lo + n + window - 1, -1)
            stays = np.cumsum(cover[:-1]) == 0
            kept = np.concatenate([[0], np.cumsum(stays)])[w.first]
            out = []
            for i in range(batch.num_rows):
                lo, hi = w.first[i], w.first[i + 1]
                own = data[offsets[i] : offsets[i + 1]].tobytes().split()
                own = b" ".join(own if kept[i + 1] - kept[i] == hi - lo else compress(own, stays[lo:hi].tolist()))
                out.append(hashlib.sha256(own).hexdigest() if digest else own.decode())
            yield tx.record(schema, batch.column(0), w.counts, w.counts - np.diff(kept), out)

    return run


def repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Repeated windows as (id, at, n): the windows that start at words at..at + n - 1 of a document."""
    return _repeats(_named(docs, id_col, text_col), window).select("id", "at", "n")


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return keyed(rows, "id").select("id", F.col(KEY).alias("key"), "text")


def _repeats(docs: DataFrame, window: int) -> DataFrame:
    """(id, key, at, n) of repeated windows, for docs (id, key, text)."""
    runs = save(docs.mapInArrow(_runs(window), _RUNS))
    halves = runs.groupBy("half").agg(F.sum("twice").alias("k")).where("k > 1").select("half")
    left = save(runs.join(halves, "half", "left_semi").select("id", "key", "a", "b", "at", "n"))
    drop(runs)
    first = left.groupBy("a", "b").agg(F.count("*").alias("k"), F.min(F.struct("id", "key", "at")).alias("first"))
    left = left.join(first, ["a", "b"]).select(
        "id", "key", "at", "n", (F.col("k") > 1).alias("settled"), F.col("first").eqNullSafe(F.struct("id", "key", "at")).alias("evidence")
    )
    left = save(left)
    open_ = left.where("evidence or not settled").groupBy("id", "key").agg(F.collect_list(F.struct("at", "n", "settled")).alias("x"))
    open_ = open_.select(F.col("id").alias("own"), F.col("key").alias("own_key"), F.col("x.at").alias("at"), F.col("x.n").alias("n"), F.col("x.settled").alias("settled"))
    windows = docs.join(open_, F.expr("id <=> own and key = own_key")).select("id", "key", "text", "at", "n", "settled")
    windows = save(windows.mapInArrow(_windows(window), _WINDOWS))
    equal = windows.groupBy("a", "b").agg(F.count("*").alias("k")).where("k > 1").select("a", "b")
    found = windows.where("not settled").join(equal, ["a", "b"], "left_semi").select("id", "key", "at", F.lit(1).alias("n"))
    return found.unionByName(left.where("settled").select("id", "key", "at", "n"))


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Per document: its id, n_words, n_removed and the kept words joined by spaces (`kept`, or with digest their `kept_sha256`)."""
    rows = _named(docs, id_col, text_col)
    found = _repeats(rows, window).distinct().groupBy("id", "key").agg(F.collect_list(F.struct("at", "n")).alias("x"))
    found = found.select(F.col("id").alias("own"), F.col("key").alias("own_key"), F.col("x.at").alias("at"), F.col("x.n").alias("n"))
    rows = rows.join(found, F.expr("id <=> own and key = own_key"), "left").select("id", "text", "at", "n")
    name = "kept_sha256" if digest else "kept"
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), (name, pa.string())])
    out = rows.mapInArrow(_kept(window, schema, digest), f"id long, n_words long, n_removed long, {name} string")
    return out.withColumnRenamed("id", id_col)
