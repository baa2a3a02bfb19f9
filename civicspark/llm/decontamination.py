"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, in lower case.  Every n-gram of a test item
is a possible seed; how rare it is follows from how often its words come in all
documents.  Seeds expected by chance less than once in CHANCE passes over the
corpus are used, and of each item the SEEDS rarest in any case.  Where a seed
stands in a document, the passage around it is aligned with the item, word by
word (match 2, mismatch -1, gap -1); the score over that of a perfect copy is
the similarity.

The items are dealt with in blocks of at most BLOCK_WORDS words, a block being
sent to every executor; a larger benchmark means more passes over the corpus,
not a larger broadcast.

Defined cases: a null or empty text or item matches nothing; an item of fewer
words than a seed matches nothing; rows that repeat an id, of documents or of
items, give equal rows; a null id is an id; extra columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.llm import text as tx
from civicspark.llm.features import lower
from civicspark.llm.rows import KEY
from civicspark.llm.scratch import save

SEED, CHANCE, SEEDS, SIMILAR = 3, 8, 8, 0.5
MATCH, OTHER, GAP = 2, -1, -1
BLOCK_WORDS = 1_000_000
#: Bits of the table that says which hashes may be in a set.
FILTER_BITS = 22


class Lookup:
    """Places of 64-bit numbers in a sorted list of distinct ones, -1 for others."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.may = np.zeros(1 << FILTER_BITS, bool)
        self.may[self._cell(self.values)] = True

    @staticmethod
    def _cell(x: np.ndarray) -> np.ndarray:
        return (x >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of x that are in the list, and their places in it."""
        at = np.flatnonzero(self.may[self._cell(x)])
        if not len(self.values):
            return at[:0], at[:0]
        place = np.minimum(np.searchsorted(self.values, x[at]), len(self.values) - 1)
        own = self.values[place] == x[at]
        return at[own], place[own]


def normal_words(data: np.ndarray, offsets: np.ndarray) -> tx.Words:
    return tx.words(lower(data), offsets, tx.NOT_ALNUM)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman over word hashes: the best score, and where it begins and ends in the passage."""
    n = len(passage)
    along = np.arange(n + 1)
    h, begin = np.zeros(n + 1, np.int64), along.copy()
    best = (0, 0, 0)
    for word in item:
        step = h[:-1] + np.where(passage == word, MATCH, OTHER)
        skip = h[1:] + GAP
        now, start = np.zeros(n + 1, np.int64), along.copy()
        now[1:] = np.maximum(np.maximum(step, skip), 0)
        start[1:] = np.where(now[1:] == 0, along[1:], np.where(step >= skip, begin[:-1], begin[1:]))
        # gaps along the passage: the highest of what stands before, less its distance
        level = now - GAP * along
        top = np.maximum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == top, along, 0))
        far = top + GAP * along
        start = np.where(far > now, start[source], start)
        h, begin = np.maximum(now, far), start
        j = int(h.argmax())
        if h[j] > best[0]:
            best = (int(h[j]), int(begin[j]), j)
    return best


_COUNTS = pa.schema([("place", pa.int64()), ("n", pa.int64())])


def _counted(words: Lookup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(words.values), np.int64), 0
        for _, data, offsets in tx.blocks(batches):
            w = normal_words(data, offsets)
            total += len(w.hashes)
            n += np.bincount(words.find(w.hashes)[1], minlength=len(n))
        yield tx.record(_COUNTS, np.append(np.flatnonzero(n), -1), np.append(n[n > 0], total))

    return run


_FOUND = "id long, key long, item long, similarity double, start long, end long"
_FOUND_ARROW = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("item", pa.int64()), ("similarity", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])


def _aligned(seeds: Lookup, edges: np.ndarray, owners: np.ndarray, places: np.ndarray, items: list[np.ndarray], similar: float):
    """edges, owners, places: of each seed the items that have it, and where."""

    def passages(w: tx.Words) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first word, last word) of places to align, overlapping ones joined."""
        gram = tx.grams(w.hashes, SEED)
        at, seed = seeds.find(np.where(w.left() >= SEED, gram, np.uint64(0)))
        if not len(at):
            return
        many = edges[seed + 1] - edges[seed]
        use = np.arange(many.sum()) + np.repeat(edges[seed] - np.cumsum(many) + many, many)
        item, begin = owners[use], np.repeat(at, many) - places[use]
        text = np.searchsorted(w.first, np.repeat(at, many), "right") - 1
        order = np.lexsort((begin, item, text))
        last = None
        for k in order:
            size = len(items[item[k]])
            lo, hi = begin[k] - size // 2 - 4, begin[k] + size + size // 2 + 4
            if last and last[:2] == (text[k], item[k]) and lo <= last[3]:
                last = (*last[:3], max(last[3], hi))
            else:
                if last:
                    yield last
                last = (text[k], item[k], lo, hi)
        yield last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in tx.blocks(batches):
            w = normal_words(data, offsets)
            best: dict[tuple[int, int], tuple[float, int, int]] = {}
            for text, item, lo, hi in passages(w):
                lo, hi = max(lo, w.first[text]), min(hi, w.first[text + 1])
                score, a, b = align(items[item], w.hashes[lo:hi])
                share = score / (MATCH * len(items[item]))
                if share >= similar and share > best.get((text, item), (0,))[0]:
                    best[text, item] = (share, lo - w.first[text] + a, lo - w.first[text] + b)
            if best:
                keys = list(best)
                text, item = (np.array([k[i] for k in keys]) for i in (0, 1))
                yield tx.record(_FOUND_ARROW, batch.column(0).take(pa.array(text)), batch.column(1).take(pa.array(text)), item, *(np.array([best[k][i] for k in keys]) for i in range(3)))

    return run


def _blocks(items: DataFrame, id_col: str) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Items' ids and word hashes, in blocks of a bounded number of words; they pass the driver one partition at a time."""
    ids, hashes, n = [], [], 0
    for row in items.select(id_col, "text").toLocalIterator():
        data = np.frombuffer((row[1] or "").encode(), np.uint8)
        own = normal_words(data, np.array([0, len(data)])).hashes
        if len(own) < SEED:
            continue
        if n and n + len(own) > BLOCK_WORDS:
            yield ids, hashes
            ids, hashes, n = [], [], 0
        ids.append(row[0])
        hashes.append(own)
        n += len(own)
    if n:
        yield ids, hashes


def contaminated(docs: DataFrame, items: DataFrame, similar: float = SIMILAR, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """Documents that hold a test item: (doc_id, item_id, similarity, start, end), start and end in words."""
    return _contaminated(docs, items, similar, id_col, item_col).drop(KEY)


def clean(docs: DataFrame, items: DataFrame, similar: float = SIMILAR, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """docs without those that hold a test item; texts of one id are judged each."""
    found = _contaminated(docs, items, similar, id_col, item_col).select(F.col(id_col).alias("_civicspark_bad_id"), KEY).distinct()
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_civicspark_bad_id")) & (F.xxhash64("text") == F.col(KEY))
    return docs.join(found, same, "left_anti")


def _contaminated(docs: DataFrame, items: DataFrame, similar: float, id_col: str, item_col: str) -> DataFrame:
    """As `contaminated`, with KEY, a hash of the text."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64("text").alias("key"), "text")
    out = spark.createDataFrame([], f"`{id_col}` long, {KEY} long, `{item_col}` long, similarity double, start long, end long")
    for ids, hashes in _blocks(items, item_col):
        words = Lookup(np.concatenate(hashes))
        counts = rows.mapInArrow(_counted(words), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
        n = np.zeros(len(words.values))
        total = float(counts.n[counts.place < 0].sum())
        n[counts.place[counts.place >= 0]] = counts.n[counts.place >= 0]
        bits = -np.log2((n + 0.5) / (total + 1))
        seed, owner, place = [], [], []
        for i, own in enumerate(hashes):
            info = bits[np.searchsorted(words.values, own)]
            info = sum(info[k : len(info) - SEED + 1 + k] for k in range(SEED))
            rare = info >= np.log2(total + 1) + np.log2(CHANCE)
            rare[np.argsort(-info, kind="stable")[:SEEDS]] = True
            at = np.flatnonzero(rare)
            seed.append(tx.grams(own, SEED)[at])
            owner.append(np.full(len(at), i))
            place.append(at)
        seed, owner, place = np.concatenate(seed), np.concatenate(owner), np.concatenate(place)
        order = np.argsort(seed, kind="stable")
        lookup = Lookup(seed)
        edges = np.append(np.searchsorted(seed[order], lookup.values), len(seed))
        shared = spark.sparkContext.broadcast((lookup, edges, owner[order], place[order], hashes))

        def run(batches, shared=shared):
            yield from _aligned(*shared.value, similar)(batches)

        found = rows.mapInArrow(run, _FOUND)
        names = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "item long, name long")
        found = found.join(F.broadcast(names), "item").select(F.col("id").alias(id_col), F.col("key").alias(KEY), F.col("name").alias(item_col), "similarity", "start", "end")
        out = out.unionByName(save(found))
    return out
