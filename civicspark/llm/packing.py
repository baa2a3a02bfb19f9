"""Best-fit packing of token sequences by exact-complement hashing.

How to pack depends on nothing but how many pieces there are of each length, at
most `capacity` numbers.  From them `plan` makes the sequences: it looks up
single, pair and triple lengths that fill a gap exactly and uses each such
combination as often as the counts allow; what is left goes to the fullest
sequence that has room (longest pieces first).  A step of the plan stands for any
number of equal sequences, so the plan stays as small for 10**10 pieces.

Pieces then get a rank among those of their length, in a hash bucket of the
length first so that no length is one task, and the rank finds their place in
the plan.

Defined cases: a null or empty text is the end id alone; rows that repeat an id
are packed each; a null id is packed like any other; an empty table gives no
rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civicspark.llm import text as tx
from civicspark.llm.scratch import save
from civicspark.llm.tokens import byte_letters

#: Letters of Latin 1 in lower case, then signs of ASCII but for the apostrophe: two parts for the tokenizer.
PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: Entries of a cache before it is begun anew.
CACHE = 300_000
#: Hash buckets of a length when pieces are ranked.
BUCKETS = 256

_CODERS: dict[str, ChunkIds] = {}


class ChunkIds(dict):
    """Text between white space -> its ids, as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = byte_letters()
        self.parts: dict[str, bytes] = {}

    def part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            if len(self.parts) >= CACHE:
                self.parts.clear()
            if not part.isascii():
                own = "".join([self.letters[b] for b in part.encode()])
            else:
                own = part
            ids = self.parts[part] = np.array([t.id for t in self.tokenizer.model.tokenize(own)], "<u4").tobytes()
        return ids

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        text = chunk.decode()
        if plain := PLAIN.fullmatch(text.lower()):
            ids = self.part(plain[1])
            if plain[2]:
                ids += self.part(plain[2])
        else:
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self[chunk] = ids
        return ids

    def ids(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


def coder(path: str) -> ChunkIds:
    """One for each tokenizer in a worker; it outlives the task."""
    if path not in _CODERS:
        _CODERS[path] = ChunkIds(path)
    return _CODERS[path]


def _cut(path: str, capacity: int, end_id: int, keep: bool, schema: pa.Schema):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch, data, offsets in tx.blocks(batches):
            rows, starts, lengths, sums, kept = [], [], [], [], []
            for i in range(batch.num_rows):
                ids = own.ids(data[offsets[i] : offsets[i + 1]].tobytes()) + end
                for at in range(0, len(ids) // 4, capacity):
                    piece = ids[4 * at : 4 * (at + capacity)]
                    rows.append(i)
                    starts.append(at)
                    lengths.append(len(piece) // 4)
                    sums.append(zlib.crc32(piece))
                    if keep:
                        kept.append(np.frombuffer(piece, "<u4").astype(np.int32))
            yield tx.record(schema, batch.column(0).take(pa.array(rows, pa.int64())), np.array(starts, np.int64) // capacity, starts, lengths, sums, *([kept] if keep else []))

    return run


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Token pieces of at most `capacity` ids: (id, piece, start, length, ids_crc32[, ids]).

    path: a tokenizer of `tokenizers` that drops white space between words, there on every executor.
    """
    schema = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int32()))] if keep_ids else [])])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_cut(path, capacity, end_id, keep_ids, schema), "id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)
    return out.withColumnRenamed("id", id_col)


class _Shelves:
    """Counts of pieces by length, an index of their sums, and the sequences that use them up.

    The index holds, for a sum that was asked for, the pairs of lengths that make it,
    the longest first.  Counts only fall, so a pair that is used up is passed once and
    never looked at again.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.free = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.free[length] += n
        self.patterns: list[tuple[dict[int, int], int]] = []
        self.sums: dict[int, list[int]] = {}  # shorter lengths of the pairs of a sum, the next one last

    def use(self, pattern: dict[int, int], times: int) -> None:
        for length, k in pattern.items():
            self.free[length] -= k * times
        self.patterns.append((pattern, times))

    def enough(self, *lengths: int) -> bool:
        """Whether so many pieces of these lengths are there together."""
        return all(self.free[x] >= lengths.count(x) for x in lengths)

    def pair(self, total: int, *held: int) -> tuple[int, int] | None:
        """Two lengths that sum to total and are there beside the held ones, the longest first."""
        if total not in self.sums:
            low = np.arange(1, total // 2 + 1)
            self.sums[total] = low[(self.free[low] > 0) & (self.free[total - low] > 0)][::-1].tolist()
        lows = self.sums[total]
        while lows and not self.enough(lows[-1], total - lows[-1]):
            lows.pop()
        low = next((x for x in reversed(lows) if self.enough(x, total - x, *held)), None)
        return None if low is None else (total - low, low)

    def complement(self, gap: int, *held: int) -> tuple[int, ...] | None:
        """One, two or three lengths that fill a gap exactly, beside the held ones."""
        if self.enough(gap, *held):
            return (gap,)
        if found := self.pair(gap, *held):
            return found
        for first in np.flatnonzero(self.free[: max(0, gap - 1)])[::-1].tolist():
            if self.enough(first, *held) and (found := self.pair(gap - first, first, *held)):
                return (first, *found)
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """([(length, pieces of it), ...], number of such sequences), for pieces counted by length."""
    shelves = _Shelves(counts, capacity)
    free = shelves.free
    if free[capacity]:
        shelves.use({capacity: 1}, int(free[capacity]))
    for length in range(capacity - 1, 0, -1):
        while free[length]:
            found = shelves.complement(capacity - length, length)
            if not found:
                break
            pattern: dict[int, int] = {}
            for x in (length, *found):
                pattern[x] = pattern.get(x, 0) + 1
            shelves.use(pattern, min(int(free[x]) // k for x, k in pattern.items()))
    done = [(sorted(p.items(), reverse=True), n) for p, n in shelves.patterns]
    # best fit: sequences with one gap and one pattern are a group
    open_: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    for length in range(capacity, 0, -1):
        left = int(free[length])
        while left:
            gap = min((g for g in open_ if g >= length), default=None)
            if gap is None:
                each = capacity // length
                if full := left // each:
                    open_.setdefault(capacity - each * length, []).append(([(length, each)], full))
                if rest := left % each:
                    open_.setdefault(capacity - rest * length, []).append(([(length, rest)], 1))
                break
            pattern, times = open_[gap].pop()
            each = min(gap // length, left)
            take = min(times, left // each)
            if take < times:
                open_[gap].append((pattern, times - take))
            if not open_[gap]:
                del open_[gap]
            open_.setdefault(gap - each * length, []).append(([*pattern, (length, each)], take))
            left -= take * each
    return done + [x for groups in open_.values() for x in groups]


def _places(steps: list[tuple[list[tuple[int, int]], int]]) -> np.ndarray:
    """Rows (length, first rank, pieces of it in a sequence, first sequence, offset), by length and rank."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in steps:
        offset = 0
        for length, each in pattern:
            rows.append((length, rank.get(length, 0), each, sequence, offset))
            rank[length] = rank.get(length, 0) + each * times
            offset += length * each
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _placed(places: np.ndarray, schema: pa.Schema):
    lengths, begin = np.unique(places[:, 0], return_index=True)
    end = np.append(begin[1:], len(places))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = tx.column(batch, "length"), tx.column(batch, "rank")
            row = np.zeros(len(length), np.int64)
            for x in np.unique(length):
                k = int(np.searchsorted(lengths, x))
                own = length == x
                row[own] = begin[k] + np.searchsorted(places[begin[k] : end[k], 1], rank[own], "right") - 1
            _, first, each, sequence, offset = places[row].T
            turn = rank - first
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence + turn // each), pa.array(offset + turn % each * length)], schema=schema)

    return run


def pack(parts: DataFrame, capacity: int = 2048, id_col: str = "doc_id") -> DataFrame:
    """Give every piece of `pieces` its sequence_id and offset: (id, piece, start, length, ids_crc32, sequence_id, offset)."""
    parts = save(parts.select(id_col, "piece", "start", "length", "ids_crc32"))
    parts = parts.withColumn("bucket", F.pmod(F.xxhash64(id_col, "piece"), F.lit(BUCKETS)).cast("int"))
    counts = save(parts.groupBy("length", "bucket").agg(F.count("*").alias("k")))
    by_length = {int(x.length): int(x.k) for x in counts.groupBy("length").agg(F.sum("k").alias("k")).collect()}  # at most capacity rows
    places = _places(plan(by_length, capacity))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "bucket", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "bucket").orderBy(F.col(id_col), "piece", "start")
    ranked = parts.withColumn("n", F.row_number().over(own)).join(counts, ["length", "bucket"])
    ranked = ranked.select(id_col, "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("n") - 1).alias("rank"))
    schema = pa.schema([(id_col, pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
    return ranked.mapInArrow(_placed(places, schema), f"`{id_col}` long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
