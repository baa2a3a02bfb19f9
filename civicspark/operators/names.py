"""Names anywhere in texts, for lists of names of any length: an equi-join on one n-gram of each name.

1. Each name is known by its rarest n-gram of SIZE bytes (a shorter name by itself):
   n-grams of all names are counted in SLOTS numbers, which go to the tasks that choose.
2. A set of bits, two for each chosen n-gram, of at most BITS whatever the number of
   names, goes to the tasks that read the texts; in one pass they send on the n-grams
   that may be chosen ones, each with the bytes around it as far as any name reaches.
3. These meet the names in a join on the n-gram, and the name is compared with the
   bytes around.  No name passes the driver, and no text is shuffled.

Names and texts are compared as bytes of UTF-8, which is the same as by characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, SLOTS, BITS = 8, 1 << 20, 1 << 28
#: Bytes of texts that are handled at once; a longer text is its own block.
BLOCK = 1 << 20


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """The n-gram from each byte on as a number: its bytes."""
    n = len(data) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(size if n > 0 else 0):
        out = (out << np.uint64(8)) | data[i : i + n]
    return out


def _mixed(gram: np.ndarray, size: int, turn: int) -> np.ndarray:
    x = (gram ^ np.uint64(size)) * np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[turn])
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _name_grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """By size: (size, name, place in the name, n-gram), of each name its n-grams of SIZE bytes or itself."""
    length = np.diff(offsets)
    for size in range(1, SIZE + 1):
        own = np.flatnonzero(length == size if size < SIZE else length >= size)
        if not len(own):
            continue
        many = length[own] - size + 1
        name = np.repeat(own, many)
        place = np.arange(len(name)) - np.repeat(np.cumsum(many) - many, many)
        yield size, name, place, _grams(data, size)[offsets[name] + place]


_COUNT = pa.schema([("slot", pa.int32()), ("n", pa.int64())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for size, _, _, gram in _name_grams(*_bytes(batch.column(0))):
            total += np.bincount((_mixed(gram, size, 0) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], schema=_COUNT)


_CHOSEN = pa.schema([("pattern", pa.string()), ("size", pa.int32()), ("gram", pa.int64()), ("place", pa.int32()), ("length", pa.int32())])


def _chosen(counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        for batch in batches:
            data, offsets = _bytes(batch.column(0))
            for size, name, place, gram in _name_grams(data, offsets):
                rare = table[(_mixed(gram, size, 0) % np.uint64(SLOTS)).astype(np.int64)]
                order = np.lexsort((place, rare, name))
                first = order[np.flatnonzero(np.diff(name[order], prepend=-1))]
                own = name[first]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(own)).cast(pa.string()), pa.array(np.full(len(own), size), pa.int32()), pa.array(gram[first].view(np.int64)), pa.array(place[first], pa.int32()), pa.array(np.diff(offsets)[own], pa.int32())],
                    schema=_CHOSEN,
                )

    return run


def _places(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, size = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(0).to_numpy(zero_copy_only=False)
            both = [(_mixed(gram[size == s], s, turn) % np.uint64(bits)).astype(np.int64) for s in np.unique(size) for turn in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(both) + 1)], names=["bit"])  # bitmaps count from 1

    return run


def _candidates(shared, bits: int, left: int, right: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, table = shared.value

        def may_be(gram: np.ndarray, size: int, turn: int) -> np.ndarray:
            at = _mixed(gram, size, turn) % np.uint64(bits)
            return ((table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)

        for batch in batches:
            whole, ends = _bytes(batch.column(1))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + BLOCK, "right")) - 1)
                data, offsets = whole[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
                text = np.repeat(np.arange(hi - lo), np.diff(offsets))
                for size in sizes:
                    gram = _grams(data, size)
                    if not len(gram):
                        continue
                    at = np.flatnonzero(may_be(gram, size, 0) & (text[: len(gram)] == text[size - 1 :]))
                    at = at[may_be(gram[at], size, 1)]
                    begin, end = np.maximum(at - left, offsets[text[at]]), np.minimum(at + right, offsets[text[at] + 1])
                    # what is around, equal places of a text once
                    seen = {(t, data[b:e].tobytes(), a - b): g for t, a, b, e, g in zip(text[at].tolist(), at.tolist(), begin.tolist(), end.tolist(), gram[at].view(np.int64).tolist(), strict=True)}
                    if seen:
                        rows = pa.array([lo + t for t, _, _ in seen])
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array([size] * len(seen), pa.int32()), pa.array(seen.values(), pa.int64()), pa.array([w for _, w, _ in seen], pa.binary()), pa.array([b for _, _, b in seen], pa.int32())], schema=schema)
                lo = hi

    return run


def names_in_texts(docs: DataFrame, key: str, text: Column, names: DataFrame) -> DataFrame:
    """Distinct (key, pattern) of each name (a column `pattern`, not empty) that is somewhere in a text."""
    spark = docs.sparkSession
    patterns = names.select("pattern").where("pattern <> ''").distinct()
    slots = np.zeros(SLOTS, np.int64)
    for slot, n in patterns.mapInArrow(_counted, "slot int, n long").groupBy("slot").agg(F.sum("n")).collect():  # SLOTS numbers at most
        slots[slot] = n
    counts = spark.sparkContext.broadcast(slots)
    chosen = patterns.mapInArrow(_chosen(counts), "pattern string, size int, gram long, place int, length int")
    n, left, right, sizes = chosen.agg(F.count("*"), F.max("place"), F.max(F.col("length") - F.col("place")), F.collect_set("size")).first()  # sizes: eight at most
    kind = dict(docs.dtypes)[key]
    if not n:
        return spark.createDataFrame([], f"`{key}` {kind}, pattern string")
    bits = min(BITS, 1 << max(16, (32 * n - 1).bit_length()))
    chunks = chosen.select("size", "gram").mapInArrow(_places(bits), "bit long").groupBy(F.expr("bitmap_bucket_number(bit)").alias("chunk"))
    table = np.zeros(bits // 8, np.uint8)
    for chunk, own in chunks.agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))")).collect():  # BITS bits at most
        at = (chunk - 1) * 4096
        part = np.frombuffer(own, np.uint8)[: max(0, len(table) - at)]
        table[at : at + len(part)] |= part
    shared = spark.sparkContext.broadcast((sorted(sizes), table))
    rows = docs.select(F.col(key), F.lower(text).alias("_text"))
    arrow = pa.schema([(key, _arrow(kind)), ("size", pa.int32()), ("gram", pa.int64()), ("around", pa.binary()), ("before", pa.int32())])
    found = rows.mapInArrow(_candidates(shared, bits, left, right, arrow), f"`{key}` {kind}, size int, gram long, around binary, before int")
    own = chosen.select("size", "gram", "place", "length", "pattern")
    same = F.expr("before >= place and substring(around, before - place + 1, length) = cast(pattern as binary)")
    return found.join(own, ["size", "gram"]).where(same).select(key, "pattern").distinct()


def _arrow(kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(kind))
