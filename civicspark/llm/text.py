"""Vectorised word arithmetic over Arrow text columns.

Every operator of this subpackage that looks at words reads a column of UTF-8
text in blocks of about half a megabyte (a longer text forms a block of its own) and
works on whole blocks with numpy: no Python object is made for a word.  Equal
words get equal 64-bit hashes in every task; `grams` combines the hashes of
neighbouring words in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once.
BLOCK = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Everything in ASCII that is neither a letter nor a digit.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RANDOM = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)


class _Powers:
    """Powers of an odd number modulo 2**64, and their inverses, as far as asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, BLOCK)
            for name, x in (("up", self.base), ("down", self.inverse)):
                row = np.full(n, x, np.uint64)
                row[0] = 1
                setattr(self, name, np.cumprod(row, dtype=np.uint64))
        return self.up, self.down


_POWERS = [_Powers(b) for b in _BASES]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of a 64-bit number over all bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


@dataclass
class Words:
    """The words of the texts of a block.

    starts, ends: byte offsets in the block; hashes: one per word; first: the
    index of each text's first word, and at its end the number of all words.
    """

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """For each word the index of its text in the block."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def left(self) -> np.ndarray:
        """For each word the number of words from it to its text's end."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.hashes))


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> Words:
    """Words of the texts data[offsets[i]:offsets[i + 1]]; separators says of each byte if it parts words."""
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts, ends, hashes = [], [], []
    lo = 0
    while lo < len(data):
        hi = min(len(data), lo + BLOCK)
        while hi < len(data) and not edge[hi] and not separators[data[hi]]:
            hi += 1
        part = data[lo:hi]
        gap = separators[part]
        solid = ~gap
        before = np.empty(len(part), bool)
        before[0], before[1:] = True, gap[:-1]
        before |= edge[lo:hi]
        after = np.empty(len(part), bool)
        after[-1], after[:-1] = True, gap[1:]
        after |= edge[lo + 1 : hi + 1]
        s, e = np.flatnonzero(solid & before), np.flatnonzero(solid & after) + 1
        up, down = _POWERS[0].upto(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)))
        starts.append(s + lo)
        ends.append(e + lo)
        lo = hi
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    s = cat(starts, np.int64)
    return Words(data, s, cat(ends, np.int64), cat(hashes, np.uint64), np.searchsorted(s, offsets))


def grams(hashes: np.ndarray, k: int, which: int = 1) -> np.ndarray:
    """Hashes of k consecutive words from each word on, as many as words; the last k - 1 mean nothing."""
    n = len(hashes)
    up, down = _POWERS[which].upto(n + k + 1)
    total = np.zeros(n + k + 1, np.uint64)
    np.cumsum(hashes * up[:n], out=total[1 : n + 1])
    total[n + 1 :] = total[n]
    return mix((total[k : n + k] - total[:n]) * down[:n])


def sliding(x: np.ndarray, k: int, op=np.minimum) -> np.ndarray:
    """op over x[i : i + k] for each i; windows over the end hold what is there."""
    out, have = x.copy(), 1
    while have < k:
        step = min(have, k - have)
        out[:-step] = op(out[:-step], out[step:]) if step < len(out) else out[:-step]
        have += step
    return out


def texts(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null is an empty text."""
    column = batch.column(batch.schema.get_field_index(name))
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def blocks(batches: Iterator[pa.RecordBatch], name: str = "text", size: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows in slices whose texts hold about `size` bytes: the slice, the bytes, the offsets in them."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = texts(batch, name)
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
            yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], (offsets[lo : hi + 1] - offsets[lo]).astype(np.int64)
            lo = hi


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of numbers without nulls."""
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a column of lists of numbers; null is an empty list."""
    col = batch.column(batch.schema.get_field_index(name))
    sizes = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    return pc.list_flatten(col).to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)
