"""Whitening of embeddings: leading principal components of quantised vectors.

Every entry c becomes the integer floor(256 c).  The fit list is each distinct
integer vector once.  Counts, sums and the centred covariance are grouped sums over
it: a task adds up its blocks by a matrix product and passes on one number for
each cell.  What reaches the driver is the covariance (its size is that of the
dimension, whatever the number of vectors); there it is made tridiagonal by
Householder reflections, its leading eigenvalues are found by bisection on Sturm
counts, their vectors by inverse iteration, orthogonal within clusters of close
eigenvalues.  The projection goes to all tasks, and a last pass over the fit list
measures how far the whitened covariance is from the identity.

Defined cases: a vector that is null, or has a null, non-finite or (times 256)
more than 64-bit entry, is dropped, and so is one whose length is not the most
frequent length (of equally frequent ones the longest).  Rows that repeat an id or
a vector are each returned; a null id stays null.  Components of no variance
(below 1e-12 of the whole) do not exist, so one distinct vector, or none, gives no
rows.  Other columns are not looked at.  A deviation is exact to 38 digits, null beyond.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.llm import text as tx
from civicspark.llm.scratch import drop, save

SCALE, NOTHING, CLUSTER = 256, 1e-12, 1e-3
#: A covariance of more dimensions than this is not sent to the driver.
DIMENSIONS = 8192


# ---- symmetric eigenproblem, at the driver: as many numbers as cells of the covariance


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, unit reflection vectors): reflecting a symmetric matrix by each in turn leaves three diagonals."""
    a, n = np.array(a, float), len(a)
    mirrors = []
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size, ahead = np.linalg.norm(v), v[0]
        v[0] += np.copysign(size, ahead)
        length = np.linalg.norm(v)
        v = v / length if length else v
        mirrors.append(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = 2 * (p - (v @ p) * v)
        rest -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = -np.copysign(size, ahead)
    return np.diag(a).copy(), np.diag(a, 1).copy(), mirrors


def above(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues are greater than each of `at`: the positive ratios of Sturm's sequence."""
    tiny = np.finfo(float).tiny * max(1.0, float(np.max(off**2, initial=0)))
    count, q = np.zeros(len(at), int), np.ones(len(at))
    for i, d in enumerate(diagonal):
        q = d - at - (off[i - 1] ** 2 / q if i else 0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q > 0
    return count


def leading(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k greatest eigenvalues, falling, each halved in until its bracket has no number between its ends."""
    around = np.abs(np.append(off, 0)) + np.abs(np.append(0, off))
    low, high = np.full(k, np.min(diagonal - around)), np.full(k, np.max(diagonal + around))
    spread = np.finfo(float).eps * max(np.max(np.abs(low)), np.max(np.abs(high)), np.finfo(float).tiny)
    low, high, wanted = low - spread, high + spread, np.arange(1, k + 1)
    while True:
        middle = low + (high - low) / 2
        if np.all((middle <= low) | (middle >= high)):
            return middle
        more = above(diagonal, off, middle) >= wanted
        low, high = np.where(more, middle, low), np.where(more, high, middle)


def _solve(diagonal: np.ndarray, off: np.ndarray, at: float, b: np.ndarray, least: float) -> np.ndarray:
    """x with (T - at) x = b, rows exchanged where the next one's pivot is larger; a vanishing pivot counts as `least`."""
    n = len(diagonal)
    main, up, top, x = diagonal - at, np.append(off, 0.0), np.zeros(n), b.copy()
    for i in range(n - 1):
        below = off[i]
        if abs(below) > abs(main[i]):
            factor = main[i] / below
            main[i], up[i], main[i + 1], top[i] = below, main[i + 1], up[i] - factor * main[i + 1], up[i + 1]
            up[i + 1] *= -factor
            x[i], x[i + 1] = x[i + 1], x[i] - factor * x[i + 1]
        else:
            pivot = main[i] if abs(main[i]) > least else np.copysign(least, main[i])
            main[i] = pivot
            factor = below / pivot
            main[i + 1] -= factor * up[i]
            x[i + 1] -= factor * x[i]
    if abs(main[-1]) < least:
        main[-1] = np.copysign(least, main[-1])
    for i in range(n - 1, -1, -1):
        x[i] -= (up[i] * x[i + 1] if i + 1 < n else 0) + (top[i] * x[i + 2] if i + 2 < n else 0)
        x[i] /= main[i]
        if abs(x[i]) > 1e100:  # only the direction counts
            x /= 1e100
    return x


def vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix as rows, by inverse iteration; those of close eigenvalues are kept orthogonal."""
    size = float(np.max(np.abs(diagonal) + np.abs(np.append(off, 0)) + np.abs(np.append(0, off))))
    least, random = np.finfo(float).eps * max(size, np.finfo(float).tiny), np.random.Generator(np.random.PCG64(11))
    found = np.zeros((len(values), len(diagonal)))
    first = 0
    for i, value in enumerate(values):
        if i and values[i - 1] - value > CLUSTER * size:
            first = i
        x = random.standard_normal(len(diagonal))
        for _ in range(6):
            x = _solve(diagonal, off, value - (i - first) * least, x / np.linalg.norm(x), least)
            x /= np.linalg.norm(x)
            for _ in range(2):
                x -= found[first:i].T @ (found[first:i] @ x)
            x /= np.linalg.norm(x)
        found[i] = x
    return found


def eigen(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as rows; the largest entry of each is positive."""
    k = min(k, len(matrix))
    scale = float(np.max(np.abs(matrix), initial=0))
    if not scale:
        return np.zeros(k), np.eye(k, len(matrix))
    diagonal, off, mirrors = tridiagonal(matrix / scale)
    values = leading(diagonal, off, k)
    found = vectors(diagonal, off, values)
    for j in range(len(mirrors) - 1, -1, -1):
        v = mirrors[j]
        found[:, j + 1 :] -= 2 * np.outer(found[:, j + 1 :] @ v, v)
    found /= np.linalg.norm(found, axis=1)[:, None]
    return values * scale, found * np.sign(found[np.arange(k), np.argmax(np.abs(found), axis=1)])[:, None]


# ---- passes over the vectors

_PACKED = pa.schema([("d", pa.int32()), ("x", pa.binary())])


def _whole(batch: pa.RecordBatch) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Rows with a usable vector, and by length the integers of those of that length (in the rows' order)."""
    col = batch.column(1)
    sizes = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(pc.list_flatten(col), np.nan).to_numpy(zero_copy_only=False) * SCALE
    edges = np.concatenate([[0], np.cumsum(sizes)])
    fine = np.concatenate([[0], np.cumsum(~((flat >= -(2.0**63)) & (flat < 2.0**63)))])
    good = np.flatnonzero(col.is_valid().to_numpy(zero_copy_only=False) & (fine[edges[1:]] == fine[edges[:-1]]))
    return good, {int(d): np.floor(flat[edges[rows := good[sizes[good] == d]][:, None] + np.arange(d)]).astype(np.int64) for d in np.unique(sizes[good])} if len(good) else {}


def _pack(x: np.ndarray) -> list[bytes]:
    """Each row as bytes: the width of its widest entry, then its entries at that width."""
    most = np.maximum(x, ~x).max(axis=1, initial=0)
    width = np.select([most < 1 << 7, most < 1 << 15, most < 1 << 31], [1, 2, 4], 8)
    out: list[bytes] = [b""] * len(x)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        table = np.ascontiguousarray(x[rows].astype(f"<i{w}")).view(np.uint8).reshape(len(rows), -1)
        whole = np.concatenate([np.full((len(rows), 1), w, np.uint8), table], axis=1).tobytes()
        step = table.shape[1] + 1
        for i, row in enumerate(rows):
            out[row] = whole[i * step : (i + 1) * step]
    return out


def _unpack(column: pa.Array, d: int) -> np.ndarray:
    """The rows of _pack as integers."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column)]
    data = np.frombuffer(data, np.uint8)
    out = np.empty((len(column), d), np.int64)
    width = data[at]
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        out[rows] = np.ascontiguousarray(data[(at[rows] + 1)[:, None] + np.arange(d * int(w))]).view(f"<i{w}")
    return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in _whole(batch)[1].values():
            yield tx.record(_PACKED, np.full(len(x), x.shape[1], np.int32), _pack(x))


def _cells(d: int, each: Callable[[np.ndarray], np.ndarray], kind: str):
    """A task's sum of each(block of vectors), cell by cell."""
    schema = pa.schema([("cell", pa.int32()), ("value", pa.int64() if kind == "long" else pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = each(_unpack(batch.column(0).slice(lo, 4096), d)).ravel()
                total = part if total is None else total + part
        if total is not None:
            yield tx.record(schema, np.arange(len(total), dtype=np.int32), total)

    return run


def _sum(fit: DataFrame, d: int, each: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> list:
    """each(vectors) summed over the fit list: as many numbers as it has cells."""
    value = F.col("value").cast("decimal(20,0)") if kind == "long" else F.col("value")
    cells = fit.select("x").mapInArrow(_cells(d, each, kind), f"cell int, value {kind}").groupBy("cell").agg(F.sum(value).alias("v"))
    found = {c: v for c, v in cells.collect()}  # bounded: cells of the covariance
    return [found[c] for c in sorted(found)]


def _halves(x: np.ndarray) -> np.ndarray:
    """Sums of the upper and lower 32 bits of each dimension, which cannot overflow."""
    return np.stack([(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)])


_OUT = pa.schema([("id", pa.int64()), ("component", pa.int32()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.float64())])


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Per row the sum over dimensions of (n x - S)^2, exact."""
    most = n * int(np.maximum(x, ~x).max(initial=0) + 1) + max(map(abs, sums), default=0)
    if len(sums) * most**2 < 2**63:
        away = n * x - np.array(sums, np.int64)
        return pa.array((away * away).sum(1)).cast(pa.decimal128(38, 0))
    away = x.astype(object) * n - np.array(sums, object)
    return pa.array([Decimal(int(v)) if v < 10**38 else None for v in (away * away).sum(1)], pa.decimal128(38, 0))


def _projected(d: int, n: int, sums: list[int], mean: np.ndarray, project: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(project)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                good, by_length = _whole(part)
                x = by_length.get(d)
                if x is None:
                    continue
                sizes = pc.list_value_length(part.column(1)).to_numpy(zero_copy_only=False)
                rows = good[sizes[good] == d]
                again = np.repeat(np.arange(len(rows)), k)
                whitened = (x - mean) @ project.T
                ids, away = part.column(0).take(pa.array(rows[again])), _deviations(x, n, sums).take(pa.array(again))
                yield tx.record(_OUT, ids, np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows)), away, whitened.ravel())

    return run


_RESULT = "id long, component int, deviation decimal(38,0), whitened double"


def whiten(embeddings: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per usable row and component: id, component (from 1), n, deviation (decimal), whitened, explained, identity_error."""
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    # equal vectors meet as bytes; a vector that many rows share is one row of each task's partial result
    fit = save(rows.mapInArrow(_packed, "d int, x binary").distinct())
    lengths = fit.groupBy("d").agg(F.count("*").alias("k")).orderBy(F.desc("k"), F.desc("d")).limit(1).collect()
    d, n = lengths[0] if lengths else (0, 0)
    if d > DIMENSIONS:
        raise ValueError(f"vectors of {d} dimensions: at most {DIMENSIONS}")
    fit_d = fit.where(F.col("d") == d)
    values = np.zeros(0)
    if n and d:
        halves = [int(v) for v in _sum(fit_d, d, _halves, "long")]
        sums = [h * 2**32 + l for h, l in zip(halves[:d], halves[d:], strict=True)]
        mean = np.array([s / n for s in sums])  # of whole numbers: rounded once

        def products(x: np.ndarray) -> np.ndarray:
            away = x - mean
            return away.T @ away

        covariance = np.array(_sum(fit_d, d, products)).reshape(d, d) / n
        trace = float(np.trace(covariance))
        values, found = eigen((covariance + covariance.T) / 2, components)
        keep = values > NOTHING * trace
        values, found = values[keep], found[keep]
    if not len(values):
        drop(fit)
        names = {"id": id_col} if id_col != "id" else {}
        empty = rows.sparkSession.createDataFrame([], _RESULT).withColumns({"n": F.lit(0).cast("long"), "explained": F.lit(0.0), "identity_error": F.lit(0.0)})
        return empty.withColumnsRenamed(names).select(id_col, "component", "n", "deviation", "whitened", "explained", "identity_error")
    project = found / np.sqrt(values)[:, None]

    def spread(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ project.T
        return w.T @ w

    k = len(values)
    error = float(np.max(np.abs(np.array(_sum(fit_d, d, spread)).reshape(k, k) / n - np.eye(k))))
    drop(fit)
    explained = F.element_at(F.array(*[F.lit(float(v / trace)) for v in values]), F.col("component"))
    out = rows.mapInArrow(_projected(d, n, sums, mean, project), _RESULT)
    return out.select(F.col("id").alias(id_col), "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
