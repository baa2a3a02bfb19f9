"""Points in shapes: an equi-join on cells of a grid, an exact test only at borders, the nearest centre elsewhere.

Each shape is the cells that it covers: those wholly inside say so, those that its
border passes carry the edges at their height, from their left side on, which are all
that a ray to the right can meet.  Points look up their cell.  Points in no shape get
the shape of the nearest centre (the mean of all corners), looked for in tiles of
centres.  Shapes are a table of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.session import kept

#: Rows of the table of cells up to which it is sent to all tasks.
SENT = 100_000
#: Centres of a tile, tiles at most (then they grow), and points that meet a tile at once.
TILE, TILES, POINTS = 2_000, 1_024, 50_000
#: Rings of cells within a tile, and centres of a cell, beyond which all of the tile's centres are compared.
RINGS, CROWDED = 8, 64

_EDGE = pa.struct([(c, pa.float64()) for c in ("x0", "y0", "x1", "y1")])
_CELLS = pa.schema([("place", pa.int64()), ("cx", pa.int64()), ("cy", pa.int64()), ("edges", pa.list_(_EDGE))])
_CELL_COLUMNS = "place long, cx long, cy long, edges array<struct<x0: double, y0: double, x1: double, y1: double>>"


def edges_of(rings: list) -> np.ndarray:
    """(x0, y0, x1, y1) of all edges of closed rings."""
    own = [np.asarray(r, float)[:, :2] for r in rings if len(r)]
    return np.concatenate([np.hstack([r, np.roll(r, -1, 0)]) for r in own]) if own else np.zeros((0, 4))


def crossed(edges: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether a ray to the right from each point meets an odd number of edges."""
    x0, y0, x1, y1 = edges.T[:, :, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (x1 - x0) * (y - y0) / (y1 - y0) + x0
    return (((y0 > y) != (y1 > y)) & (x < at)).sum(0) % 2 == 1


def covering(edges: np.ndarray, size: float) -> Iterator[tuple[int, int, np.ndarray | None]]:
    """(cx, cy, edges) of each cell that a shape covers; no edges where the cell is wholly inside."""
    if not len(edges):
        return
    x0, y0, x1, y1 = edges.T
    slack = size * 1e-9
    for cy in range(int(np.floor(edges[:, 1].min() / size)), int(np.floor(edges[:, 1].max() / size)) + 1):
        low, high = cy * size - slack, (cy + 1) * size + slack
        band = edges[(np.minimum(y0, y1) <= high) & (np.maximum(y0, y1) >= low)]
        a0, b0, a1, b1 = band.T
        with np.errstate(divide="ignore", invalid="ignore"):
            share = [np.where(b1 != b0, np.clip((end - b0) / (b1 - b0), 0, 1), k) for k, end in ((0.0, low), (1.0, high))]
        ends = np.sort(np.stack([a0 + (a1 - a0) * s for s in share]), axis=0)
        first, last = (np.floor((e + d) / size).astype(int) for e, d in zip(ends, (-slack, slack), strict=True))
        border = np.unique(np.concatenate([np.arange(f, l + 1) for f, l in zip(first, last, strict=True)]))
        rising = band[b0 != b1]
        for cx in border:
            yield int(cx), cy, rising[np.maximum(rising[:, 0], rising[:, 2]) >= cx * size - slack]
        between = np.setdiff1d(np.arange(border[0], border[-1] + 1), border)
        if len(between):
            inside = crossed(rising, (between + 0.5) * size, np.full(len(between), (cy + 0.5) * size))
            for cx in between[inside]:
                yield int(cx), cy, None


def _cells(size: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, rings in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list(covering(edges_of(rings or []), size))
                counts = [0 if e is None else len(e) for _, _, e in found]
                flat = np.concatenate([np.zeros((0, 4)), *[e for _, _, e in found if e is not None]])
                values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in flat.T], fields=list(_EDGE))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values, mask=pa.array([e is None for _, _, e in found], pa.bool_()))
                yield pa.RecordBatch.from_arrays([pa.array([place] * len(found), pa.int64()), pa.array([x for x, _, _ in found], pa.int64()), pa.array([y for _, y, _ in found], pa.int64()), lists], schema=_CELLS)

    return run


def _tiles(centres: DataFrame, n: int) -> DataFrame:
    """(tile, cx, cy, place): centres in tiles of about equally many, strips by x that are parted by y, about as wide as high."""
    count = min(max(n // TILE, 1), TILES)
    wide, high = centres.agg(F.max("cx") - F.min("cx"), F.max("cy") - F.min("cy")).first()
    strips = int(np.clip(np.sqrt(count * max(wide, 1e-9) / max(high, 1e-9)), 1, count))
    rows = _parted(_parted(centres.withColumn("all", F.lit(0)), "all", "cx", strips, "strip"), "strip", "cy", count // strips, "tile")
    return rows.select("tile", "cx", "cy", "place")


def _parted(rows: DataFrame, within: str, by: str, parts: int, name: str) -> DataFrame:
    """Numbers of parts of about equally many rows, by one column within another's values."""
    if parts < 2:
        return rows.withColumn(name, F.col(within))
    cuts = rows.groupBy(within).agg(F.percentile_approx(by, [i / parts for i in range(1, parts)], 20_000).alias("_cuts"))  # a row a strip
    return rows.join(F.broadcast(cuts), within).withColumn(name, F.col(within) * parts + F.size(F.filter("_cuts", lambda v: v < F.col(by)))).drop("_cuts")


def _far_from(boxes: tuple, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squares of the distances of points from the boxes of tiles."""
    _, x0, x1, y0, y1 = boxes
    return np.maximum(np.maximum(x0 - x[:, None], x[:, None] - x1), 0) ** 2 + np.maximum(np.maximum(y0 - y[:, None], y[:, None] - y1), 0) ** 2


def _tile_of(shared, others: bool):
    """The nearest tile of each point, or, its nearest centre there known, the other tiles that may hold one as near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boxes = shared.value
        step = max(1, (1 << 20) // len(boxes[0]))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                x, y, *known = (c.to_numpy(zero_copy_only=False) for c in part.columns)
                square = _far_from(boxes, x, y)
                if others:
                    row, at = np.nonzero((square <= known[1][:, None] * (1 + 1e-9)) & (boxes[0] != known[0][:, None]))
                else:
                    row, at = np.arange(len(x)), square.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(x[row]), pa.array(y[row]), pa.array(boxes[0][at], pa.int32())], names=["x", "y", "tile"])

    return run


_NEAR = "x double, y double, tile int, away double, place long"


class _Grid:
    """Centres of a tile in cells of about two, in order of cell."""

    def __init__(self, x: np.ndarray, y: np.ndarray, place: np.ndarray):
        self.x0, self.y0 = x.min(), y.min()
        wide, high = x.max() - self.x0, y.max() - self.y0
        self.size = max(np.sqrt(wide * high * 2 / len(x)), max(wide, high) * 2 / len(x), 1e-300)
        self.nx, self.ny = int(wide / self.size) + 1, int(high / self.size) + 1
        cell = self.cell(x, self.x0, self.nx) * self.ny + self.cell(y, self.y0, self.ny)
        order = np.lexsort((place, cell))
        self.x, self.y, self.place = x[order], y[order], place[order]
        self.starts = np.searchsorted(cell[order], np.arange(self.nx * self.ny + 1))
        self.most = int(np.diff(self.starts).max())

    def cell(self, v: np.ndarray, low: float, n: int) -> np.ndarray:
        return np.clip(np.floor((v - low) / self.size), 0, n - 1).astype(np.int64)

    def nearest(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, square of the distance): squares of cells that grow about a point's own, until nothing outside can be nearer."""
        best, away = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), np.inf)
        cx, cy = self.cell(x, self.x0, self.nx), self.cell(y, self.y0, self.ny)
        outside = sum(np.maximum(np.maximum(low - v, v - low - n * self.size), 0) ** 2 for v, low, n in ((x, self.x0, self.nx), (y, self.y0, self.ny)))
        left = np.arange(len(x))
        for ring in range(RINGS if self.most <= CROWDED else 0):
            for dx in range(-ring, ring + 1):
                for a, b in [(-ring, ring)] if abs(dx) == ring else [(-ring, -ring), (ring, ring)]:
                    col, lo, hi = cx[left] + dx, cy[left] + a, cy[left] + b
                    on = np.flatnonzero((col >= 0) & (col < self.nx) & (hi >= 0) & (lo < self.ny))
                    base, lo, hi = col[on] * self.ny, np.maximum(lo[on], 0), np.minimum(hi[on], self.ny - 1)
                    first = self.starts[base + lo]
                    many = self.starts[base + hi + 1] - first
                    for k in range(int(many.max(initial=0))):
                        own = np.flatnonzero(many > k)
                        at, row = first[own] + k, left[on[own]]
                        square = (x[row] - self.x[at]) ** 2 + (y[row] - self.y[at]) ** 2
                        better = (square < away[row]) | ((square == away[row]) & (self.place[at] < best[row]))
                        best[row[better]], away[row[better]] = self.place[at[better]], square[better]
            # what is not looked at is at least so many cells from the place among them that is nearest to the point
            left = left[~(away[left] * (1 + 1e-9) < (ring * self.size) ** 2 + outside[left])]
            if not len(left):
                return best, away
        step = max(1, (1 << 21) // len(self.x))
        for lo in range(0, len(left), step):
            row = left[lo : lo + step]
            square = (x[row, None] - self.x) ** 2 + (y[row, None] - self.y) ** 2
            away[row] = square.min(1)
            best[row] = np.where(square == away[row, None], self.place, np.iinfo(np.int64).max).min(1)
        return best, away


def _nearest(points: pa.Table, centres: pa.Table) -> pa.Table:
    """Of the points of a tile the nearest of its centres."""
    x, y, tile = (points[c].to_numpy() for c in ("x", "y", "tile"))
    if not len(x) or not centres.num_rows:
        return pa.table({"x": pa.array([], pa.float64()), "y": pa.array([], pa.float64()), "tile": pa.array([], pa.int32()), "away": pa.array([], pa.float64()), "place": pa.array([], pa.int64())})
    best, away = _Grid(*(centres[c].to_numpy() for c in ("cx", "cy", "place"))).nearest(x, y)
    return pa.table({"x": x, "y": y, "tile": tile, "away": away, "place": best})


def _within_tiles(points: DataFrame, tiles: DataFrame) -> DataFrame:
    """(x, y, tile, away, place): the nearest centre in the tile that each point has; a tile of many points is looked at in parts."""
    parts = points.groupBy("tile").agg(F.ceil(F.count("*") / POINTS).cast("int").alias("parts"))  # a row a tile
    own = points.join(F.broadcast(parts), "tile").withColumn("part", F.pmod(F.xxhash64("x", "y"), F.col("parts")).cast("int")).drop("parts")
    held = tiles.join(F.broadcast(parts), "tile").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return own.groupBy("tile", "part").cogroup(held.groupBy("tile", "part")).applyInArrow(_nearest, _NEAR)


def nearest_centres(points: DataFrame, centres: DataFrame) -> DataFrame:
    """(x, y, place) of the nearest centre (place, cx, cy) of each point (x, y), of equally near ones the least place.

    A point is compared with the centres of its nearest tile, by cells, and then with
    those of the tiles that are no further than what was found.
    """
    centres = kept(centres.groupBy("cx", "cy").agg(F.min("place").alias("place")))
    tiles = kept(_tiles(centres, centres.count()))
    boxes = tiles.groupBy("tile").agg(F.min("cx"), F.max("cx"), F.min("cy"), F.max("cy")).collect()  # TILES rows at most
    shared = points.sparkSession.sparkContext.broadcast((np.array([b[0] for b in boxes], np.int32), *np.array([b[1:] for b in boxes]).T))
    own = kept(points.select("x", "y").mapInArrow(_tile_of(shared, False), "x double, y double, tile int"))
    first = kept(_within_tiles(own, tiles))
    more = kept(first.select("x", "y", "tile", "away").mapInArrow(_tile_of(shared, True), "x double, y double, tile int"))
    both = first.unionByName(_within_tiles(more, tiles))
    return both.groupBy("x", "y").agg(F.min(F.struct("away", "place")).alias("best")).select("x", "y", F.col("best.place").alias("place"))


def located(points: DataFrame, shapes: DataFrame, cell: float | None = None) -> DataFrame:
    """The shape of each point (id, x, y): (id, shape, inside).

    shapes: (shape, rings[, place]), rings of outer and inner lines alike; of several
    shapes that hold a point, or whose centres are equally near, the one of the least
    place (else name) is taken.  A point without x or y, or with no shapes at all, has a
    null shape.  Each point is a row of its own, whether or not ids repeat.
    """
    spark = points.sparkSession
    if "place" not in shapes.columns:
        from civicspark.operators.crawl import numbered

        shapes = numbered(shapes.select("shape", "rings"), "shape", "place")
    shapes = shapes.select(F.col("place").cast("long").alias("place"), "shape", F.col("rings").cast("array<array<array<double>>>").alias("rings")).where("size(flatten(rings)) > 0")
    corner = lambda i: F.transform(F.flatten("rings"), lambda p: p[i])
    wide = lambda i: F.array_max(corner(i)) - F.array_min(corner(i))
    n, mean = shapes.agg(F.count("*"), F.avg(F.sqrt(F.greatest(wide(0) * wide(1), F.lit(1e-18))))).first()
    if not n:
        return points.select("id", F.lit(None).cast("string").alias("shape"), F.lit(False).alias("inside"))
    size = cell or max(mean / 4, 1e-9)
    rows = points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    # a place is looked up once, however many points are there
    spots = kept(rows.select("x", "y").where("x is not null and y is not null and not isnan(x) and not isnan(y)").distinct())
    # shapes that no point can be in are not cut to cells
    at = lambda v: F.floor(v / (4 * size))
    span = lambda i: F.sequence(at(F.array_min(corner(i))) - 1, at(F.array_max(corner(i))) + 1)
    met = spots.select(at(F.col("x")).alias("gx"), at(F.col("y")).alias("gy")).distinct()
    near = shapes.select("place", span(1).alias("gys"), F.explode(span(0)).alias("gx")).select("place", "gx", F.explode("gys").alias("gy")).join(met, ["gx", "gy"], "left_semi").select("place").distinct()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = kept(shapes.select("place", "rings").join(near, "place", "left_semi").repartition(parts, "place").mapInArrow(_cells(size), _CELL_COLUMNS))
    meets = F.filter("edges", lambda e: ((e.y0 > F.col("y")) != (e.y1 > F.col("y"))) & (F.col("x") < (e.x1 - e.x0) * (F.col("y") - e.y0) / F.when(e.y1 != e.y0, e.y1 - e.y0) + e.x0))
    few = cells.select("place").limit(SENT + 1).count() <= SENT
    hits = spots.withColumns({"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)}).join(F.broadcast(cells) if few else cells, ["cx", "cy"])
    hits = kept(hits.where(F.col("edges").isNull() | (F.size(meets) % 2 == 1)).groupBy("x", "y").agg(F.min("place").alias("place")))
    far = spots.join(hits, ["x", "y"], "left_anti")
    mean_of = lambda i: F.aggregate(corner(i), F.lit(0.0), lambda s, v: s + v) / F.size(F.flatten("rings"))
    other = nearest_centres(far, shapes.select("place", mean_of(0).alias("cx"), mean_of(1).alias("cy"))).withColumn("inside", F.lit(False))
    named = hits.withColumn("inside", F.lit(True)).unionByName(other).join(shapes.select("place", "shape"), "place")
    return rows.join(named, ["x", "y"], "left").select("id", "shape", F.coalesce("inside", F.lit(False)).alias("inside"))
