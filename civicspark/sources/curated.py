"""Curated files: a sink in two phases, and pages read back from their parts alone.

    data/RESOURCE[/SHEET]/part-FIRST-ID.ndjson   rows, one JSON value a line, at most PART_ROWS a file
    data/RESOURCE[/SHEET]/schema-ID.json         the sidecar
    data/RESOURCE/document-ID.ENDING             a whole document
    parts/folder=N, manifest                     which files hold which rows of which resource (see operators.levels)

Tasks write files of their own names; a task that fails deletes what it has written,
and nothing is read that no commit lists, so a lost attempt leaves no rows behind.
The list of parts, ordered by resource, is what a page looks into: it opens the
parts that its rows are in.  A resource that is written again replaces all its parts.

Paths go through Arrow's file systems (file, hdfs, s3, gs), in tasks and driver alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from civicspark.functions import text as fx
from civicspark.operators import levels

PART_ROWS = 20_000
#: Parts that a task holds before it writes them to its list.
LISTED = 4096
#: Rows of a page at most, and where none are asked for.
MOST, PAGE = 1000, 100
#: File endings of whole documents by kind.
ENDINGS = {"json": "json", "geojson": "geojson", "xml": "xml", "text": "txt"}
SINK = "resource string, sheet string, kind string, row_no long, value string"
_PARTS = "resource string, sheet string, kind string, file string, first long, rows long, batch int"
_PART_ARROW = pa.schema([("resource", pa.string()), ("sheet", pa.string()), ("kind", pa.string()), ("file", pa.string()), ("first", pa.int64()), ("rows", pa.int64())])


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    index: str | None


class CuratedWriter(DataSourceArrowWriter):
    """Rows (resource, sheet, kind, row_no, value), a resource's sheet in a run, in order of row_no."""

    def __init__(self, options: dict[str, str]):
        self.path, self.rows = options["path"], int(options.get("partrows", PART_ROWS))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = opened(self.path)
        attempt, stream, now = uuid.uuid4().hex, None, None
        parts, done = [], 0  # those of which the list is not written yet, and how many are in it
        index, listed = f"{root}/pending/{attempt}.parquet", None
        try:
            for batch in iterator:
                for resource, sheet, kind, row_no, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if now != (resource, sheet, kind) or parts[-1][5] >= self.rows or row_no < 0:
                        if stream is not None:
                            stream.close()
                        if len(parts) >= LISTED:
                            listed = listed or _list(system, root, index)
                            listed.write_batch(_part_rows(parts))
                            done, parts = done + len(parts), []
                        folder = "/".join(x for x in (root, "data", resource, sheet) if x)
                        name = "schema" if kind == "schema" else "document" if row_no < 0 else f"part-{row_no:012d}"
                        ending = "ndjson" if row_no >= 0 else ENDINGS.get(kind, "json")
                        file = f"{folder}/{name}-{done + len(parts)}-{attempt}.{ending}"
                        system.create_dir(folder, recursive=True)
                        stream, now = system.open_output_stream(file), (resource, sheet, kind)
                        parts.append([resource, sheet, kind, file, row_no, 0])
                    stream.write(value.encode() + (b"" if row_no < 0 else b"\n"))
                    parts[-1][5] += 1
            if stream is not None:
                stream.close()
            if not parts:
                return Written(None)
            listed = listed or _list(system, root, index)
            listed.write_batch(_part_rows(parts))
            listed.close()
            return Written(index)
        except BaseException:
            if stream is not None and not stream.closed:
                stream.close()
            for part in parts:
                _remove(system, part[3])
            if listed is not None:
                listed.close()
                _remove_listed(system, index)
            raise

    def commit(self, messages: list[Written | None]) -> None:
        """Name the tasks' lists in one file, which `write_curated` takes up: one line a task."""
        system, root = opened(self.path)
        names = [m.index for m in messages if m is not None and m.index]
        system.create_dir(f"{root}/pending", recursive=True)
        with system.open_output_stream(f"{root}/pending/commit") as out:
            out.write("\n".join(names).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = opened(self.path)
        for index in (m.index for m in messages if m is not None and m.index):
            _remove_listed(system, index)


def _list(system: fs.FileSystem, root: str, index: str) -> pq.ParquetWriter:
    system.create_dir(f"{root}/pending", recursive=True)
    return pq.ParquetWriter(index, _PART_ARROW, filesystem=system)


def _part_rows(parts: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*parts, strict=True), _PART_ARROW, strict=True)], schema=_PART_ARROW)


def _remove_listed(system: fs.FileSystem, index: str) -> None:
    """Delete the files of a task's list, some at a time, and the list."""
    with system.open_input_file(index) as held:
        for batch in pq.ParquetFile(held).iter_batches(LISTED, columns=["file"]):
            for file in batch.column(0).to_pylist():
                _remove(system, file)
    _remove(system, index)


def _remove(system: fs.FileSystem, file: str) -> None:
    if system.get_file_info(file).type != fs.FileType.NotFound:
        system.delete_file(file)


class CuratedSink(DataSource):
    """Options: path, partrows."""

    @classmethod
    def name(cls) -> str:
        return "civic_curated"

    def schema(self) -> str:
        return SINK

    def writer(self, schema: StructType, overwrite: bool) -> CuratedWriter:
        return CuratedWriter(self.options)


def table_values(rows: DataFrame) -> DataFrame:
    """Curated cells (path, sheet, row_no, name, cell) as sink rows: an object a row, nulls kept, and the sheet's schema beside them."""
    wide = rows.groupBy("path", "sheet", "row_no").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "cell")))).alias("row"))
    resource, sheet = fx.safe_segment(F.col("path")).alias("resource"), fx.safe_segment(F.col("sheet")).alias("sheet")
    sheet = F.when(F.col("sheet") == "", "").otherwise(sheet).alias("sheet")
    out = wide.select(resource, sheet, F.lit("tabular").alias("kind"), F.col("row_no").cast("long").alias("row_no"), F.to_json("row", {"ignoreNullFields": "false"}).alias("value"))
    names = rows.groupBy("path", "sheet").agg(F.array_sort(F.collect_set("name")).alias("columns"), F.countDistinct("row_no").alias("rows"))
    described = F.to_json(F.struct(F.lit("tabular").alias("kind"), F.lit("utf-8").alias("encoding"), F.col("columns"), F.col("rows")))
    return out.unionByName(names.select(resource, sheet, F.lit("schema").alias("kind"), F.lit(-1).cast("long").alias("row_no"), described.alias("value")))


def document_values(documents: DataFrame) -> DataFrame:
    """Curated documents (path, kind, body) as sink rows: the entries of a JSON list one by one, anything else whole (row -1)."""
    resource = fx.safe_segment(F.col("path")).alias("resource")
    listed = (F.col("kind").isin("json", "geojson")) & F.coalesce(F.ltrim("body").startswith("["), F.lit(False))
    entries = F.posexplode(F.try_variant_get(F.try_parse_json("body"), "$", "array<variant>")).alias("row_no", "entry")
    one = documents.where(listed).select(resource, "kind", entries).select("resource", F.lit("").alias("sheet"), "kind", F.col("row_no").cast("long").alias("row_no"), F.to_json("entry").alias("value"))
    whole = documents.where(~listed).select(resource, F.lit("").alias("sheet"), "kind", F.lit(-1).cast("long").alias("row_no"), F.coalesce("body", F.lit("")).alias("value"))
    return one.unionByName(whole)


def write_curated(values: DataFrame, path: str, batch: int, part_rows: int = PART_ROWS, fan: int = levels.FAN) -> None:
    """Write sink rows, which replace what their resources had, as batch number `batch`; a committed batch is left alone."""
    spark = values.sparkSession
    state = levels.manifest(spark, path)
    if state["own"] and batch <= state["own"]["batch"]:
        return
    spark.dataSource.register(CuratedSink)
    number = state["next"]
    state = levels.emptied(spark, state, lambda old: levels.write(spark.createDataFrame([], _PARTS).coalesce(1), path, "parts", old))
    order = ["resource", "sheet", "kind", "row_no"]
    rows = values.select(*order, "value").repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.format("civic_curated").mode("append").option("path", path).option("partrows", str(part_rows)).save()
    system, root = opened(path)
    with system.open_input_stream(f"{root}/pending/commit") as names:
        lists = names.read().decode().split()
    base = path[: len(path) - len(root)] if path.endswith(root) else ""
    schema = _PARTS.rpartition(",")[0]
    parts = spark.read.schema(schema).parquet(*[base + x for x in lists]) if lists else spark.createDataFrame([], schema)
    levels.write(parts.withColumn("batch", F.lit(number)).repartitionByRange("resource", "sheet", "first").sortWithinPartitions("resource", "sheet", "first"), path, "parts", number)
    state = levels.commit(spark, path, levels.added(state, number, {"batch": batch}))
    for name in [*lists, f"{root}/pending/commit"]:
        _remove(system, name)
    while full := levels.full_level(state, fan):
        level, numbers = full
        number = state["next"]
        newest = _newest(levels.read(spark, path, "parts", state, _PARTS, numbers))
        levels.write(newest.repartitionByRange("resource", "sheet", "first").sortWithinPartitions("resource", "sheet", "first"), path, "parts", number)
        state = levels.commit(spark, path, levels.merged(state, numbers, level, number, state["own"]))


def _newest(parts: DataFrame) -> DataFrame:
    """The parts of each resource's newest batch."""
    last = parts.groupBy("resource").agg(F.max("batch").alias("batch"))
    return parts.join(last, ["resource", "batch"], "left_semi")


_LINES = pa.schema([("resource", pa.string()), ("sheet", pa.string()), ("kind", pa.string()), ("position", pa.int64()), ("value", pa.string()), ("offset", pa.int64()), ("limit", pa.int64())])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The asked lines of each part (resource, sheet, kind, file, begin, skip, take, whole, offset, limit)."""
    for batch in batches:
        for resource, sheet, kind, file, begin, skip, take, whole, offset, limit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            system, name = opened(file)
            with system.open_input_stream(name) as stream:
                if whole:
                    found = [(0, stream.read().decode())]
                else:
                    found = []
                    for k, line in enumerate(_split(stream)):
                        if k >= skip + take:
                            break
                        if k >= skip:
                            found.append((begin + k, line))
            n = len(found)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([resource] * n, [sheet] * n, [kind] * n, [p for p, _ in found], [v for _, v in found], [offset] * n, [limit] * n), _LINES, strict=True)], schema=_LINES)


def _split(stream) -> Iterator[str]:
    """Lines of a stream, a block of it at a time."""
    rest = b""
    while block := stream.read(1 << 20):
        *lines, rest = (rest + block).split(b"\n")
        for line in lines:
            yield line.decode()
    if rest:
        yield rest.decode()


def asked_parts(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """Of each request (resource[, sheet, offset, limit]) the parts that its rows are in, and how many rows its sheet has.

    A limit is drawn into 1 to MOST, an offset is 0 at least; without a sheet the
    first one is meant.  Only parts of the asked resources are looked at.
    """
    for name, value in (("sheet", F.lit(None).cast("string")), ("offset", F.lit(0)), ("limit", F.lit(PAGE))):
        asked = asked if name in asked.columns else asked.withColumn(name, value)
    offset = F.greatest(F.coalesce("offset", F.lit(0)).cast("long"), F.lit(0)).alias("offset")
    limit = F.least(F.greatest(F.coalesce("limit", F.lit(PAGE)).cast("long"), F.lit(1)), F.lit(MOST)).alias("limit")
    asked = asked.select("resource", F.col("sheet").alias("_sheet"), offset, limit)
    state = levels.manifest(spark, path)
    parts = levels.read(spark, path, "parts", state, _PARTS).join(asked.select("resource").distinct(), "resource", "left_semi")
    parts = _newest(parts).where("kind <> 'schema'")
    sheets = parts.groupBy("resource").agg(F.min("sheet").alias("_first"))
    of = Window.partitionBy("resource", "sheet")
    before = F.coalesce(F.sum("rows").over(of.orderBy("first", "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("*", before.alias("begin"), F.sum("rows").over(of).alias("total"))
    both = asked.join(sheets, "resource").withColumn("sheet", F.coalesce("_sheet", "_first")).join(parts, ["resource", "sheet"])
    inside = (F.col("begin") < F.col("offset") + F.col("limit")) & (F.col("begin") + F.col("rows") > F.col("offset"))
    whole = F.col("first") < 0
    skip = F.greatest(F.col("offset") - F.col("begin"), F.lit(0))
    take = F.least(F.col("offset") + F.col("limit") - F.col("begin"), F.col("rows")) - skip
    return both.where(inside | whole).select("resource", "sheet", "kind", "file", "begin", skip.alias("skip"), take.alias("take"), whole.alias("whole"), "offset", "limit", "total")


def pages(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """The pages that requests (resource[, sheet, offset, limit]) ask for: (resource, sheet, kind, position, value, offset, limit, total, truncated).

    Rows of tables and of JSON lists have their position; a whole document is one row at
    0, its total 1, of XML and text 0.  A resource that is not there has no row.
    """
    parts = asked_parts(spark, path, asked)
    read = parts.drop("total").mapInArrow(_lines, "resource string, sheet string, kind string, position long, value string, offset long, limit long")
    total = F.when(F.col("kind").isin("xml", "text"), 0).otherwise(F.col("total"))
    sizes = parts.select("resource", "sheet", total.cast("long").alias("total")).distinct()
    return read.join(sizes, ["resource", "sheet"]).withColumn("truncated", F.col("offset") + F.col("limit") < F.col("total"))


def schemas(spark: SparkSession, path: str, resources: DataFrame) -> DataFrame:
    """Sidecars of resources (resource): (resource, sheet, schema)."""
    parts = _newest(levels.read(spark, path, "parts", levels.manifest(spark, path), _PARTS).join(resources.select("resource").distinct(), "resource", "left_semi")).where("kind = 'schema'")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    asked = parts.select("resource", "sheet", "kind", "file", zero.alias("begin"), zero.alias("skip"), one.alias("take"), F.lit(True).alias("whole"), zero.alias("offset"), one.alias("limit"))
    read = asked.mapInArrow(_lines, "resource string, sheet string, kind string, position long, value string, offset long, limit long")
    return read.select("resource", "sheet", F.col("value").alias("schema"))


# ---- blobs


class BlobWriter(DataSourceArrowWriter):
    """Contents (folder, name, content) as files folder/name, each written once: aside, then moved to its place."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = opened(self.path)
        for batch in iterator:
            for folder, name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                target = f"{root}/{folder}/{name}"
                there = system.get_file_info(target)
                if there.type == fs.FileType.File and there.size == len(content):
                    continue
                aside = f"{root}/aside/{uuid.uuid4().hex}"
                system.create_dir(f"{root}/aside", recursive=True)
                try:
                    with system.open_output_stream(aside) as out:
                        out.write(content)
                    system.create_dir(f"{root}/{folder}", recursive=True)
                    system.move(aside, target)
                finally:
                    _remove(system, aside)
        return WriterCommitMessage()

    def commit(self, messages: list) -> None:
        """A blob is its content's name: what is in its place is whole, whoever wrote it."""

    def abort(self, messages: list) -> None:
        """Blobs that are there stay: they are what another attempt would write."""


class BlobSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "civic_blobs"

    def schema(self) -> str:
        return "folder string, name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> BlobWriter:
        return BlobWriter(self.options)


def write_blobs(files: DataFrame, path: str, ending: str = "bin") -> DataFrame:
    """Write each content (path, content) once, under the SHA-256 of it; returns (path, sha256, bytes, file)."""
    files.sparkSession.dataSource.register(BlobSink)
    named = files.select("path", "content", F.sha2("content", 256).alias("sha256"))
    own = named.groupBy("sha256").agg(F.any_value("content").alias("content"))
    place = lambda c: F.concat(F.lit("raw/"), F.substring(c, 1, 2))
    out = own.select(place("sha256").alias("folder"), F.concat("sha256", F.lit(f".{ending}")).alias("name"), "content")
    out.write.format("civic_blobs").mode("append").option("path", path).save()
    return named.select("path", "sha256", F.octet_length("content").cast("long").alias("bytes"), F.concat(place("sha256"), F.lit("/"), "sha256", F.lit(f".{ending}")).alias("file"))
