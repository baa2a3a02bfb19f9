"""Raw files to curated rows: encodings, delimited text, workbooks, portal envelopes, JSON, GeoJSON, XML, text.

Files come as Spark's binaryFile rows.  What needs bytes runs in `mapInPandas`
over them, a file at a time; everything after is DataFrame operations on long
rows (path, row_no, position, name, cell), as files have columns of their own.
"""

from __future__ import annotations

import io
import json
import re
import unicodedata
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.functions import text as fx

#: Bytes of CP1251 below 0xC0 and what they stand for; from 0xC0 on it is U+0410 and up, others are unknown.
CP1251 = {
    0x80: 0x402, 0x81: 0x403, 0x82: 0x201A, 0x83: 0x453, 0x84: 0x201E, 0x85: 0x2026, 0x86: 0x2020, 0x87: 0x2021, 0x88: 0x20AC, 0x89: 0x2030, 0x8A: 0x409,
    0x8B: 0x2039, 0x8C: 0x40A, 0x8D: 0x40C, 0x8E: 0x40B, 0x8F: 0x40F, 0xA1: 0x40E, 0xA2: 0x45E, 0xA3: 0x408, 0xA5: 0x490, 0xA8: 0x401, 0xB8: 0x451,
}
_TABLE = "".join(chr(b) if b < 0x80 else chr(0x410 + b - 0xC0) if b >= 0xC0 else chr(CP1251.get(b, 0xFFFD)) for b in range(256))
#: Cells, and characters of cells, that a task gives on at once.
CELLS_AT_ONCE, CHARS_AT_ONCE = 20_000, 1 << 22
CELLS = "path string, sheet string, row_no long, position int, cell string"


def scan(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a folder as (path, length, content)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length", "content")


def pending(resources: DataFrame, files: DataFrame) -> DataFrame:
    """Files of resources whose last outcome is success; a resource without its file is left out."""
    return resources.where("last_outcome = 'success' and raw_path is not null").join(files, F.col("raw_path") == F.col("path"))


def detected_encoding(content: Column, declared: Column | None = None) -> Column:
    """struct(encoding, confidence): a BOM, the declared charset, ASCII in the first 8192 bytes, valid UTF-8, else by the share of Cyrillic bytes."""
    head = F.hex(F.substring(content, 1, 8192))
    pairs = F.regexp_extract_all(head, F.lit("(..)"), F.lit(1))
    high = F.size(F.filter(pairs, lambda x: x >= "80"))
    cyrillic = F.size(F.filter(pairs, lambda x: x >= "C0"))
    said = F.lower(declared) if declared is not None else F.lit(None).cast("string")
    of = lambda name, sure: F.struct(F.lit(name).alias("encoding"), F.lit(sure).alias("confidence"))
    return (
        F.when(F.startswith(head, F.lit("EFBBBF")), of("utf-8", 1.0)).when(said.isin("utf-8", "utf8"), of("utf-8", 0.95))
        .when(said.isin("windows-1251", "cp1251", "cp-1251", "win-1251"), of("cp1251", 0.95)).when(high == 0, of("utf-8", 1.0))
        .when(F.is_valid_utf8(content.cast("string")), of("utf-8", 0.85)).when(cyrillic >= 0.8 * high, of("cp1251", 0.8)).otherwise(of("utf-8", 0.5))
    )


def _decoded(content: pd.Series, encoding: pd.Series) -> pd.Series:
    def one(data: bytes | None, name: str) -> str | None:
        if data is None:
            return None
        if name == "cp1251":
            return bytes(data).decode("latin-1").translate(dict(enumerate(_TABLE)))
        return bytes(data).removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace")

    return pd.Series([one(d, n) for d, n in zip(content, encoding, strict=True)], dtype=object)


def decoded(content: Column, encoding: Column) -> Column:
    """Text of bytes; a BOM goes, bytes that stand for nothing become U+FFFD."""
    return F.pandas_udf(_decoded, "string")(content, encoding)


def nfc(text: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x)), "string")(text)


def delimiter(line: str) -> str:
    comma, semicolon, tab = (line.count(c) for c in ",;\t")
    return ";" if semicolon > comma else "\t" if tab > comma else ","


def delimited(text: str) -> Iterator[list[str]]:
    """Rows of delimited text: quotes open and close anywhere in a cell, a doubled one inside stands for itself.

    The delimiter comes from the first line that is not empty.  One empty last row
    goes, as does a row whose quotes never close.  Lines without quotes are split as
    they are; others are joined until their quotes are even, which closes a row.
    """
    lines = text.replace("\r\n", "\n").split("\n")
    mark = delimiter(next((x for x in lines if x), ""))
    held: list[str] | None = None
    pending, quoted = [], 0
    for line in lines:
        if not pending and '"' not in line:
            row = line.split(mark)
        else:
            pending.append(line)
            quoted ^= line.count('"') & 1
            if quoted:
                continue
            row, pending = _quoted("\n".join(pending), mark), []
        if held is not None:
            yield held
        held = row
    if held is not None and held != [""]:
        yield held


def _quoted(line: str, mark: str) -> list[str]:
    """The cells of one row with quotes: every other stretch between them is quoted; one of no length between two quoted ones is a quote."""
    row, cell = [], []
    parts = line.split('"')
    for i, part in enumerate(parts):
        if i % 2:
            cell.append(part)
        elif 0 < i < len(parts) - 1 and part == "":
            cell.append('"')
        else:
            first, *rest = part.split(mark)
            cell.append(first)
            for x in rest:
                row.append("".join(cell))
                cell = [x]
    row.append("".join(cell))
    return row


def _column_number(name: str) -> int:
    n = 0
    for c in name:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def workbook(data: bytes) -> Iterator[tuple[str, Iterator[list[str]]]]:
    """Sheets of an XLSX file with their rows of text; sheets without a part are left out, dates stay serial numbers."""
    book = zipfile.ZipFile(io.BytesIO(data))
    names = set(book.namelist())
    tag = lambda e: e.tag.rpartition("}")[2]
    text_of = lambda e: "".join(t.text or "" for t in e.iter() if tag(t) == "t")
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = [text_of(e) for e in ElementTree.fromstring(book.read("xl/sharedStrings.xml")) if tag(e) == "si"]
    targets = {e.get("Id"): e.get("Target", "") for e in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))} if "xl/_rels/workbook.xml.rels" in names else {}
    sheets = [e for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if tag(e) == "sheet"]

    def rows(part: str) -> Iterator[list[str]]:
        with book.open(part) as stream:
            for _, e in ElementTree.iterparse(stream):
                if tag(e) != "row":
                    continue
                cells: list[str] = []
                for c in e:
                    at = _column_number(c.get("r", "")) if c.get("r") else len(cells)
                    kind = c.get("t", "")
                    value = next((v.text or "" for v in c if tag(v) == "v"), "")
                    if kind == "s" and value:
                        value = shared[int(value)]
                    elif kind == "inlineStr":
                        value = text_of(c)
                    elif kind == "b":
                        value = "true" if value == "1" else "false"
                    cells += [""] * (at - len(cells)) + [value]
                e.clear()
                yield cells

    for sheet in sheets:
        link = next((v for k, v in sheet.attrib.items() if k.endswith("}id")), "")
        target = targets.get(link, "").lstrip("/")
        part = target if target.startswith("xl/") else f"xl/{target}"
        if part in names:
            yield sheet.get("name", ""), rows(part)


def _number(text: str) -> bool:
    """Whether a header cell reads as a number once blanks go and its first comma is a point."""
    try:
        float(re.sub(r"\s", "", text).replace(",", ".", 1))
    except ValueError:
        return False
    return text != "" and not re.search(r"nan|inf|_", text, re.I)


def header_of(rows: list[list[str]]) -> tuple[list[str], int]:
    """One header from the first rows of a table, and where its data starts.

    A first row with merged group labels joins with the labels below it: when the
    second row has labels and no numbers, the third has data, and some blank cell
    right of a group label has a label below.
    """
    width = max([1, *map(len, rows[:10])]) if rows else 0
    top, below, third = [[*(x.strip() for x in rows[i]), *[""] * (width - len(rows[i]))] if len(rows) > i else None for i in range(3)]
    if top is None:
        return [], 0
    labels = lambda row: any(row) and not any(_number(c) for c in row)
    spread, group, grew = list(top), "", False
    for i, cell in enumerate(top):
        if cell:
            group = cell
        elif below and below[i] and group:
            spread[i], grew = group, True
        else:
            group = ""
    if not (grew and below and third and labels(below) and not labels(third)):
        return top, 1
    return [" ".join(x for x in pair if x) for pair in zip(spread, below, strict=True)], 2


def _cells(read: Callable[[str, bytes, str], Iterator[tuple[str, Iterator[list[str]]]]]):
    schema = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("row_no", pa.int64()), ("position", pa.int32()), ("cell", pa.string())])

    def held(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # cells of many small files go on together, those of a large one in parts
        out, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                path, content, text = (c[i].as_py() for c in batch.columns)
                try:
                    for sheet, rows in read(path, content, text):
                        for n, row in enumerate(rows):
                            out += [(path, sheet, n, i, cell) for i, cell in enumerate(row)]
                            size += sum(map(len, row))
                            if len(out) >= CELLS_AT_ONCE or size >= CHARS_AT_ONCE:
                                yield held(out)
                                out, size = [], 0
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as error:
                    out.append((path, "", -1, -1, str(error)[:500]))  # an uncurated file is a row, not the job's end
        if out:
            yield held(out)

    return run


def _texts(files: DataFrame) -> DataFrame:
    return files.select("path", "content", decoded(F.col("content"), detected_encoding(F.col("content")).encoding).alias("text"))


def read_csv(files: DataFrame) -> DataFrame:
    """Cells of delimited files, the header being row 0; row -1 holds the error of a file that cannot be read."""
    return _texts(files).mapInArrow(_cells(lambda path, content, text: iter([("", delimited(text))])), CELLS)


def read_xlsx(files: DataFrame) -> DataFrame:
    return files.select("path", "content", F.lit("").alias("text")).mapInArrow(_cells(lambda path, content, text: workbook(content)), CELLS)


def _answer(text: str):
    """The data of a portal answer: rows, a text, or any other value; none is an empty list.  A text that is no JSON, or null, raises."""
    answer = json.loads(text, parse_constant=_refused)
    if answer is None:
        raise ValueError("the answer is null")
    data = answer.get("data") if isinstance(answer, dict) else None
    return [] if data is None else data


def _refused(name: str):
    raise ValueError(f"{name} is no JSON")


def _is_table(data) -> bool:
    return isinstance(data, list) and len(data) > 0 and isinstance(data[0], list)


def _number_text(x: float) -> str:
    """A number as portals print it: whole ones without a point."""
    if x.is_integer() and abs(x) < 1e21:
        return str(int(x))
    return re.sub(r"e([+-])0+(?=[0-9])", r"e\1", repr(x))


def _cell_text(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, list):
        return ",".join(_cell_text(x) for x in value)
    if isinstance(value, float):
        return _number_text(value)
    return "" if value is None else "[object Object]" if isinstance(value, dict) else str(value)


def _plain(value):
    """A value with whole numbers as such, so that 1.0 is written as 1."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return int(value) if isinstance(value, float) and value.is_integer() and abs(value) < 1e21 else value


def _envelope(path: str, content: bytes, text: str) -> Iterator[tuple[str, Iterator[list[str]]]]:
    data = _answer(text)
    if not _is_table(data):
        return
    rows = [[_cell_text(c) for c in (row if isinstance(row, list) else [row])] for row in data]
    head, start = header_of(rows)
    yield "", iter([head, *rows[start:]] if head else [])


def read_envelope(files: DataFrame) -> DataFrame:
    """Cells of portal answers {success, data: rows}, headers of two rows joined; answers of another shape have none (see read_answers)."""
    return _texts(files).mapInArrow(_cells(_envelope), CELLS)


def _shapes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out, size = [], 0
        for path, text in zip(frame["path"], frame["text"], strict=True):
            try:
                data = _answer(text)
            except (ValueError, RecursionError) as e:
                out.append((path, "uncurated", str(e), None))
                continue
            if isinstance(data, str):
                out.append((path, "text", data, None))
            elif _is_table(data):
                out.append((path, "tabular", None, None))
            else:
                out.append((path, "json", json.dumps(_plain(data), ensure_ascii=False, indent=2) + "\n", "array" if isinstance(data, list) else "object"))
            size += len(out[-1][2] or "")
            if size >= CHARS_AT_ONCE:
                yield pd.DataFrame(out, columns=["path", "kind", "body", "root"])
                out, size = [], 0
        if out:
            yield pd.DataFrame(out, columns=["path", "kind", "body", "root"])


def read_answers(files: DataFrame) -> DataFrame:
    """What each portal answer is curated as: (path, kind, body, root).

    Rows (the first entry is a list) are `tabular`, their cells are read_envelope's; a
    string is `text`, verbatim; anything else `json`, indented, its root `array` or
    `object`; no data counts as an empty list.  A file that is no JSON is `uncurated`,
    its body the error.
    """
    return _texts(files).select("path", "text").mapInPandas(_shapes, "path string, kind string, body string, root string")


def table_rows(cells: DataFrame) -> DataFrame:
    """Cells below each header with their columns' names: (path, sheet, row_no, position, name, cell).

    Cells beyond the header go; a row shorter than the header has nulls.
    """
    head = cells.where("row_no = 0").select("path", "sheet", "position", F.col("cell").alias("name"))
    rows = cells.where("row_no > 0").select("path", "sheet", "row_no").distinct()
    grid = rows.join(head, ["path", "sheet"])
    own = cells.where("row_no > 0")
    return grid.join(own, ["path", "sheet", "row_no", "position"], "left").select("path", "sheet", (F.col("row_no") - 1).alias("row_no"), "position", "name", F.when(F.col("cell") != "", F.col("cell")).alias("cell"))


def _whole_json(text: pd.Series) -> pd.Series:
    def one(x: str | None) -> bool:
        try:
            json.loads(x or "", parse_constant=float.fromhex)
        except (ValueError, RecursionError):
            return False
        return True

    return text.map(one)


def documents(files: DataFrame, kind: str) -> DataFrame:
    """Whole documents of a kind (json, geojson, xml, text): (path, kind, body, root); a body that does not fit is `uncurated`."""
    rows = _texts(files).select("path", F.col("text").alias("body"))
    if kind in ("json", "geojson"):
        whole = F.pandas_udf(_whole_json, "boolean")("body")  # Spark's parser stops after the first value
        value = F.when(whole, F.try_parse_json("body"))
        fits = value.isNotNull() if kind == "json" else F.coalesce(F.try_variant_get(value, "$.type", "string").isin("Feature", "FeatureCollection"), F.lit(False))
        root = F.try_variant_get(value, "$.type", "string") if kind == "geojson" else F.schema_of_variant(value)
        return rows.select("path", F.when(fits, kind).otherwise("uncurated").alias("kind"), "body", F.when(fits, root).alias("root"))
    root = fx.root_element(F.col("body")) if kind == "xml" else F.lit(None).cast("string")
    return rows.select("path", F.lit(kind).alias("kind"), "body", root.alias("root"))


def features(docs: DataFrame) -> DataFrame:
    """Features of GeoJSON documents: (path, position, geometry, properties), both as JSON text."""
    value = F.try_parse_json("body")
    parsed = F.coalesce(F.try_variant_get(value, "$.features", "array<variant>"), F.array(value))
    rows = docs.where("kind = 'geojson'").select("path", F.posexplode(parsed).alias("position", "f"))
    return rows.select("path", "position", F.to_json(F.variant_get("f", "$.geometry", "variant")).alias("geometry"), F.to_json(F.variant_get("f", "$.properties", "variant")).alias("properties"))


def write_rows(rows: DataFrame, path: str) -> None:
    """Curated rows as NDJSON, nulls kept, one folder a file."""
    wide = rows.groupBy("path", "sheet", "row_no").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "cell")))).alias("row"))
    out = wide.select(fx.safe_segment(F.col("path")).alias("resource"), F.to_json("row", {"ignoreNullFields": "false"}).alias("value"))
    out.write.mode("overwrite").partitionBy("resource").text(path)


def blobs(files: DataFrame) -> DataFrame:
    """One row for each distinct content, named by its SHA-256."""
    return files.withColumn("sha256", F.sha2("content", 256)).groupBy("sha256").agg(F.min("path").alias("path"), F.any_value("length").alias("length"))


def query_set(spark: SparkSession, path: str, languages: tuple[str, ...] = ("bg", "en")) -> DataFrame:
    """Labelled queries {queries: [{query, lang, expected}]} as (query, lang, expected); another language or no expected id raises."""
    rows = spark.read.schema("queries array<struct<query:string, lang:string, expected:array<string>>>").json(path, multiLine=True).select(F.inline("queries"))
    bad = rows.where(~F.col("lang").isin(*languages) | F.coalesce(F.size("expected") < 1, F.lit(True)) | F.col("query").isNull()).limit(1).collect()
    if bad:
        raise ValueError(f"not a labelled query: {bad[0].asDict()}")
    return rows


def boundaries(spark: SparkSession, path: str) -> DataFrame:
    """Features of boundary files in GeoJSON: (feature, name, rings), rings of outer and inner lines alike; one without a name raises."""
    kind = "features array<struct<id:string, properties:struct<name:string>, geometry:struct<type:string, coordinates:string>>>"
    rows = spark.read.schema(kind).json(path, multiLine=True).select(F.inline("features"))
    one = F.from_json("geometry.coordinates", "array<array<array<double>>>")
    many = F.flatten(F.from_json("geometry.coordinates", "array<array<array<array<double>>>>"))
    out = rows.select(F.col("id").alias("feature"), F.col("properties.name").alias("name"), F.when(F.col("geometry.type") == "Polygon", one).otherwise(many).alias("rings"))
    if not out.where("name is null or rings is null").limit(1).isEmpty():
        raise ValueError("a boundary has no name or no rings")
    return out
