"""Curation of tables: column types by vote, cells cast by type, names told apart."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicspark.functions import text as fx


def vote(cells: DataFrame, key: Sequence[str], cell: str) -> DataFrame:
    """A type for each key of (key, cell): what at least 9 in 10 cells that aren't blank read as.

    Dates come before numbers, numbers before booleans; `1` and `0` are integers.
    Confidence is 0.95 when all cells agree, 0.8 below that, 0.7 for text and 0.5
    without cells.
    """
    x = F.col(cell)
    blank = x.isNull() | (fx.trimmed(x) == "")
    date = fx.date_value(x).isNotNull()
    rule = F.when(~date, fx.decimal_rule(x))
    boolean = ~date & rule.isNull() & fx.boolean_value(x).isNotNull()
    counts = cells.groupBy(*key).agg(
        F.count_if(~blank).alias("n"), F.bool_or(blank).alias("nullable"), F.count_if(~blank & date).alias("dates"),
        F.count_if(rule == "integer").alias("ints"), F.count_if(rule.isNotNull()).alias("nums"), F.count_if(boolean).alias("bools"))
    kinds = [("dates", "datetime"), ("ints", "integer"), ("nums", "decimal"), ("bools", "boolean")]
    wins = [F.when((F.col("n") > 0) & (F.col(c) >= F.col("n") * 0.9), F.struct(F.lit(t).alias("type"), F.when(F.col(c) == F.col("n"), 0.95).otherwise(0.8).alias("confidence"))) for c, t in kinds]
    text = F.struct(F.lit("string").alias("type"), F.when(F.col("n") == 0, 0.5).otherwise(0.7).alias("confidence"))
    return counts.select(*key, F.coalesce(*wins, text).alias("v"), "nullable").select(*key, "v.type", "v.confidence", "nullable")


def cast_cell(cell: Column, type_: Column) -> Column:
    """struct(value, raw): the cell in its column's type, as text that casts without loss; uncastable cells keep their trimmed text."""
    raw = fx.trimmed(cell)
    number = fx.decimal_value(cell)
    value = (
        F.when(type_ == "datetime", fx.date_value(cell)).when(type_.isin("integer", "decimal"), number.cast("string"))
        .when(type_ == "boolean", fx.boolean_value(cell).cast("string")).otherwise(raw)
    )
    return F.when(cell.isNull() | (raw == ""), F.lit(None)).otherwise(F.struct(F.coalesce(value, raw).alias("value"), raw.alias("raw"), value.isNotNull().alias("cast")))


def curate(cells: DataFrame, key: Sequence[str], column: str, cell: str) -> DataFrame:
    """Vote on each column of tables in long form, then cast every cell by its column's type."""
    types = vote(cells, [*key, column], cell).select(*key, column, "type")
    rows = cells.join(types, [*key, column])
    return rows.withColumn("cell", cast_cell(F.col(cell), F.col("type")))


def told_apart(names: DataFrame, key: Sequence[str], candidate: str, position: str) -> DataFrame:
    """Suffix equal names within a key: name, name_1, name_2 in order of position.

    A suffixed name that collides with another column's own name moves on to the
    next number nobody has.  Only names that are equal once their numbers go can
    collide: where all of these are equal their numbers are their turns, the others
    are gone through in order, in tasks that keep a number for each distinct name.
    A null name stays null.
    """
    root = F.regexp_replace(F.col(candidate), r"(_[0-9]+)+$", "")
    rows = names.select(*key, F.col(position), F.col(candidate).alias("_name"), root.alias("_root"))
    at = [*key, "_root"]
    mixed = rows.groupBy(*at).agg((F.min("_name") != F.max("_name")).alias("_mixed"))
    same = F.lit(True)
    for c in at:
        same = same & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    rows = rows.alias("x").join(mixed.alias("y"), same).select("x.*", F.coalesce("y._mixed", F.lit(False)).alias("_mixed"))
    turn = F.row_number().over(Window.partitionBy(*key, "_name").orderBy(position)) - 1
    plain = rows.where("not _mixed").withColumn("_turn", turn).select(*key, position, F.when(F.col("_turn") == 0, F.col("_name")).otherwise(F.concat("_name", F.lit("_"), "_turn")).alias("name"))
    kinds = dict(names.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*key, position)) + ", name string"
    others = rows.where("_mixed").repartition(*at).sortWithinPartitions(*at, position, "_name").select(*at, position, "_name")
    return plain.unionByName(others.mapInArrow(_numbered_names(len(at)), schema))


def _numbered_names(keys: int):
    """Names in order of their groups: the first number that nobody in the group has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, turns = None, {}

        def taken(made: str) -> bool:
            stem, _, number = made.rpartition("_")
            return made in turns or (number.isascii() and number.isdecimal() and number[0] != "0" and int(number) < turns.get(stem, 0))

        for batch in batches:
            out = []
            for *now, name in zip(*(batch.column(i).to_pylist() for i in range(keys)), batch.column(keys + 1).to_pylist(), strict=True):
                if now != group:
                    group, turns = now, {}
                # a name and all its numbers below its turn are taken
                turn = turns.get(name, 0)
                while taken(made := f"{name}_{turn}" if turn else name):
                    turn += 1
                turns[name] = turn + 1
                out.append(made)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(keys - 1)), batch.column(keys), pa.array(out, pa.string())], names=[*batch.schema.names[: keys - 1], batch.schema.names[keys], "name"])

    return run


def unique_slugs(rows: DataFrame, base: str, order: Sequence[str]) -> DataFrame:
    """Slugs told apart from the second on: slug, slug-2, slug-3."""
    turn = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    return rows.withColumn("slug", F.when(turn == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), turn)))


#: Curators in the order they are tried, by the kinds of file they take.
CURATORS = {"datastore": ["datastore"], "csv": ["tabular"], "xlsx": ["workbook"], "geojson": ["geojson"], "json": ["json", "geojson"], "xml": ["xml"], "text": ["tabular", "workbook", "geojson", "json", "xml", "text", "datastore"]}


def curator(preferred: Column, kind: Column) -> Column:
    """The curator of a file: the preferred one if it can take the sniffed kind, else the first in order that can."""
    can = {name: kind.isin(kinds) for name, kinds in CURATORS.items()}
    chosen = F.coalesce(*[F.when((preferred == name) & ok, name) for name, ok in can.items()])
    return F.coalesce(chosen, *[F.when(ok, name) for name, ok in can.items()])


def sheet_slugs(sheets: DataFrame, key: Sequence[str], name: str, position: str) -> DataFrame:
    """Slugs of a workbook's sheets told apart by -1, -2 in order of position: (key, position, slug)."""
    base = F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    rows = sheets.withColumn("_slug", F.when(base == "", "sheet").otherwise(base))
    turn = F.row_number().over(Window.partitionBy(*key, "_slug").orderBy(position)) - 1
    return rows.select(*key, position, F.when(turn == 0, F.col("_slug")).otherwise(F.concat("_slug", F.lit("-"), turn)).alias("slug"))


def run_curation(cells: DataFrame, documents: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Cells of many files (path, sheet, row_no, position, cell) to typed rows and a row for each file.

    documents: (path, kind, body), what whole files are curated as; a file of the kind
    `tabular` has its rows in cells, one that is `uncurated` its error in body.  A
    file that could not be read (row -1, or `uncurated`) stops nothing.  Rows: (path,
    sheet, row_no, name, cell); files: (path, state, error, rows[, kind]).
    """
    from civicspark.sources.files import table_rows

    failed = cells.where("row_no < 0").select("path", F.col("cell").alias("error"))
    if documents is not None:
        failed = failed.unionByName(documents.where("kind = 'uncurated'").select("path", F.col("body").alias("error")))
    errors = failed.groupBy("path").agg(F.min("error").alias("error"), F.lit(True).alias("failed"))
    tables = table_rows(cells.where("row_no >= 0").join(errors, "path", "left_anti"))
    rows = curate(tables, ["path", "sheet"], "name", "cell")
    counts = rows.groupBy("path").agg(F.count_distinct("sheet", "row_no").alias("rows"))
    seen = cells.select("path", F.lit("tabular").alias("kind"))
    if documents is not None:
        seen = seen.unionByName(documents.select("path", "kind"))
    seen = seen.groupBy("path").agg(F.max("kind").alias("kind"))
    files = seen.join(errors, "path", "left").join(counts, "path", "left")
    state = F.when(F.col("failed"), "uncurated").otherwise("curated")
    kind = [] if documents is None else [F.when(F.col("failed").isNull(), F.col("kind")).alias("kind")]
    return rows, files.select("path", state.alias("state"), "error", F.coalesce("rows", F.lit(0)).alias("rows"), *kind)


#: How the files of a curator are read: as cells, or whole.
_TABLES = ("csv", "xlsx", "datastore")


def curate_files(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One run over files of all kinds: (path, content, curator) to typed rows, whole documents (path, kind, body, root) and a row for each file.

    curator: csv, xlsx, datastore (portal answers), json, geojson, xml or text; another one leaves the file uncurated.
    """
    from civicspark.sources import files as source

    of = lambda name: files.where(F.col("curator") == name).drop("curator")
    cells = source.read_csv(of("csv")).unionByName(source.read_xlsx(of("xlsx"))).unionByName(source.read_envelope(of("datastore")).where("row_no >= 0"))
    tables = files.where(F.col("curator").isin("csv", "xlsx")).select("path", F.lit("tabular").alias("kind"), F.lit(None).cast("string").alias("body"), F.lit(None).cast("string").alias("root"))
    documents = tables.unionByName(source.read_answers(of("datastore")))
    for kind in ("geojson", "json", "xml", "text"):
        documents = documents.unionByName(source.documents(of(kind), kind))
    unknown = files.where(~F.coalesce(F.col("curator").isin(*_TABLES, "geojson", "json", "xml", "text"), F.lit(False)))
    none = unknown.select("path", F.lit("uncurated").alias("kind"), F.lit("no curator takes it").alias("body"), F.lit(None).cast("string").alias("root"))
    documents = documents.unionByName(none)
    rows, states = run_curation(cells, documents)
    return rows, documents.where("kind not in ('tabular', 'uncurated')"), states
