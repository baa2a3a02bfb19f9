from __future__ import annotations

import io
import json
import zipfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from civicspark.operators import curation
from civicspark.session import small_batches
from civicspark.sources import curated, files, portal


def held(spark, content: bytes, path="f"):
    return spark.createDataFrame([(path, len(content), bytearray(content))], "path string, length long, content binary")


def rows(text):
    return list(files.delimited(text))


def test_delimited_text():
    assert rows("a,b\r\n1,2\n") == [["a", "b"], ["1", "2"]]
    assert rows('a;b\n"x;y";"say ""hi"""\n') == [["a", "b"], ["x;y", 'say "hi"']]
    assert rows('a,b\n"two\nlines",x') == [["a", "b"], ["two\nlines", "x"]]
    assert rows("\na;b\n1;2") == [[""], ["a", "b"], ["1", "2"]]
    assert rows("a\tb\n1\t2\n\n") == [["a", "b"], ["1", "2"], [""]]
    assert rows('a,b\n1,"open') == [["a", "b"]]
    assert rows('a,b\n1x"y,z"w,2') == [["a", "b"], ["1xy,zw", "2"]]
    assert rows("") == []


def test_encodings(spark):
    cases = [(b"\xef\xbb\xbfa", None, ("utf-8", 1.0)), ("Привет".encode("cp1251"), None, ("cp1251", 0.8)), ("Привет".encode(), None, ("utf-8", 0.85)), (b"plain", None, ("utf-8", 1.0)), (b"x", "CP1251", ("cp1251", 0.95)), (b"\x80\x81", None, ("utf-8", 0.5)), (b"a" * 8192 + b"\xcf", None, ("utf-8", 1.0))]
    frame = spark.createDataFrame([(i, bytearray(b), d) for i, (b, d, _) in enumerate(cases)], "i int, c binary, d string")
    out = frame.orderBy("i").select(files.detected_encoding(F.col("c"), F.col("d")).alias("e")).collect()
    assert [tuple(r.e) for r in out] == [x for *_, x in cases]
    frame = spark.createDataFrame([(bytearray("Ёж".encode("cp1251") + b"\x90"), "cp1251"), (bytearray(b"\xef\xbb\xbfa"), "utf-8")], "c binary, e string")
    assert [r[0] for r in frame.select(files.decoded(F.col("c"), F.col("e"))).collect()] == ["Ёж�", "a"]


def test_csv_to_rows(spark):
    data = "id;име;x\n1;Иван;5\n2;;\n3;a;b;extra\n".encode("cp1251")
    out = files.table_rows(files.read_csv(held(spark, data))).orderBy("row_no", "position").collect()
    assert [(r.row_no, r.name, r.cell) for r in out] == [(0, "id", "1"), (0, "име", "Иван"), (0, "x", "5"), (1, "id", "2"), (1, "име", None), (1, "x", None), (2, "id", "3"), (2, "име", "a"), (2, "x", "b")]


def book() -> bytes:
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="One" r:id="r1"/><sheet name="Gone" r:id="r9"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r9" Target="worksheets/none.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>име</t></si><si><r><t>a</t></r><r><t>&amp;b</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>x</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2" t="b"><v>1</v></c><c r="C2"><v>45000</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_workbooks(spark):
    out = files.read_xlsx(held(spark, book())).orderBy("row_no", "position").collect()
    assert [(r.sheet, r.row_no, r.cell) for r in out] == [("One", 0, "име"), ("One", 0, ""), ("One", 0, "x"), ("One", 1, "a&b"), ("One", 1, "true"), ("One", 1, "45000")]
    assert files.read_xlsx(held(spark, b"PK broken")).first().row_no == -1


def test_two_row_headers():
    assert files.header_of([["G", "", "H"], ["a", "b", "c"], ["1", "2", "3"]]) == (["G a", "G b", "H c"], 2)
    assert files.header_of([["G", "", "H"], ["1", "2", "3"]]) == (["G", "", "H"], 1)
    assert files.header_of([["G", "", "H"], ["a", "b", "c"], ["x", "y", "z"]]) == (["G", "", "H"], 1)
    assert files.header_of([]) == ([], 0)


def test_envelope_equals_its_table(spark):
    table = [["id", "x"], ["1", "a,b"], ["2", None]]
    envelope = json.dumps({"success": True, "data": table}).encode()
    text = 'id,x\n1,"a,b"\n2,\n'.encode()
    cells = lambda df: sorted((r.row_no, r.name, r.cell) for r in files.table_rows(df).fillna("", ["cell"]).collect())
    assert cells(files.read_envelope(held(spark, envelope))) == cells(files.read_csv(held(spark, text)))


def test_documents(spark):
    geo = b'{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]},"properties":{"name":"x"}}]}'
    docs = files.documents(held(spark, geo), "geojson")
    assert docs.first().kind == "geojson"
    assert json.loads(files.features(docs).first().properties) == {"name": "x"}
    assert files.documents(held(spark, b'{"type":"Point"}'), "geojson").first().kind == "uncurated"
    assert files.documents(held(spark, b"{} {}"), "json").first().kind == "uncurated"
    assert files.documents(held(spark, b"<rows/>"), "xml").first().root == "rows"


def test_sinks(spark, tmp_path):
    cells = files.table_rows(files.read_csv(held(spark, b"a,b\n1,\n")))
    files.write_rows(cells, str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first().value) == {"a": "1", "b": None}
    two = held(spark, b"x").union(held(spark, b"x", "g"))
    assert files.blobs(two).count() == 1


def test_portal(spark, tmp_path):
    for n, ids in ((1, ["a", "b"]), (2, ["c"])):
        page = {"success": True, "result": {"count": 3, "results": [{"id": i, "title": i, "tags": [{"name": "t"}]} for i in ids]}}
        (tmp_path / f"page-{n}.json").write_text(json.dumps(page))
    spark.dataSource.register(portal.PortalSource)
    out = spark.read.format("civic_portal").options(count="3", pageSize="2", path=str(tmp_path)).load()
    assert sorted((r.id, r.tags[0]) for r in out.collect()) == [("a", "t"), ("b", "t"), ("c", "t")]


def test_answers_of_all_shapes(spark):
    shapes = {
        "table": ({"data": [["a", "b"], ["1", [1, None, True]], "x", [{"k": 1}, 2.0]]}, "tabular", None, None),
        "text": ({"data": "one\ntwo"}, "text", "one\ntwo", None),
        "empty text": ({"data": ""}, "text", "", None),
        "object": ({"data": {"a": 1.0, "b": [None, 1.5]}}, "json", '{\n  "a": 1,\n  "b": [\n    null,\n    1.5\n  ]\n}\n', "object"),
        "objects": ({"data": [{"a": "ж"}]}, "json", '[\n  {\n    "a": "ж"\n  }\n]\n', "array"),
        "scalars": ({"data": [1, ["x"]]}, "json", '[\n  1,\n  [\n    "x"\n  ]\n]\n', "array"),
        "number": ({"data": 5}, "json", "5\n", "object"),
        "null": ({"data": None}, "json", "[]\n", "array"),
        "absent": ({"success": True}, "json", "[]\n", "array"),
        "list": ([1], "json", "[]\n", "array"),
    }
    answers = None
    for name, (value, *_) in [*shapes.items(), ("broken", (None,)), ("nothing", (None,))]:
        one = held(spark, {"broken": b'{"data": [', "nothing": b"null"}.get(name) or json.dumps(value).encode(), name)
        answers = one if answers is None else answers.union(one)
    out = {r.path: (r.kind, r.body, r.root) for r in files.read_answers(answers).collect()}
    assert {k: v for k, v in out.items() if k in shapes} == {k: v[1:] for k, v in shapes.items()}
    assert out["broken"][0] == out["nothing"][0] == "uncurated"
    rows = sorted((r.row_no, r.name, r.cell) for r in files.table_rows(files.read_envelope(answers)).where("path = 'table'").collect())
    assert rows == [(0, "a", "1"), (0, "b", "1,,true"), (1, "a", "x"), (1, "b", None), (2, "a", "[object Object]"), (2, "b", "2")]
    _, states = curation.run_curation(files.read_envelope(answers), files.read_answers(answers))
    state = {r.path: (r.state, r.kind) for r in states.collect()}
    assert state == {k: ("curated", v[1]) for k, v in shapes.items()} | {"broken": ("uncurated", None), "nothing": ("uncurated", None)}


def test_cells_of_many_files_go_on_together_and_of_a_large_one_in_parts():
    import pyarrow as pa

    bodies = [f"a;b\n{i};{i + 1}" for i in range(500)] + ["x\n" + "\n".join(map(str, range(50_000))), "c;d\n" + "y" * (1 << 22) + ";z"]
    batch = pa.RecordBatch.from_arrays([pa.array([f"f{i}" for i in range(502)]), pa.array([b""] * 502), pa.array(bodies)], names=["path", "content", "text"])
    out = list(files._cells(lambda path, content, text: iter([("", files.delimited(text))]))(iter([batch])))
    assert 3 <= len(out) <= 6 and max(b.num_rows for b in out) <= files.CELLS_AT_ONCE
    cells = [r for b in out for r in b.to_pylist()]
    assert len(cells) == 500 * 4 + 50_001 + 4 and [r["cell"] for r in cells[:4]] == ["a", "b", "0", "1"] and cells[-1]["cell"] == "z"


def test_batches_of_long_texts_are_small(spark):
    small_batches(spark)
    sizes = spark.range(200).selectExpr("repeat(cast(id % 10 as string), 200000) as t").coalesce(1).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long")
    assert max(r.n for r in sizes.collect()) < 10_000_000


def test_a_task_lists_its_curated_parts_some_at_a_time(tmp_path, monkeypatch):
    monkeypatch.setattr(curated, "LISTED", 3)
    held, names = [], ["resource", "sheet", "kind", "row_no", "value"]
    monkeypatch.setattr(curated, "_part_rows", lambda parts, rows=curated._part_rows: held.append(len(parts)) or rows(parts))
    rows = [(f"r{i // 4}", "", "tabular", i % 4, f'"{i}"') for i in range(40)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[lo : lo + 7]]) for lo in range(0, 40, 7)]
    written = curated.CuratedWriter({"path": str(tmp_path), "partrows": "2"}).write(iter(batches))
    parts = pq.read_table(written.index).to_pylist()
    assert max(held) == 3 and sum(held) == len(parts) == 20
    assert [(p["resource"], line) for p in parts for line in open(p["file"]).read().split()] == [(r[0], r[4]) for r in rows]

    def broken():
        yield from batches[:4]
        raise OSError("lost")

    for path in tmp_path.rglob("*.*"):
        path.unlink()
    with pytest.raises(OSError, match="lost"):
        curated.CuratedWriter({"path": str(tmp_path), "partrows": "2"}).write(broken())
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]
