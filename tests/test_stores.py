"""What is stored and kept up under changes, against brute force."""

from __future__ import annotations

import itertools
import json
import os
import random

import pytest

from pyspark.sql import functions as F

from civicspark.operators import levels, linking, relinking
from civicspark.sources import curated


def brute_links(held, kinds, fanout):
    of = {}
    for dataset, entity in held:
        of.setdefault(entity, set()).add(dataset)
    return {(a, b, e, *linking.LINK_KINDS[kinds[e]]) for e, own in of.items() if len(own) <= fanout for a, b in itertools.combinations(sorted(own), 2)}


def test_links_under_changes_equal_links_from_scratch(spark, tmp_path):
    rng, path, held = random.Random(3), str(tmp_path / "links"), set()
    kinds = {f"e{k}": rng.choice(["tag", "group", "organization"]) for k in range(9)}
    schema = "dataset long, entity string, kind string, present boolean"
    for batch in range(9):
        # few datasets and a low cap: entities become hubs and cease to be
        rows = [(rng.randint(0, 9), rng.choice(list(kinds)), rng.random() < (0.85 if batch % 3 else 0.3)) for _ in range(rng.choice([0, 3, 30]))]
        frame = [(d, e, kinds[e], p) for d, e, p in rows] + [(None, "e1", "tag", True), (1, None, "tag", True)]
        relinking.apply_changes(spark.createDataFrame(frame, schema).repartition(2), path, batch, buckets=4, fan=3, fanout=4)
        have, lose = ({(d, e) for d, e, p in rows if p is want} for want in (True, False))
        held = (held - lose) | have
        assert len(levels.manifest(spark, path)["folders"]) <= 4
        if batch in (0, 2, 4, 5, 8):
            out = relinking.current_links(spark, path).collect()
            assert len(out) == len(set(out)) and {(r.a, r.b, r.via, r.heuristic, r.confidence) for r in out} == brute_links(held, kinds, 4), batch
    # a batch that is committed is not done again, and one that changes nothing touches nothing
    relinking.apply_changes(spark.createDataFrame([(99, "e1", "tag", True), (98, "e1", "tag", True)], schema), path, 8)
    same = spark.createDataFrame([(d, e, kinds[e], True) for d, e in held], schema)
    relinking.apply_changes(same, path, 9, fan=99)
    newest = levels.manifest(spark, path)["folders"][-1][0]
    for part in ("attachments", "links"):
        assert levels.read(spark, path, part, {}, {"attachments": relinking._ATTACHMENTS, "links": relinking._LINKS}[part].format("long"), [newest]).count() == 0
    assert {(r.a, r.b, r.via, r.heuristic, r.confidence) for r in relinking.current_links(spark, path).collect()} == brute_links(held, kinds, 4)


def test_a_change_reads_its_buckets_alone(spark, tmp_path):
    path, schema = str(tmp_path / "links"), "dataset long, entity string, kind string, present boolean"
    relinking.apply_changes(spark.createDataFrame([(d, f"e{e}", "tag", True) for d in range(3) for e in range(40)], schema), path, 0, buckets=8)
    state = levels.manifest(spark, path)
    rows = levels.read(spark, path, "attachments", state, relinking._ATTACHMENTS.format("long"))
    (bucket,) = rows.where("entity = 'e7'").select("bucket").first()
    one = rows.where(rows.bucket.isin([bucket]))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and one.select(F.input_file_name()).distinct().count() == 1


def test_links_are_kept_in_rows_of_datasets(spark, tmp_path):
    """What a batch writes grows with what is attached, not with its square, and hubs cost a row."""
    path, schema = str(tmp_path / "links"), "dataset long, entity string, kind string, present boolean"
    rows = [(d, e, kind, True) for e, n, kind in (("many", 40, "tag"), ("hub", 60, "tag"), ("one", 1, "tag")) for d in range(n)] + [(0, "two", "tag", True), (7, "two", "group", True)]
    relinking.apply_changes(spark.createDataFrame(rows, schema), path, 0, buckets=4)
    state = levels.manifest(spark, path)
    assert levels.read(spark, path, "links", state, relinking._LINKS.format("long")).count() == 40 + 1 + 1 + 2
    out = relinking.current_links(spark, path).collect()
    assert len(out) == 40 * 39 // 2 + 1 and [(r.a, r.b, r.heuristic, r.confidence) for r in out if r.via == "two"] == [(0, 7, "shared_tag", 0.5)]
    with pytest.raises(ValueError, match="layout"):
        levels.commit(spark, path, {**state, "own": {k: v for k, v in state["own"].items() if k != "layout"}})
        relinking.current_links(spark, path)


def test_pages_of_written_files_equal_slices(spark, tmp_path):
    path = str(tmp_path / "store")
    sizes = {"a": 25, "b": 3, "c/d": 7}
    values = {r: [{"id": str(k), "x": None if k % 3 else f"é \\n {k}"} for k in range(n)] for r, n in sizes.items()}
    cells = [(r, s, k, n, v) for r, rows in values.items() for s in ("", "s2") if s == "" or r == "b" for k, row in enumerate(rows) for n, v in row.items()]
    cells = spark.createDataFrame(cells, "path string, sheet string, row_no int, name string, cell string").repartition(3)
    docs = [("j", "json", json.dumps([{"k": i} for i in range(11)])), ("o", "json", '{\n "k": 1}'), ("x", "xml", "<a>\n</a>"), ("t", "text", ""), ("l", "json", "[]")]
    docs = spark.createDataFrame(docs, "path string, kind string, body string")
    curated.write_curated(curated.table_values(cells).unionByName(curated.document_values(docs)), path, 0, part_rows=4)
    names = {r: spark.range(1).select(curated.fx.safe_segment(F.lit(r))).first()[0] for r in [*sizes, *"joxtl", "none"]}
    asked = [(r, None, o, n) for r in ("a", "b", "c/d", "none") for o, n in ((0, 100), (0, 4), (3, 5), (24, 1), (24, 9), (99, 2), (-5, 0))] + [("j", None, 3, 4), ("o", None, 0, 9), ("x", None, 0, 9), ("t", None, 0, 9), ("b", "s2", 1, 1)]
    frame = spark.createDataFrame([(names[r], s, o, n) for r, s, o, n in asked], "resource string, sheet string, offset int, limit int")
    out = {}
    for r in curated.pages(spark, path, frame).collect():
        out.setdefault((r.resource, r.sheet, r.offset, r.limit), []).append((r.position, r.value, r.total, r.truncated))
    for r, sheet, offset, limit in asked:
        o, n = max(offset, 0), min(max(limit, 1), 1000)
        found = sorted(out.pop((names[r], sheet or "", o, n), []))
        if r in sizes:
            expected = [(k, row, sizes[r], o + n < sizes[r]) for k, row in enumerate(values[r])][o : o + n]
            assert [(k, json.loads(v), t, x) for k, v, t, x in found] == expected, (r, o, n)
        elif r == "j":
            assert [(k, json.loads(v), t, x) for k, v, t, x in found] == [(k, {"k": k}, 11, True) for k in range(3, 7)]
        else:
            assert found == {"o": [(0, '{\n "k": 1}', 1, False)], "x": [(0, "<a>\n</a>", 0, False)], "t": [(0, "", 0, False)], "none": []}[r]
    assert not out
    # a page opens the parts that hold it
    parts = curated.asked_parts(spark, path, spark.createDataFrame([("a", 9, 4)], "resource string, offset int, limit int")).collect()
    assert sorted((r.begin, r.skip, r.take) for r in parts) == [(8, 1, 3), (12, 0, 1)]
    schema = curated.schemas(spark, path, spark.createDataFrame([("b",)], "resource string")).collect()
    assert sorted((r.sheet, json.loads(r.schema)["columns"], json.loads(r.schema)["rows"]) for r in schema) == [("", ["id", "x"], 3), ("s2", ["id", "x"], 3)]
    # written again, a resource has its new rows alone; others stay; merges change nothing
    for batch in range(1, 6):
        new = spark.createDataFrame([("a", "", 0, "id", str(batch))], "path string, sheet string, row_no int, name string, cell string")
        curated.write_curated(curated.table_values(new), path, batch, fan=3)
    curated.write_curated(curated.table_values(cells), path, 5)
    asked = spark.createDataFrame([("a",), ("b",)], "resource string")
    assert sorted((r.resource, r.value, r.total) for r in curated.pages(spark, path, asked).collect()) == sorted([("a", '{"id":"5"}', 1)] + [("b", json.dumps(v, ensure_ascii=False, separators=(",", ":")), 3) for v in values["b"]])


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    spark.dataSource.register(curated.CuratedSink)
    rows = spark.range(0, 40, 1, 4).select(F.lit("r").alias("resource"), F.lit("").alias("sheet"), F.lit("tabular").alias("kind"), F.col("id").alias("row_no"), F.when(F.col("id") != 25, F.col("id").cast("string")).alias("value"))
    with pytest.raises(Exception):
        rows.write.format("civic_curated").mode("append").option("path", path).save()
    left = [f for d, _, names in os.walk(path) for f in names]
    assert not [f for f in left if f == "commit"] and levels.manifest(spark, path)["version"] < 0
    assert curated.pages(spark, path, spark.createDataFrame([("r",)], "resource string")).count() == 0
    assert not [f for f in left if f.startswith("part-") and "-00000002" in f]


def test_blobs_are_written_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"x")), ("c", bytearray(b""))], "path string, content binary")
    out = curated.write_blobs(rows, str(tmp_path)).collect()
    before = {f: os.stat(tmp_path / f).st_mtime_ns for f in {r.file for r in out}}
    assert len(before) == 2 and {r.path: r.bytes for r in out} == {"a": 1, "b": 1, "c": 0}
    curated.write_blobs(rows, str(tmp_path))
    assert {f: os.stat(tmp_path / f).st_mtime_ns for f in before} == before and os.listdir(tmp_path / "aside") == []


def test_what_a_task_takes_at_once_does_not_grow(spark, tmp_path, monkeypatch):
    """Postings by blocks of words, ranges by their number, links by parts of a bucket."""
    import numpy as np
    import pyarrow as pa

    from civicspark.operators import keyword_index, relinking

    monkeypatch.setattr(keyword_index, "WORDS", 10)
    monkeypatch.setattr(keyword_index, "RANGE", 50)
    texts = [" ".join(f"w{(i * j) % 7}" for j in range(i % 25)) for i in range(60)]
    words = pa.array([x.split() for x in texts], pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(60)), pa.array(np.arange(60)), words], names=["key", "doc", "words"])
    out = list(keyword_index._postings(0, iter([batch])))
    assert max(b.column("tf").to_numpy().sum() for b in out) <= 24 and len(out) > 30
    found = {(r["key"], r["term"]): np.cumsum(r["gaps"]).tolist() for b in out for r in b.to_pylist() if r["term"]}
    assert found == {(i, w): [k for k, x in enumerate(t.split()) if x == w] for i, t in enumerate(texts) for w in set(t.split())}
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    keyword_index.write_batch(docs, str(tmp_path / "index"), 0, "id", "text", ranges=2)
    assert len(list((tmp_path / "index" / "postings" / "folder=0").glob("part-*.parquet"))) > 4
    assert keyword_index.search(spark, str(tmp_path / "index"), "id", "w1").count() == min(50, sum("w1" in t.split() for t in texts))
    monkeypatch.setattr(relinking, "PART", 20)
    rows = spark.range(300).selectExpr("id AS dataset", "concat('e', id % 60) AS entity", "'tag' AS kind", "true AS present")
    relinking.apply_changes(rows, str(tmp_path / "links"), 0, buckets=2)
    assert relinking.current_links(spark, str(tmp_path / "links")).count() == 60 * 10
    assert max(len(list(b.glob("part-*.parquet"))) for b in (tmp_path / "links" / "links" / "folder=0").glob("bucket=*")) > 4


def test_an_index_is_shuffled_in_passes_that_leave_nothing(spark, tmp_path, monkeypatch):
    """Passes hold all postings once, by beginnings of the terms' order, and no shuffle stays on disk after its pass."""
    from civicspark.operators import keyword_index

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    texts = {i: " ".join(f"w{(i * j) % 23}" for j in range(i % 40)) for i in range(90)}
    path, before = str(tmp_path / "index"), shuffled()
    setting = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    monkeypatch.setattr(keyword_index, "PASS", 100)
    for batch in range(2):  # two folders, merged
        docs = spark.createDataFrame([(i, t) for i, t in texts.items() if i % 2 == batch], "id int, text string")
        keyword_index.write_batch(docs, path, batch, "id", "text", ranges=2, fan=2)
    assert not shuffled() - before and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    (number, level), = levels.manifest(spark, path)["folders"]
    rows = spark.read.parquet(f"{path}/postings/folder={number}").withColumn("file", F.input_file_name())
    assert level == 1 and sorted((r.term, r.key, r.tf) for r in rows.collect()) == sorted([("", i, 0) for i in texts] + [(w, i, t.split().count(w)) for i, t in texts.items() for w in set(t.split())])
    files = sorted((r.lo, r.hi) for r in rows.groupBy("file").agg(F.min("term").alias("lo"), F.max("term").alias("hi")).collect())
    assert len(files) >= 5 and all(x[1] <= y[0] for x, y in itertools.pairwise(files))
    assert keyword_index.search(spark, path, "id", "w1").count() == min(50, sum("w1" in t.split() for t in texts.values()))
