from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from civicspark.operators import crawl, embedding, keyword_index, retrieval, serving
from civicspark.sources import files

DOCS = [(1, "the red fox"), (2, "The fox. the FOX!"), (3, None), (4, "dogs only"), (5, "a fox, red as the sun is red")]


def test_keyword_index_equals_a_search_of_the_texts(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "id int, body string")
    keyword_index.write_batch(docs.where("id < 5").union(spark.createDataFrame([(5, "old fox")], "id int, body string")), str(tmp_path / "i"), 0, "id", "body", ranges=3)
    more = spark.createDataFrame([(6, "to go")], "id int, body string")
    keyword_index.write_batch(docs.where("id = 5").union(more), str(tmp_path / "i"), 1, "id", "body", ranges=3)
    keyword_index.write_batch(docs.where("false"), str(tmp_path / "i"), 2, "id", "body", gone=more, ranges=3)
    keyword_index.rebuild(spark, str(tmp_path / "i"), str(tmp_path / "j"), "id", ranges=2)
    for query in ("fox", "red fox", "fox nothing", "go", "the fox"):
        want = [(r.id, round(r.score, 9), r["rank"]) for r in retrieval.bm25(docs, "id", "body", query).orderBy("rank").collect()]
        for folder in "ij":
            found = keyword_index.search(spark, str(tmp_path / folder), "id", query).orderBy("rank").collect()
            assert [(r.id, round(r.score, 9), r["rank"]) for r in found] == want, (query, folder)


def test_postings_are_read_by_term_alone(spark, tmp_path):
    keyword_index.write_batch(spark.createDataFrame(DOCS, "id int, body string"), str(tmp_path / "i"), 0, "id", "body")
    plan = keyword_index.search(spark, str(tmp_path / "i"), "id", "fox")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,fox)" in plan or "In(term, [fox])" in plan


def test_embedding_retries_and_salvages(spark):
    def flaky(texts):
        if len(texts) > 1 and "drop" in texts:
            return [[1.0]]
        if "never" in texts:
            raise embedding.Busy
        return [[float(len(t))] for t in texts]

    rows = [(1, "a"), (2, "drop"), (3, " "), (4, None), (5, "never")]
    out = {r.id: (r.vector, r.sent) for r in embedding.embedded(spark.createDataFrame(rows, "id int, body string").coalesce(1), "id", "body", flaky, wait=0.0).collect()}
    assert out == {1: ([1.0], 1), 2: ([4.0], 1), 3: (None, 0), 4: (None, 0), 5: (None, 1)}
    assert {r.id: r.sent for r in embedding.embedded(spark.createDataFrame(rows[:1] * 3, "id int, body string").coalesce(1), "id", "body", flaky, batch=2).collect()} in ({1: 2}, {1: 1})
    assert embedding.embedded(spark.createDataFrame([], "id int, body string"), "id", "body", flaky).count() == 0


def test_scopes_that_cannot_be_asked_for_raise():
    assert crawl.supported({"tags": ["x"], "years": []}) == {"tags": ["x"], "years": []}
    with pytest.raises(ValueError, match="years"):
        crawl.supported({"tags": ["x"], "years": ["1999"]})


def test_numbering_equals_a_sort(spark):
    keys = spark.range(1000).select(F.xxhash64("id").alias("k"))
    out = [r.k for r in crawl.numbered(keys, "k", "p").orderBy("p").collect()]
    assert out == sorted(out) and len(out) == 1000


def test_query_sets_and_boundaries(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps({"queries": [{"query": "q", "lang": "bg", "expected": ["a"]}]}))
    bad.write_text(json.dumps({"queries": [{"query": "q", "lang": "fr", "expected": ["a"]}]}))
    assert files.query_set(spark, str(good)).first().expected == ["a"]
    with pytest.raises(ValueError):
        files.query_set(spark, str(bad))
    square = [[[0, 0], [4, 0], [4, 4], [0, 4]], [[1, 1], [3, 1], [3, 3], [1, 3]]]
    shape = {"features": [{"id": "a", "properties": {"name": "A"}, "geometry": {"type": "Polygon", "coordinates": square}}, {"id": "b", "properties": {"name": "B"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[9, 9], [10, 9], [9, 10]]]]}}]}
    (tmp_path / "geo.json").write_text(json.dumps(shape))
    rows = {r.name: r.rings for r in files.boundaries(spark, str(tmp_path / "geo.json")).collect()}
    assert rows["A"] == square and len(rows["B"]) == 1
    shapes = [(n, [[tuple(p) for p in ring] for ring in rings]) for n, rings in sorted(rows.items())]
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 2.0), (3, 9.2, 9.2), (4, 3.5, 3.5)], "id int, x double, y double")
    found = {r.id: (r["shape"], r.inside) for r in serving.located(points, shapes).collect()}
    assert found == {1: ("A", True), 2: ("A", False), 3: ("B", True), 4: ("A", True)}  # the second is in A's hole


def test_alerts_are_delivered_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5), (2, 0.6)], "id int, rate double")
    assert [r.id for r in serving.deliver(rows, lambda row: row["id"] == 1, str(tmp_path / "sent"), "id").collect()] == [1]
    assert [r.id for r in serving.deliver(rows, lambda row: True, str(tmp_path / "sent"), "id").collect()] == [2]


def brute_search(docs, query, depth=50):
    """(id, score, rank) of BM25 over word lists; tokens with inner punctuation are phrases, those that end in * beginnings."""
    import re
    from math import log

    words = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in docs.items()}
    mean = sum(map(len, words.values())) / max(len(words), 1)
    slots, phrases = [], []
    for token in query.split():
        own = re.findall(r"[^\W_]+", token.lower())
        begin = token.endswith("*") and len(own) == 1
        slots += [x for x in ((w, begin) for w in own) if x not in slots]
        phrases += [own] if len(own) > 1 else []
    tf = {i: [sum(x.startswith(s) if begin else x == s for x in w) for s, begin in slots] for i, w in words.items()}
    df = [sum(t[k] > 0 for t in tf.values()) for k in range(len(slots))]
    hits = []
    for i, t in tf.items():
        w = words[i]
        if slots and all(t) and all(any(w[k : k + len(p)] == p for k in range(len(w))) for p in phrases):
            hits.append((-sum(log((len(words) - d + 0.5) / (d + 0.5) + 1) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(w) / mean)) for n, d in zip(t, df)), i))
    return [(i, pytest.approx(-s), k) for k, (s, i) in enumerate(sorted(hits)[:depth], 1)]


QUERIES_OF_INDEX = ["w1", "w1 w2", "w1-w2", "w3.w1 w2", "w1-w2-w3", "w*", "w1* w2", "w1* w1-w2", "none", "none-w1", "", "  ", "*", "W5!", "w0 w1 w2 w3"]


def test_index_of_many_changes_equals_brute_force(spark, tmp_path):
    """Twelve batches of additions, replacements and removals, merged by levels of three; every state, and a rebuilt one, is searched."""
    import random

    from civicspark.operators import levels

    rng, path, docs = random.Random(5), str(tmp_path / "i"), {}
    text = lambda: rng.choice([None, "", " ".join(rng.choices([f"w{k}" for k in range(12)], k=rng.randint(1, 25)))])
    for batch in range(12):
        new = {rng.randint(0, 60): text() for _ in range(rng.choice([0, 6, 25]))}
        gone = [rng.randint(0, 60) for _ in range(rng.choice([0, 0, 8]))]
        gone = [i for i in gone if i not in new]
        frame = spark.createDataFrame(list(new.items()), "id long, body string").repartition(2)
        out = spark.createDataFrame([(i,) for i in gone * 2], "id long")
        keyword_index.write_batch(frame, path, batch, "id", "body", gone=out if gone else None, ranges=3, fan=3)
        docs = {i: t for i, t in docs.items() if i not in gone} | new
        state = levels.manifest(spark, path)
        assert state["own"]["n"] == len(docs) and len(state["folders"]) <= 6
        if batch in (0, 4, 7, 11):
            for query in QUERIES_OF_INDEX:
                found = keyword_index.search(spark, path, "id", query).orderBy("rank").collect()
                assert [tuple(r) for r in found] == brute_search(docs, query), (batch, query)
    # a batch that is committed is not done again
    keyword_index.write_batch(spark.createDataFrame([(1, "zzz")], "id long, body string"), path, 11, "id", "body")
    assert keyword_index.search(spark, path, "id", "zzz").count() == 0
    keyword_index.rebuild(spark, path, str(tmp_path / "j"), "id", ranges=2)
    for query in QUERIES_OF_INDEX:
        assert [tuple(r) for r in keyword_index.search(spark, str(tmp_path / "j"), "id", query).orderBy("rank").collect()] == brute_search(docs, query)


def test_index_refuses_keys_that_are_none_or_twice(spark, tmp_path):
    for rows in ([(1, "a"), (1, "b")], [(None, "a")]):
        with pytest.raises(ValueError):
            keyword_index.write_batch(spark.createDataFrame(rows, "id long, body string"), str(tmp_path / "i"), 0, "id", "body")
    assert keyword_index.search(spark, str(tmp_path / "i"), "id", "a").count() == 0
    # a writer that died left no trace in what is read
    keyword_index.write_batch(spark.createDataFrame([(1, "a")], "id long, body string"), str(tmp_path / "i"), 0, "id", "body")
    assert [r.id for r in keyword_index.search(spark, str(tmp_path / "i"), "id", "a").collect()] == [1]


def test_cyrillic_letters_are_looked_for_where_their_bytes_are(spark):
    texts = ["plain", "straße, señor, Ωmega", "еxample", "ѣ", "Ѣ", "Я", "ы э ѐ і", "ѿ Ҁ", "日本", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    out = rows.select("i", serving.has_cyrillic(F.col("t")).alias("c"))
    wanted = [None if t is None else any(c in serving.CYRILLIC.strip("[]") for c in t) for t in texts]
    assert [r.c for r in out.orderBy("i").collect()] == wanted and True in wanted
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert -1 < plan.lower().find("contains(") < plan.lower().find("rlike")
