"""Documents that share an id, or have none, though their texts differ."""

from __future__ import annotations

import random

import pytest
from test_ten import words

import corpus_pipeline
from civicspark.llm.minhash_dedup import near_duplicates
from civicspark.llm.line_dedup import remove_lines, removed_lines
from civicspark.llm.substring_dedup import remove_repeats

FIRST, SECOND = "a1 a2 a3 a4 a5 a6", "b1 b2 b3 b4 b5 b6"
#: A later line of a text without an id equals a line of another, which has fewer lines.
ROWS = [(None, f"{SECOND}\n\n{FIRST}"), (None, FIRST), (7, f"c1 c2 c3 c4 c5\n{FIRST}"), (7, "d1 d2 d3 d4 d5 d6 d7"), (8, f"x\ny\n{SECOND}")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string")


def test_lines_of_documents_with_one_id(docs):
    out = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_lines), r.removed) for r in removed_lines(docs).collect())
    # of the two texts without an id one keeps the line that both have
    assert sorted(x for (some, _, _), x in out if not some) in (["", "0"], ["", "2"])
    assert [x for x in out if x[0][0]] == [((True, 7, 1), ""), ((True, 7, 2), "1"), ((True, 8, 3), "2")]
    texts = [r.text for r in remove_lines(docs).collect()]
    for line in (FIRST, SECOND):
        assert sum(line in t.split("\n") for t in texts) == 1
    assert "d1 d2 d3 d4 d5 d6 d7" in texts and "x\ny" in texts


def test_repeats_of_documents_with_one_id(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    rows = [(None, f"only {passage} here"), (None, "t1 t2 t3"), (None, " ".join(f"q{i}" for i in range(40))), (3, f"r1 r2 r3 {passage}"), (3, " ".join(f"s{i}" for i in range(9)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.kept for r in remove_repeats(docs, 8).collect())
    assert kept == sorted(" ".join(w for w in words(t) if not w.startswith("p")) for _, t in rows)


def test_contaminated_document_goes_alone(spark, tmp_path):
    item = " ".join(f"item{i}" for i in range(30))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, f"some {item} text"), (None, "clean text without any item"), (5, item), (5, "another clean text"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = corpus_pipeline.benchmark_decontamination(spark, docs, str(tmp_path))
    assert sorted((str(r.doc_id), r.text or "") for r in out.collect()) == [("5", "another clean text"), ("6", ""), ("None", "clean text without any item")]


def test_links_of_documents_with_one_id(spark):
    """Rows of one id are one document: all its texts' links count, whichever row comes first."""
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(3000)]
    a, b, c, d = (" ".join(rng.choices(vocab, k=200)) for _ in range(4))
    near = lambda t, k: " ".join(w if i != k else "other" for i, w in enumerate(t.split()))
    rows = [(10, a), (10, b), (20, near(a, 50)), (30, near(b, 150)), (30, c), (5, near(c, 9)), (10, a), (40, d), (None, a), (None, d), (None, near(d, 3)), (40, ""), (50, None), (50, near(d, 100)), (60, "p q"), (61, "p q"), (61, "x y")]
    for parts in (1, 3, 7):
        out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), shingle=4).collect()
        assert len(out) == len(rows)
        found = {(r.doc_id, r.component_id, r.kept) for r in out}
        assert found == {(10, 5, False), (20, 5, False), (30, 5, False), (5, 5, True), (40, 40, True), (50, 40, False), (60, 60, True), (61, 60, False), (None, None, True)}
        assert sorted(r.n_shingles for r in out if r.doc_id == 40) == [0, 197] and sorted(r.n_shingles for r in out if r.doc_id == 61) == [1, 1]
