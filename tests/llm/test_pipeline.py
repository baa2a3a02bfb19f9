from __future__ import annotations

import itertools

import pytest
from conftest import SF
from test_ten import brute_lines, words

import corpus_pipeline
from civicspark.llm.decontamination import contaminated
from civicspark.llm.features import learnable
from civicspark.llm.quality_classifier import scores


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """documents and what each stage made of the one before, written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], SF).write.parquet(str(folder / name))
        out.append(spark.read.parquet(str(folder / name)))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_keep_the_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns


def test_classifier_keeps_what_scores(spark, steps):
    good = {r.doc_id for r in scores(steps[0], learnable(spark.read.parquet(f"{SF}/labels.parquet"))).where("score >= 0.3").collect()}
    assert set(rows(steps[1])) == good


def test_lines_go_and_emptied_documents_with_them(steps):
    before, after = rows(steps[1]), rows(steps[2])
    gone = brute_lines([(i, r.text) for i, r in before.items()])
    for i, r in before.items():
        text = "\n".join(x for k, x in enumerate((r.text or "").split("\n")) if (i, k) not in gone)
        if words(r.text) and not words(text):
            assert i not in after
        else:
            assert (after[i].text or "") == text and after[i].n_chars == len(text)


def test_one_document_of_each_group_stays(steps):
    def shingles(text):
        w = words("".join(c.lower() if c.isascii() else c for c in text or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(r.text) for i, r in rows(steps[2]).items()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert set(rows(steps[3])) == {i for i in sets if root(i) == i}


def test_contaminated_documents_go(spark, steps):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    bad = {r.doc_id for r in contaminated(steps[3], bench).collect()}
    assert set(rows(steps[4])) == set(rows(steps[3])) - bad
    texts = [" ".join(words(r.text)) for r in steps[4].collect()]
    assert not any(" ".join(words(b.text)) in t for b in bench.collect() for t in texts)


def test_all_that_is_left_is_packed(steps):
    packed = steps[5].toPandas()
    assert set(packed.doc_id) == set(rows(steps[4]))
    full = packed.groupby("sequence_id").length.sum()
    assert full.max() <= 2048 and len(full) <= full.sum() / 2048 + 2


def test_run_is_the_stages_in_a_row(spark, steps):
    key = lambda df: sorted((r.doc_id, r.piece, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(steps[5])


def test_stages_bear_extra_columns_and_empty_tables(spark, steps):
    docs = steps[0].selectExpr("*", "'x' as kept", "1L as id", "2 as label", "'y' as own").limit(30)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert set(docs.columns) == set(out.columns)
        assert stage(spark, docs.where("false"), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), SF).count() == 0
