"""What line deduplication looks at, and that it still finds every line."""

import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from test_ten import brute_lines, words

from civicspark.llm import line_dedup as ld
from civicspark.llm import text as tx
from civicspark.llm.line_dedup import removed_lines


def batch(texts, **columns):
    return pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "key": [0] * len(texts), "text": texts, **columns})


def ranks(*tasks):
    rank = np.zeros((ld.BUCKETS // ld.CHUNK, ld.CHUNK), np.uint16)
    counted = [x for task in tasks for x in ld._counted(iter([task]))]
    for out in ld._ranked(iter(counted)):
        for chunk, own in zip(*(x.to_pylist() for x in out.columns), strict=True):
            rank[chunk] = np.frombuffer(own, np.uint16)
    return counted, rank.reshape(-1)


def test_a_task_counts_in_few_rows():
    one = batch([" ".join(f"w{i}" for i in range(20_000)), "w1 w2\nw1"])
    two = batch(["w1 w1", None, ""])
    counted, rank = ranks(one, two)
    assert [x.num_rows <= ld.BUCKETS // ld.CHUNK for x in counted] == [True, True]
    data, offsets = tx.texts(one)
    buckets = Counter(ld._bucket(tx.words(data, offsets).hashes).tolist())
    data, offsets = tx.texts(two)
    buckets.update(ld._bucket(tx.words(data, offsets).hashes).tolist())
    n = np.zeros(ld.BUCKETS, np.int64)
    n[list(buckets)] = list(buckets.values())
    assert (rank == ld._rank(n)).all()


def test_words_of_asked_lines_alone_are_hashed(monkeypatch):
    texts = ["a b a\n\nc d e\n", "", "x " * 500 + "\ny z\nq", None, "\n\nu v\n"]
    asked = [[2, 0], [], [1], None, [2]]
    hashed = []
    own = tx.words
    monkeypatch.setattr(tx, "words", lambda data, *a: hashed.append(len(data)) or own(data, *a))
    out = [r for x in ld._words_of(iter([batch(texts, lines=pa.array(asked, pa.list_(pa.int32())))])) for r in x.to_pylist()]
    assert sum(hashed) <= sum(len(texts[i].split("\n")[k]) + 1 for i, lines in enumerate(asked) for k in lines or [])
    assert [(r["id"], r["line"]) for r in out] == [(0, 2), (0, 0), (2, 1), (4, 2)]
    for r in out:
        line = texts[r["id"]].split("\n")[r["line"]].encode()
        hashes = np.unique(own(np.frombuffer(line, np.uint8), np.array([0, len(line)])).hashes)
        assert r["words"] == hashes.tobytes() and r["n"] == len(set(words(line.decode())))


def test_parity_bits_never_part_similar_lines():
    rng = np.random.default_rng(3)
    texts = []
    for n in (5, 40, 64, 65, 70, 300):
        base = [f"w{i}" for i in rng.integers(0, 10**6, n)]
        texts += [" ".join(base), " ".join(base[n // 10 :])]
    _, rank = ranks(batch(texts))
    out = [r for x in ld._lines(SimpleNamespace(value=rank), 80, 1024, 128)(iter([batch(texts, copy=list(range(len(texts))))])) for r in x.to_pylist()]
    assert all((r["wide"] == 0) == (r["n"] <= ld.WIDE) for r in out)
    bits = lambda x: (x & (2**64 - 1)).bit_count()
    apart = lambda x, y: bits(x["wide"] ^ y["wide"]) + bits(x["parity"] ^ x["wide"] ^ y["parity"] ^ y["wide"])
    for x, y in zip(out[::2], out[1::2], strict=True):
        assert bits(x["parity"] ^ y["parity"]) <= x["n"] - y["n"]
        assert min(x["n"], y["n"]) <= ld.WIDE or apart(x, y) <= x["n"] - y["n"]
    # of 300 and of 70 random words each, 64 bits part too few
    assert apart(out[8], out[10]) > 30


def test_repeated_rows_are_one_document(spark):
    rng = random.Random(9)
    rows = []
    for i in range(40):
        base = [f"v{rng.randrange(30)}" for _ in range(12)]
        near = [*base[:-1], f"u{i}"]
        rows.append((i if i % 8 else None, "\n".join([" ".join(base), "", " ".join(near), f"own{i}"][i % 2 :])))
        rows.append((100 + i, " ".join(near) + "\n" + " ".join(base[1:])))
    # of several texts without an id only the first is used, as brute force knows no keys
    rows = [x for k, x in enumerate(rows) if x[0] is not None or not k]
    gone = brute_lines(rows)
    for table in (rows, rows * 3):
        out = removed_lines(spark.createDataFrame(table, "doc_id long, text string").repartition(3)).collect()
        assert len(out) == len(table)
        assert {(-1 if r.doc_id is None else r.doc_id, int(k)) for r in out for k in r.removed.split(",") if k} == gone
