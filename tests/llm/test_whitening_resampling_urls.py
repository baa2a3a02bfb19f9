"""Embedding whitening, importance resampling and URL filters against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from civicspark.llm import queries, urls
from civicspark.llm import text as tx
from civicspark.llm.resampling import bucket_counts, resample
from civicspark.llm.whitening import eigen, leading, tridiagonal, whiten

# ---- embedding whitening


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_eigenvectors_equal_lapack(n):
    random_ = np.random.default_rng(n)
    a = random_.normal(size=(n, n))
    a = a @ a.T
    values, found = eigen(a, 4)
    w = np.linalg.eigvalsh(a)[::-1][:4]
    assert np.allclose(values, w, rtol=1e-12, atol=1e-12 * w[0])
    assert np.allclose(found @ found.T, np.eye(len(found)), atol=1e-12)
    assert np.abs(a @ found.T - found.T * values).max() < 1e-12 * max(1, w[0]) * n


def test_equal_and_close_eigenvalues_have_orthogonal_vectors():
    q, _ = np.linalg.qr(np.random.default_rng(3).normal(size=(30, 30)))
    for w in ([5.0] * 6 + [1.0] * 24, [5, 5 - 1e-12, 5 - 2e-12, 5 - 1e-9] + [2.0] * 26, [0.0] * 30, [1e-150] * 30):
        values, found = eigen((q * np.array(w)) @ q.T, 5)
        assert np.allclose(values, sorted(w)[::-1][:5], atol=1e-12)
        assert np.allclose(found @ found.T, np.eye(5), atol=1e-10)
        assert np.abs(((q * np.array(w)) @ q.T) @ found.T - found.T * values).max() < 1e-12 * 5
    diagonal, off, mirrors = tridiagonal(np.diag([3.0, 1.0, 2.0]))
    assert np.allclose(leading(diagonal, off, 3), [3, 2, 1]) and len(mirrors) == 1


def brute_whitened(rows, k=4):
    """rows of (id, list): {(id, component): (n, deviation, |whitened|, explained)}, by LAPACK and whole fractions."""
    x = [(i, [math.floor(256 * c) for c in v]) for i, v in rows]
    fit = sorted(set(tuple(v) for _, v in x))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    mean = np.array([float(Fraction(s, n)) for s in sums])
    away = np.array(fit, float) - mean
    v = away.T @ away / n
    w, q = np.linalg.eigh(v)
    w, q = w[::-1][:k], q[:, ::-1][:, :k]
    keep = w > 1e-12 * np.trace(v)
    out = []
    for i, c in x:
        deviation = sum((n * a - s) ** 2 for a, s in zip(c, sums))
        for j in np.flatnonzero(keep):
            out.append((i, int(j) + 1, n, deviation, abs(float((np.array(c, float) - mean) @ q[:, j]) / math.sqrt(w[j])), float(w[j] / np.trace(v))))
    return out


def same_whitened(out, expected):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[4])
    mine = sorted(((r.vec_id, r.component, r.n, int(r.deviation), abs(r.whitened), r.explained) for r in out), key=key)
    expected = sorted(expected, key=key)
    assert len(mine) == len(expected)
    for a, b in zip(mine, expected, strict=True):
        assert a[:4] == b[:4]
        assert a[4:] == pytest.approx(b[4:], rel=1e-7, abs=1e-7)
    assert all(r.identity_error < 1e-8 for r in out)


def test_whitening_equals_brute_force(spark):
    random_ = np.random.default_rng(5)
    base = random_.normal(size=(80, 6)) * [5, 3, 2, 1, 0.5, 0.1]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    # a vector that many rows share counts once; repeated ids, a null id, entries over 16 and 32 bits
    rows += [(100 + i, rows[0][1]) for i in range(60)] + [(5, rows[7][1]), (None, rows[8][1]), (None, rows[9][1]), (300, [1e6, -1e3, 0.0, 0.5, -0.0, 2.0]), (301, [3e9, 1.0, 1.0, 1.0, 1.0, 1.0])]
    bad = [(400, None), (401, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (402, [float("nan")] * 6), (403, [float("inf")] + [0.0] * 5), (404, []), (405, [1.0, 2.0]), (406, [1e30] + [0.0] * 5)]
    docs = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows + bad], "vec_id long, embedding array<double>, n int, id string, component int").repartition(5)
    same_whitened(whiten(docs).collect(), brute_whitened(rows))
    two = whiten(docs.where("vec_id < 80"), components=2).collect()
    same_whitened(two, brute_whitened([r for r in rows if r[0] is not None and r[0] < 80], 2))


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        out = whiten(spark.createDataFrame(rows, schema))
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0
    # two vectors have one component
    out = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], schema)).collect()
    assert sorted((r.vec_id, r.component, abs(r.whitened)) for r in out) == [(1, 1, 1.0), (2, 1, 1.0)] and out[0].explained == 1.0


def test_query_of_whole_embeddings_equals_brute_force(spark):
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    out = queries.op11_embedding_whitening(spark, SF)
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    same_whitened(out.collect(), brute_whitened(rows))


# ---- importance resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text, longest):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return w, [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute_resample(rows, target, longest, buckets, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in runs(x, longest)[1]) for texts in ([x for _, x in rows], target))
    of, to = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * float(of) / ((s[b] + 1) * float(to))))
    out = []
    for i, x in rows:
        w, f = runs(x, longest)
        weight = sum(gain(bucket(y)) for y in f)
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = k
    return [tuple(r[:5]) for r in out]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(50)] + ["Größe", "École", "x" * 90, "数据", "A1b2"]
    line = " ".join(rng.choices(vocab, k=9))
    out = [(i, "\n".join([line] * (i % 3) + [" ".join(rng.choices(vocab, k=rng.randint(0, 14))) for _ in range(rng.randint(1, 5))])) for i in range(120)]
    return out + [(500, None), (501, ""), (502, " \n,.;\t\n"), (503, "one\n\ntwo\x0bthree\r\nFOUR"), (7, out[7][1]), (8, "another text " * 20), (None, out[3][1]), (None, out[4][1]), (504, line + "\n" + line)]


@pytest.mark.parametrize("longest, least", [(1, 20), (3, 5)])
def test_resampling_equals_brute_force(spark, texts, longest, least):
    docs = spark.createDataFrame([(i, t, 1, 2, "r") for i, t in texts], "doc_id long, text string, weight int, row int, rank string").repartition(4)
    target = [" ".join(f"w{i}" for i in range(k, k + 12)) + "\nw1 w2" for k in range(9)] + [None, ""]
    out = resample(docs, spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string"), longest, 100, 30, least)
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    expected = sorted(brute_resample(texts, target, longest, 100, 30, least), key=key)
    assert sorted((tuple(r) for r in out.collect()), key=key) == expected
    assert dict(out.dtypes) == dict.fromkeys(["doc_id", "n_features", "weight", "score", "rank"], "bigint")


def test_features_over_line_ends_are_counted_once(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    for longest in (1, 2, 4):
        expected = Counter(zlib.crc32(f.encode()) % 97 for _, t in texts for f in runs(t, longest)[1])
        assert bucket_counts(docs, longest, 97).tolist() == [expected[b] for b in range(97)]


def test_resampling_of_nothing_and_of_long_texts(spark):
    schema = "doc_id long, text string"
    empty = spark.createDataFrame([], schema)
    assert resample(empty, empty).count() == 0
    rng = random.Random(4)
    long = " ".join(f"t{rng.randint(0, 99999)}" for _ in range(tx.BLOCK // 4)) + "\n" + "y" * (tx.BLOCK + 9) + "\nend"
    rows = [(1, long), (2, long), (3, "a b c"), (4, "z " * 30)]
    out = resample(spark.createDataFrame(rows, schema), empty, 2, 1000, 100)
    assert sorted(tuple(r) for r in out.collect()) == sorted(brute_resample(rows, [], 2, 1000, 100, 20))


def test_equal_rows_share_ranks_without_gaps(spark):
    rows = [(None, "same words " * 15)] * 300 + [(1, "other words " * 15)] * 200 + [(i, "short") for i in range(50)]
    out = resample(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), spark.createDataFrame([], "text string"), percent=40).collect()
    assert sorted(r.rank for r in out if r.rank) == list(range(1, 201)) and len(out) == 550
    assert len({r.doc_id for r in out if r.rank}) == 1


# ---- URL filters

RULES = queries.URL_RULES


def brute_url(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for rule, verdict in rules:
        site = rule.split("/", 1)[0]
        own = "".join(c.lower() if "A" <= c <= "Z" else c for c in site)
        if host and (host == own or host.endswith("." + own)) and path.startswith(rule[len(site) :]):
            fits.append((len(rule), len(site), verdict, rule))
    return host, path, *(max(fits)[:1:-1] if fits else (None, None))


URLS = [
    "http://a.example.com/en/1", "https://www.example.com/en/", "https://m.www.Example.COM/en/x?y#z", "http://example.com/fr/", "http://notexample.com/en/2", "http://x.example.net/es/9.html#a",
    "http://example.net/fr", "http://net/es/", "ftp://net/fr/1?://com/", "http://com", "http://com/", "com/en/", "", None, "://", "http://", "http://?q", "http:///path", "http://h.org?x=/en/", "http://h.org#/f",
    "http://a.b.c.d.example.com:80/en/", "http://example.com./en/", "HTTP://U.NET/ES/", "http://ünïcode.net/es/ü", "http://" + "a." * 3000 + "example.com/en/", "http://long.net/es/" + "p" * 60000,
]


def test_rules_equal_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, host string, rule string").repartition(3)
    more = [("Example.com/en/", "allow"), ("example.com/en/", "block"), ("x.example.net/es/9", "allow"), ("h.org", "block"), ("com", "allow"), ("net/es/p", "block"), ("long.net/es/" + "p" * 300, "allow")]
    for rules in (RULES, RULES + more, [*RULES, (None, "block"), ("org", None)], []):
        out = urls.judge(pages, spark.createDataFrame(rules, "rule string, verdict string"), urls.labelled(spark)).collect()
        assert len(out) == len(URLS) + 3
        known = [r for r in rules if None not in r]
        for r in out:
            host, path, rule, verdict = brute_url((URLS + URLS[:3])[r.page_id], known)
            assert (r.host, r.path) == (host, path)
            assert r.verdict == (verdict or ("block" if r.score >= urls.LEAST else "allow")), r
            assert (r.rule or "").lower() == (rule or "").lower()
    assert urls.judge(pages.limit(0), spark.createDataFrame(RULES, "rule string, verdict string"), urls.labelled(spark)).count() == 0


def brute_chances(known, asked):
    """Chances of label 1 by dictionaries of n-grams, each with the trained weight of its bucket."""
    weights, constant = urls.train([h for h, _, _ in known], [p for _, p, _ in known], np.array([y for *_, y in known], float))
    out = []
    for host, path in asked:
        bags = Counter()
        for field, text in enumerate((host, path)):
            padded = b"^" + bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode()) + b"$"
            for size in urls.SIZES:
                for i in range(len(padded) - size + 1):
                    gram = np.frombuffer(padded[i : i + size], np.uint8)
                    up = np.array([pow(tx._BASES[2], k, 2**64) for k in range(size)], np.uint64)
                    h = tx.mix(np.array([(tx._BYTE[gram] * up).sum(dtype=np.uint64) + np.uint64(8 * size + field)]))[0]
                    bags[int(h >> np.uint64(20)) % urls.BUCKETS] += 1
        values = {b: 1 + math.log(k) for b, k in bags.items()}
        length = math.sqrt(sum(v * v for v in values.values())) or 1
        out.append(1 / (1 + math.exp(-(sum(v * weights[b] for b, v in values.items()) / length + constant))))
    return out


def test_scores_equal_brute_force(spark):
    pages = spark.createDataFrame(list(enumerate(URLS[:-2])), "page_id long, url string")
    known = [(*brute_url(r.url, [])[:2], r.label) for r in urls.labelled(spark).collect()]
    out = sorted(urls.judge(pages, spark.createDataFrame([], "rule string, verdict string"), urls.labelled(spark)).collect())
    assert [r.score for r in out] == pytest.approx(brute_chances(sorted(set(known)), [brute_url(u, [])[:2] for u in URLS[:-2]]), rel=1e-6)


def test_model_is_a_minimum_of_its_loss():
    """The gradient of the regularised likelihood is small at the trained weights, and the loss higher beside them."""
    import pyarrow as pa

    rows = [(f"{site}.test", "/a", y) for y, sites in ((1, urls.BLOCKED), (0, urls.ALLOWED)) for site in sites.split()]
    hosts, paths, labels = [r[0] for r in rows], [r[1] for r in rows], np.array([r[2] for r in rows], float)
    weights, constant = urls.train(hosts, paths, labels, rounds=3000)
    row, bucket, value = urls._design(pa.record_batch({"host": pa.array(hosts), "path": pa.array(paths)}))

    def loss(w):
        z = np.bincount(row, value * w[bucket], len(rows)) + constant
        return np.mean(np.logaddexp(0, z) - labels * z) + 0.5e-4 * (w @ w)

    at, random_ = loss(weights), np.random.default_rng(1)
    for _ in range(20):
        step = np.zeros(urls.BUCKETS)
        step[np.unique(bucket)] = random_.normal(size=len(np.unique(bucket))) * 0.05
        assert loss(weights + step) > at


def test_sites_not_learnt_from_are_told_apart(spark):
    """Five folds of sites: at least three quarters right, and few good sites blocked at the production threshold."""
    sites = [(s, y) for y, names in ((1, urls.BLOCKED), (0, urls.ALLOWED)) for s in names.split()]
    random.Random(0).shuffle(sites)
    right = wrong = good = 0
    for k in range(5):
        known = [brute_url(f"https://{shape.format(s)}", [])[:2] + (y,) for i, (s, y) in enumerate(sites) if i % 5 != k for shape in urls.SHAPES]
        weights, constant = urls.train([h for h, *_ in known], [p for _, p, _ in known], np.array([y for *_, y in known], float))
        import pyarrow as pa

        asked = [(s, y) for i, (s, y) in enumerate(sites) if i % 5 == k]
        found = urls.chances(weights, constant, pa.record_batch({"host": [f"{s}.test" for s, _ in asked], "path": ["/"] * len(asked)}))
        right += sum((c >= 0.5) == y for c, (_, y) in zip(found, asked, strict=True))
        wrong += sum(c >= urls.LEAST and not y for c, (_, y) in zip(found, asked, strict=True))
        good += sum(not y for _, y in asked)
    assert right >= 0.75 * len(sites) and wrong <= 0.05 * good


def test_without_labels_of_both_kinds_all_are_allowed(spark):
    pages = spark.createDataFrame([(1, "http://casino.test/")], "page_id long, url string")
    one = urls.labelled(spark).where("label = 1")
    both = one.unionByName(one.withColumn("label", F.lit(0)))  # labelled both ways: not learnt from
    for labels in (one, both, one.limit(0)):
        assert urls.judge(pages, spark.createDataFrame([], "rule string, verdict string"), labels).first().verdict == "allow"


def test_query_of_whole_pages(spark):
    rows = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    out = queries.op13_url_filters(spark, SF).collect()
    assert len(out) == len(rows)
    for r in out:
        host, path, rule, verdict = brute_url(rows[r.page_id], RULES)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        if rule:
            assert r.verdict == verdict
        else:
            assert (r.verdict == "block") == (r.score >= urls.LEAST)
