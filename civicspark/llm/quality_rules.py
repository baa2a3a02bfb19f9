"""Quality rules by robust multivariate outliers.

A document's statistics become six numbers of even scale.  For each language and
source a minimum-covariance-determinant estimate is taken over all its
documents: from medians and quartile ranges, concentration steps keep the share
CORE of documents nearest by Mahalanobis distance and take their mean and
covariance anew, while the determinant falls.  A document is rejected when its
squared distance exceeds CUTOFF.

A group's estimate is drawn towards that of all cores of its language as if POOL
documents more were like it, and a language's towards that of all in the same way:
one rule for groups of every size, by which two documents of a source are judged by
their language and a million by themselves.  CUTOFF grows by the share FEW / n for n
documents in all cores.  Most documents have no symbols and no repeats, so the
plain estimate would be singular: the square of FLOORS is added to the variances (a
regularised MCD).

Which documents are nearest is read from counts of distances in narrow bins, so
every step is grouped sums over small rows; no group is gathered, and the numbers
do not depend on how rows are dealt out.

Defined cases: a null or empty text has no words and fails the base rule; null
language and source are values of their own; rows that repeat an id are judged
each; extra columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicspark.llm import text as tx
from civicspark.llm.scratch import save

SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
#: Words in a window of the repeat rule.
REPEAT = 8
#: Each statistic's least standard deviation: log words, mean word length, symbols a word, repeated lines, repeated words, log words a line.
FLOORS = (1.0, 0.3, 0.04, 0.08, 0.08, 0.8)
CORE, STEPS, POOL, FEW = 0.75, 10, 200, 30
#: The chi-square quantile of six degrees of freedom at 1 - 1e-6.
CUTOFF = 38.3
#: Variance of the nearest 75 % of a six-dimensional normal sample is this much too small.
CONSISTENCY = 1.36
P = len(FLOORS)

_STATS = "id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
_STATS_ARROW = pa.schema([("id", pa.int64()), ("lang", pa.string()), ("source", pa.string()), *[(x, pa.int64()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")]])


def _again(keys: np.ndarray) -> np.ndarray:
    """For each key the number of equal keys up to it in order of place, less one: over 0 from the second on."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
    out = np.empty(len(keys), np.int64)
    out[order] = np.arange(len(keys)) - start
    return out


def _own(keys: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Keys made different between texts of a block."""
    return tx.mix(keys + tx.mix(text.astype(np.uint64) + np.uint64(1)))


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in tx.blocks(batches):
        rows = batch.num_rows
        w = tx.words(data, offsets)
        per = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
        solid = ~tx.SPACE[data]
        chars = per(solid & ((data & 0xC0) != 0x80))
        symbols = per(SYMBOLS[data])
        # lines: between line ends and texts' ends
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        starts = np.flatnonzero(edge[:-1] | np.concatenate([[False], data[:-1] == 10])[: len(data)])
        ends = np.append(starts[1:], len(data))
        ends = ends - ((ends > starts) & (data[ends - 1] == 10))
        full = np.concatenate([[0], np.cumsum(solid)])
        keep = full[ends] > full[starts]
        starts, ends = starts[keep], ends[keep]
        line_text = np.searchsorted(offsets, starts, "right") - 1
        lines = np.bincount(line_text, minlength=rows)
        dup = np.bincount(line_text[_again(_own(_line_hashes(data, starts, ends), line_text)) > 0], minlength=rows)
        # words in windows that come again
        doc = w.text_of()
        at = np.flatnonzero(w.left() >= REPEAT)
        keys = _own(tx.grams(w.hashes, REPEAT)[at], doc[at])
        turn = _again(keys)
        order = np.argsort(keys, kind="stable")
        twice = turn > 0
        nxt = np.zeros(len(keys), bool)
        nxt[order[:-1]] = keys[order][1:] == keys[order][:-1]
        found = at[twice | nxt]
        cover = np.zeros(len(w.hashes) + 1, np.int64)
        np.add.at(cover, found, 1)
        np.add.at(cover, found + REPEAT, -1)
        repeated = np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=rows)
        yield tx.record(_STATS_ARROW, batch.column(0), batch.column(1), batch.column(2), w.counts, chars, symbols, dup, repeated, lines)


def _line_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = tx._POWERS[2].upto(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(tx._BYTE[data] * up[: len(data)], out=total[1:])
    return tx.mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def statistics(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row of docs: id, lang, source and the counts of words, their characters, symbols, repeated lines and words, and lines."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), "lang", "source", "text")
    return rows.mapInArrow(_stats, _STATS).withColumnRenamed("id", id_col)


def _vector() -> list[Column]:
    """Short texts are drawn to the usual rates as if they had 50 words, or 5 lines, more."""
    n = F.col("n_words")
    return [
        F.log1p(n), (F.col("word_chars") + 250) / (n + 50), F.col("n_symbols") / (n + 50), F.col("n_dup_lines") / (F.col("n_lines") + 5),
        F.col("n_repeat_words") / (n + 50), F.log1p(n / F.greatest("n_lines", F.lit(1))),
    ]


def _squared() -> Column:
    """The squared Mahalanobis distance of z by centre and the upper half of inverse."""
    off = [F.get("z", F.lit(i)) - F.get("centre", F.lit(i)) for i in range(P)]
    pairs = [(i, j) for i in range(P) for j in range(i, P)]
    terms = [F.get("inverse", F.lit(k)) * off[i] * off[j] for k, (i, j) in enumerate(pairs)]
    return F.greatest(sum(terms[1:], terms[0]), F.lit(0.0))


def _inverse(s: np.ndarray) -> list[float]:
    inv = np.linalg.inv(s)
    return [float(inv[i, j] * (1 if i == j else 2)) for i in range(P) for j in range(i, P)]


def _spread(n: float, sums, products) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance by sums over a core."""
    mean = np.array(sums, float) / n
    s = np.zeros((P, P))
    s[np.triu_indices(P)] = np.array(products, float) / n
    s = np.triu(s) + np.triu(s, 1).T - np.outer(mean, mean)
    return mean, CONSISTENCY * s


def _shape(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of a group's core -> centre, inverse, log determinant, beside the sums."""
    for frame in frames:
        out = []
        for key, n, sums, products in zip(frame.key, frame.n, frame.sums, frame.products, strict=True):
            mean, s = _spread(n, sums, products)
            s = s + np.diag(np.square(FLOORS))
            out.append((key, mean.tolist(), _inverse(s), float(np.linalg.slogdet(s)[1]), n, sums, products))
        yield pd.DataFrame(out, columns=["key", "centre", "inverse", "logdet", "n", "sums", "products"])


def _drawn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of a group's core, its language's and all -> the centre and inverse that judge the group."""
    for frame in frames:
        out = []
        for r in frame.itertuples():
            mean, s = _spread(r.all_n, r.all_sums, r.all_products)
            for n, sums, products in ((r.lang_n, r.lang_sums, r.lang_products), (r.n, r.sums, r.products)):
                own, spread = _spread(n, sums, products)
                mean, s = (n * own + POOL * mean) / (n + POOL), (n * spread + POOL * s) / (n + POOL)
            out.append((r.key, mean.tolist(), _inverse(s + np.diag(np.square(FLOORS))), CUTOFF * (1 + FEW / r.all_n)))
        yield pd.DataFrame(out, columns=["key", "centre", "inverse", "cutoff"])


_SUMS = "n double, sums array<double>, products array<double>"
_SHAPE = f"key string, centre array<double>, inverse array<double>, logdet double, {_SUMS}"


def _started(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Quartiles of a group -> a first centre and diagonal shape."""
    for frame in frames:
        out = []
        for key, quarters in zip(frame.key, frame.quarters, strict=True):
            q = np.array([[*x] for x in quarters], float).reshape(P, 3)
            s = np.diag(np.square((q[:, 2] - q[:, 0]) / 1.349) + np.square(FLOORS))
            out.append((key, q[:, 1].tolist(), _inverse(s), float("inf"), 0.0, [], []))
        yield pd.DataFrame(out, columns=["key", "centre", "inverse", "logdet", "n", "sums", "products"])


def _quartiles(z: DataFrame) -> DataFrame:
    width = F.element_at(F.array(*map(F.lit, FLOORS)), F.col("dim") + 1) / 20
    bins = z.select("key", F.posexplode("z").alias("dim", "x")).groupBy("key", "dim", F.floor(F.col("x") / width).alias("bin")).agg(F.count("*").alias("k"))
    over = Window.partitionBy("key", "dim").orderBy("bin")
    bins = bins.withColumn("upto", F.sum("k").over(over)).withColumn("all", F.sum("k").over(Window.partitionBy("key", "dim")))
    at = [F.min(F.when(F.col("upto") >= F.col("all") * q, (F.col("bin") + 0.5) * width)).alias(f"q{i}") for i, q in enumerate((0.25, 0.5, 0.75))]
    each = bins.groupBy("key", "dim").agg(*at)
    sorted_ = F.array_sort(F.collect_list(F.struct("dim", "q0", "q1", "q2")))
    return each.groupBy("key").agg(F.transform(sorted_, lambda x: F.array(x.q0, x.q1, x.q2)).alias("quarters"))


def cores(z: DataFrame) -> DataFrame:
    """The sums over the core of each key of (key, z): (key, n, sums, products)."""
    now = save(_quartiles(z).mapInPandas(_started, _SHAPE))
    pairs = [(i, j) for i in range(P) for j in range(i, P)]
    for _ in range(STEPS):
        far = z.join(now.select("key", "centre", "inverse"), "key").withColumn("bin", F.floor(F.least(F.sqrt(_squared()), F.lit(100.0)) * 50).cast("int"))
        # rows of one bin stand together; a group has 5001 bins at most
        sums = [F.sum(F.get("z", F.lit(i)).cast("decimal(28,12)")).alias(f"s{i}") for i in range(P)]
        products = [F.sum((F.get("z", F.lit(i)) * F.get("z", F.lit(j))).cast("decimal(28,12)")).alias(f"p{k}") for k, (i, j) in enumerate(pairs)]
        bins = far.groupBy("key", "bin").agg(F.count("*").alias("k"), *sums, *products)
        over = Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("before", F.coalesce(F.sum("k").over(over), F.lit(0))).withColumn("all", F.sum("k").over(Window.partitionBy("key")))
        core = bins.where(F.col("before") < CORE * F.col("all")).groupBy("key").agg(
            F.sum("k").cast("double").alias("n"), F.array(*[F.sum(f"s{i}").cast("double") for i in range(P)]).alias("sums"),
            F.array(*[F.sum(f"p{k}").cast("double") for k in range(len(pairs))]).alias("products"))
        after = save(core.mapInPandas(_shape, _SHAPE))
        both = now.select("key", F.col("logdet").alias("was")).join(after, "key")
        fell = both.where("was - logdet > 1e-4").limit(1).count()
        now = after
        if not fell:
            break
    return now.select("key", "n", "sums", "products")


def _pooled(rows: DataFrame, name: str, *by: str) -> DataFrame:
    """Sums over the cores of many groups."""
    added = lambda c, size: F.array(*[F.sum(F.get(c, F.lit(i)).cast("decimal(38,12)")).cast("double") for i in range(size)]).alias(f"{name}_{c}")
    sums = [F.sum("n").alias(f"{name}_n"), added("sums", P), added("products", P * (P + 1) // 2)]
    return rows.groupBy(*by).agg(*sums)


def shapes(z: DataFrame) -> DataFrame:
    """What judges each group of (key, lang, z): (key, centre, inverse, cutoff)."""
    own = cores(z.select("key", "z"))
    own = own.join(z.select("key", "lang").distinct(), "key")
    lang = _pooled(own, "lang", "lang").withColumnRenamed("lang", "lang_")
    rows = own.join(lang, F.expr("lang <=> lang_")).join(_pooled(own, "all"), how="cross")  # one row
    return rows.drop("lang", "lang_").mapInPandas(_drawn, "key string, centre array<double>, inverse array<double>, cutoff double")


def quality(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row of docs: its statistics, base_failed, the squared distance and kept."""
    stats = save(statistics(docs, id_col))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    key = F.to_json(F.struct("lang", "source"))
    rows = save(stats.withColumn("base_failed", base).withColumn("z", F.array(*_vector())).withColumn("key", key))
    found = save(shapes(rows.where("not base_failed").select("key", "lang", "z")))
    out = rows.join(found, "key", "left").withColumn("distance", _squared())
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= F.col("cutoff"), F.lit(True))
    return out.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance", "lang", "source")
