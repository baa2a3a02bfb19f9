"""Search operators: postings, BM25, exact cosine, rank fusion, recall, hash embedding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERM = r"[\p{L}\p{N}]++"
#: Depth of each leg, and the constant of rank fusion.
DEPTH, RANK = 50, 60


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits; diacritics stay."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def postings(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, term, tf, length): one row per document and term, and the document's number of terms."""
    words = docs.select(key, terms(F.coalesce(text, F.lit(""))).alias("_terms"))
    each = words.select(key, F.size("_terms").alias("length"), F.explode("_terms").alias("term"))
    return each.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def match_phrase(text: Column, phrase: str) -> Column:
    """Whether a quoted query token, of one term or more in a row, is in a text."""
    words = [w for w in split_terms(phrase)]
    return F.concat(F.lit(" "), F.array_join(terms(text), " "), F.lit(" ")).contains(f" {' '.join(words)} ") if words else F.lit(True)


def split_terms(text: str) -> list[str]:
    out, word = [], ""
    for c in text.lower() + " ":
        if c.isalnum():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def bm25(docs: DataFrame, key: str, text: str, query: str, k1: float = 1.2, b: float = 0.75, depth: int = DEPTH) -> DataFrame:
    """The `depth` documents that hold every token of a query, best Okapi BM25 first: (key, score, rank).

    A token with inner punctuation is a phrase.  Only the query's terms are
    counted, beside the number and mean length of all documents.
    """
    asked = list(dict.fromkeys(w for token in query.split() for w in split_terms(token)))
    phrases = [p for p in query.split() if len(split_terms(p)) > 1]
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    # a document without a term's letters is not looked at for it
    times = [F.when(F.contains(F.col("_low"), F.lit(w)), F.regexp_count("_low", F.lit(rf"(?<![\p{{L}}\p{{N}}]){w}(?![\p{{L}}\p{{N}}])"))).otherwise(0).alias(f"_tf{i}") for i, w in enumerate(asked)]
    both = F.lit(True)
    for phrase in phrases:
        both = both & F.contains(F.col("_low"), F.lit(split_terms(phrase)[0])) & match_phrase(F.col("_low"), phrase)
    rows = docs.select(F.col(key), low.alias("_low")).select(key, F.regexp_count("_low", F.lit(TERM)).alias("_len"), both.alias("_both"), *times)
    stats = rows.agg(F.count("*").alias("_n"), F.avg("_len").alias("_mean"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(asked))])
    hits = rows.where("_both")
    for i in range(len(asked)):
        hits = hits.where(F.col(f"_tf{i}") > 0)
    if not asked:
        hits = hits.where("false")
    hits = hits.join(F.broadcast(stats), how="cross")  # one row
    score = F.lit(0.0)
    for i in range(len(asked)):
        idf = F.log((F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5) + 1)
        score = score + idf * F.col(f"_tf{i}") * (k1 + 1) / (F.col(f"_tf{i}") + k1 * (1 - b + b * F.col("_len") / F.col("_mean")))
    return ranked(hits.select(key, score.alias("score")), key, depth)


def _is(word: str):
    return lambda x: x == word


def ranked(scores: DataFrame, key: str, depth: int) -> DataFrame:
    """The `depth` best rows with their rank, ties by key; only they meet in one place."""
    top = scores.orderBy(F.desc("score"), key).limit(depth)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 0 where lengths differ or one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), 0.0).otherwise(dot(a, b) / norms)


def nearest(vectors: DataFrame, key: str, vector: str, query: Sequence[float] | DataFrame, depth: int = DEPTH) -> DataFrame:
    """The `depth` vectors of highest cosine with one query vector: (key, score, rank)."""
    if isinstance(query, DataFrame):  # one row
        rows = vectors.join(F.broadcast(query.select(F.col(query.columns[0]).alias("_query")).limit(1)), how="cross")
    else:
        rows = vectors.withColumn("_query", F.array(*[F.lit(float(x)) for x in query]))
    return ranked(rows.select(key, cosine(F.col(vector), F.col("_query")).alias("score")), key, depth)


def fuse(words: DataFrame, vectors: DataFrame, key: str, constant: int = RANK) -> DataFrame:
    """Reciprocal rank fusion of two ranked legs: (key, score, match_kind), keyword hits before others of equal score."""
    both = words.select(key, F.col("rank").alias("_w")).join(vectors.select(key, F.col("rank").alias("_v")), key, "full")
    part = lambda c: F.coalesce(1 / (constant + F.col(c)), F.lit(0.0))
    kind = F.when(F.col("_v").isNull(), "keyword").when(F.col("_w").isNull(), "semantic").otherwise("hybrid")
    rows = both.select(key, (part("_w") + part("_v")).alias("score"), kind.alias("match_kind"), F.col("_w").alias("word_rank"), F.col("_v").alias("vector_rank"))
    return rows.orderBy(F.desc("score"), F.asc_nulls_last("word_rank"), F.asc_nulls_last("vector_rank"), key)


def recall(hits: DataFrame, expected: DataFrame, query: str, key: str, k: int, by: str | None = None) -> DataFrame:
    """Share of queries with an expected key among their k best, of all and by a column of expected.

    hits: (query, key, rank); expected: (query, key[, by]).
    """
    found = hits.where(F.col("rank") <= k).select(query, key).join(expected.select(query, key), [query, key]).select(query).distinct()
    return recall_shares(expected.select(query, *([by] if by else [])).distinct(), found, query, by)


def recall_shares(asked: DataFrame, found: DataFrame, query: str, by: str | None = None) -> DataFrame:
    """Share of the asked queries that are among the found, of all and by a column of asked."""
    asked = asked.join(found.select(query).distinct().withColumn("_hit", F.lit(1.0)), query, "left")
    share = F.coalesce(F.avg(F.coalesce("_hit", F.lit(0.0))), F.lit(0.0)).alias("recall")
    if not by:
        return asked.agg(share, F.count("*").alias("queries"))
    return asked.rollup(by).agg(share, F.count("*").alias("queries")).withColumn(by, F.coalesce(by, F.lit("all")))


def recall_misses(asked: DataFrame, found: DataFrame, hits: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """The asked queries that found nothing expected, each with what it got (at most k keys) in order of rank."""
    got = hits.where(F.col("rank") <= k).groupBy(query).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", key))), lambda x: x[key]).alias("got"))
    return asked.join(found, query, "left_anti").join(got, query, "left").withColumn("got", F.coalesce("got", F.array()))


def hash_embedding(text: Column, size: int = 32) -> Column:
    """Counts of character codes modulo `size`, at unit length; an empty text is all 0."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c) % size)
    counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(codes, lambda c: c == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(counts, lambda x: F.when(norm == 0, 0.0).otherwise(x / norm))


def hash_embeddings(docs: DataFrame, key: str, text: str, size: int = 32, kind: str = "float") -> DataFrame:
    """(key, vector) of each text: counts of its UTF-16 units modulo `size`, divided by their norm (1 for an empty text), as 32-bit floats or (`double`) unrounded."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        for batch in batches:
            out = np.zeros((batch.num_rows, size), np.float32 if kind == "float" else np.float64)
            for i, value in enumerate(pc.fill_null(batch.column(1), "").to_pylist()):
                units = np.frombuffer(value.encode("utf-16-le", "surrogatepass"), "<u2")
                counts = np.bincount(units % size, minlength=size).astype(float)
                out[i] = counts / (np.sqrt(counts @ counts) or 1)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * size, pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), vectors], names=[key, "vector"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, vector array<{kind}>")
