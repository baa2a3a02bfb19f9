"""A stored keyword index: positional postings, read by the query's terms alone.

    postings/folder=N   (term, key, origin, doc, length, tf, gaps), in ranges of term and key
    deleted/folder=N    (origin, chunk, bits): documents of earlier batches that batch N replaced or removed
    manifest            which folders are live, number and summed length of all documents

A batch is one pass over its texts and one shuffle of its postings.  A posting holds
its document's key and length and the gaps between the term's places, so a search
reads neither texts nor a table of documents; what it needs of the whole, two
numbers, stands in the manifest.  The empty term lists a batch's documents.  `origin`
is the batch in which a document came and `doc` its number there; deletions are
bitmaps over these numbers, and merging folders (see `levels`) drops what is deleted.

Defined cases: a null text is empty; a null key raises, and so does a key that comes
twice in one batch; a query without a term finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.operators import levels
from civicspark.operators.retrieval import ranked, split_terms, terms
from civicspark.session import shuffles_dropped

#: Number of the layout, for folders that outlive a session.
LAYOUT = 2
#: Words of the texts that a task takes apart at once, and postings of a range.
WORDS, RANGE = 1 << 19, 2_000_000
#: Postings that are shuffled at once, about, and into how many passes they are dealt for that at most.
PASS, PASSES = 25_000_000, 8
#: How postings lie on disk.
CODEC = "zstd"
_DELETED = "origin int, chunk long, bits binary"


def index_documents(datasets: DataFrame, key: str, parts: Sequence[Column], labels: DataFrame | None = None) -> DataFrame:
    """(key, body): a dataset's texts, blank ones left out, then its entities' labels (key, entity, label) in order of entity, a line each."""
    text = F.array_compact(F.array(*[F.when(F.trim(p) != "", F.trim(p)) for p in parts]))
    rows = datasets.select(key, text.alias("texts"))
    if labels is not None:
        own = labels.where("label is not null").groupBy(key).agg(F.array_sort(F.collect_set(F.struct("entity", "label"))).alias("own"))
        rows = rows.join(own, key, "left").withColumn("texts", F.concat("texts", F.coalesce(F.col("own.label"), F.array().cast("array<string>"))))
    return rows.select(key, F.array_join("texts", "\n").alias("body"))


def _schema(kind: str) -> str:
    return f"term string, key {kind}, origin int, doc long, length int, tf int, gaps array<int>"


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of at most WORDS words together, or one."""
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + WORDS, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def _postings(origin: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, doc, words) a row for each document and term, with the gaps between its places, and one of the empty term for each document."""
    for batch in _slices(batches):
        sizes = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.dictionary_encode(pc.list_flatten(batch.column(2)))
        row = np.repeat(np.arange(batch.num_rows), sizes)
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = np.lexsort((place, coded.indices.to_numpy(zero_copy_only=False), row))
        code, row, place = coded.indices.to_numpy(zero_copy_only=False)[order], row[order], place[order]
        first = np.flatnonzero(np.diff(code, prepend=-1) | np.diff(row, prepend=-1))
        gaps = np.diff(place, prepend=0)
        gaps[first] = place[first]
        edges = np.append(first, len(row))
        docs = pa.array(np.concatenate([np.arange(batch.num_rows), row[first]]))
        term = pa.concat_arrays([pa.array([""] * batch.num_rows, pa.string()), coded.dictionary.cast(pa.string()).take(pa.array(code[first]))])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(batch.num_rows), edges]), pa.int32()), pa.array(gaps, pa.int32()))
        tf = pa.array(np.concatenate([np.zeros(batch.num_rows), np.diff(edges)]), pa.int32())
        length = pa.array(sizes, pa.int32()).take(docs)
        columns = {"term": term, "key": batch.column(0).take(docs), "origin": pa.array(np.full(len(docs), origin), pa.int32()), "doc": batch.column(1).take(docs), "length": length, "tf": tf, "gaps": lists}
        yield pa.RecordBatch.from_pydict(columns)


def _write_ranged(rows: DataFrame, path: str, number: int, ranges: int, count: int) -> None:
    """In order of term and key, in at least so many ranges, of about RANGE postings at most; a frequent term is spread over ranges of its keys.

    What is shuffled lies on disk beside what is read and what is written, so it goes
    in passes by beginnings of the terms' order, each ended before the next.
    """
    passes, bounds = max(1, min(PASSES, -(-count // PASS))), []
    if passes > 1:  # terms that part the postings about evenly, from some of them
        some = sorted(term for (term,) in rows.select("term").sample(min(1.0, 20_000 / count), seed=1).collect())
        bounds = sorted({some[len(some) * i // passes] for i in range(1, passes)} - {""}) if some else []
    for i, (lo, hi) in enumerate(zip([None, *bounds], [*bounds, None], strict=True)):
        own = rows if lo is None else rows.where(F.col("term") >= lo)
        own = own if hi is None else own.where(F.col("term") < hi)
        parts = -(-max(ranges, -(-count // RANGE)) // (len(bounds) + 1))
        # the number of places is that of the gaps
        dealt = own.drop("tf").repartitionByRange(parts, "term", "key").sortWithinPartitions("term", "key")
        levels.write(dealt.withColumn("tf", F.size("gaps")), path, "postings", number, more=i > 0, codec=CODEC)


def _deleted(spark: SparkSession, path: str, state: dict) -> DataFrame | None:
    """(origin, chunk, bits) of all that is deleted from live folders; None if nothing is."""
    if not state["own"].get("deleted"):
        return None
    return levels.read(spark, path, "deleted", state, _DELETED).groupBy("origin", "chunk").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))


def _alive(rows: DataFrame, deleted: DataFrame | None) -> DataFrame:
    if deleted is None:
        return rows
    held = rows.withColumn("chunk", F.expr("bitmap_bucket_number(doc)")).join(deleted, ["origin", "chunk"], "left")
    # the byte of a document's bit, then the bit
    byte = F.expr("conv(hex(substring(bits, cast(bitmap_bit_position(doc) div 8 as int) + 1, 1)), 16, 10)").cast("int")
    bit = byte.bitwiseAND(F.expr("shiftleft(1, cast(bitmap_bit_position(doc) % 8 as int))"))
    return held.where(F.coalesce(bit, F.lit(0)) == 0).drop("chunk", "bits")


def _empty(spark: SparkSession, path: str, schema: str, number: int) -> None:
    levels.write(spark.createDataFrame([], schema).coalesce(1), path, "postings", number)
    levels.write(spark.createDataFrame([], _DELETED).coalesce(1), path, "deleted", number)


def write_batch(docs: DataFrame, path: str, batch: int, key: str, text: str, gone: DataFrame | None = None, ranges: int = 64, fan: int = levels.FAN) -> None:
    """Add documents (key, text), which replace those of their keys, and take out the keys in `gone`, as batch number `batch`.

    Batches come in rising order; one that is committed already is left alone, so a
    writer may repeat its last batch after a failure.
    """
    with shuffles_dropped(docs.sparkSession):
        _write_batch(docs, path, batch, key, text, gone, ranges, fan)


def _write_batch(docs: DataFrame, path: str, batch: int, key: str, text: str, gone: DataFrame | None, ranges: int, fan: int) -> None:
    spark = docs.sparkSession
    state = levels.manifest(spark, path)
    if state["own"] and batch <= state["own"]["batch"]:
        return
    number, kind = state["next"], dict(docs.dtypes)[key]
    schema = _schema(kind)
    state = levels.emptied(spark, state, lambda old: _empty(spark, path, schema, old))
    words = docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("doc"), terms(F.coalesce(F.col(text), F.lit(""))).alias("words"))
    # once written, documents keep their numbers, and the texts are not read again to find ranges of terms
    words.mapInArrow(lambda batches: _postings(number, batches), schema).write.mode("overwrite").option("compression", CODEC).parquet(f"{path}/staged")
    staged = spark.read.schema(schema).parquet(f"{path}/staged")
    new = staged.where("term = ''").select("key", "length")
    n, some, keys, length = new.agg(F.count("*"), F.count("key"), F.countDistinct("key"), F.coalesce(F.sum("length"), F.lit(0))).first()
    if some < n or keys < n:
        raise ValueError(f"of {n} documents {n - some} have no key and {some - keys} repeat one")
    _write_ranged(staged, path, number, ranges, staged.count())
    out = new.select("key") if gone is None else new.select("key").unionByName(gone.select(F.col(key).alias("key"))).distinct()
    old = levels.read(spark, path, "postings", state, schema).where("term = ''").select("key", "origin", "doc", "length")
    bits = _alive(old, _deleted(spark, path, state)).join(out, "key", "left_semi").groupBy("origin", F.expr("bitmap_bucket_number(doc)").alias("chunk"))
    bits = bits.agg(F.expr("bitmap_construct_agg(bitmap_bit_position(doc))").alias("bits"), F.count("*").alias("n"), F.sum("length").alias("length"))
    levels.write(bits, path, "deleted", number)
    written = spark.read.schema("n long, length long").parquet(f"{path}/deleted/folder={number}")
    lost, less = written.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first()
    own = state["own"] or {"n": 0, "length": 0, "deleted": 0, "key": kind}
    own = {**own, "batch": batch, "n": own["n"] + n - lost, "length": own["length"] + length - less, "deleted": own["deleted"] + lost}
    state = levels.commit(spark, path, levels.added(state, number, own))
    spark.createDataFrame([], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/staged")
    while found := levels.full_level(state, fan):
        state = _merge(spark, path, state, *found, ranges)


def _merge(spark: SparkSession, path: str, state: dict, level: int, numbers: list[int], ranges: int) -> dict:
    """One folder in place of `numbers`, without what is deleted; their deletions from other folders stay."""
    schema, number = _schema(state["own"]["key"]), state["next"]
    rows = _alive(levels.read(spark, path, "postings", state, schema, numbers), _deleted(spark, path, state))
    count = levels.read(spark, path, "postings", state, schema, numbers).count()
    _write_ranged(rows, path, number, ranges, count)
    inside = levels.read(spark, path, "postings", state, schema, numbers).where("term = ''").select("origin").distinct()
    others = levels.read(spark, path, "deleted", state, _DELETED, numbers).join(F.broadcast(inside), "origin", "left_anti")  # a row a batch
    levels.write(others.groupBy("origin", "chunk").agg(F.expr("bitmap_or_agg(bits)").alias("bits")), path, "deleted", number)
    held = spark.read.schema(_DELETED).parquet(f"{path}/deleted/folder={number}")
    rest = [n for n, _ in state["folders"] if n not in numbers]
    left = held.unionByName(levels.read(spark, path, "deleted", state, _DELETED, rest)).agg(F.coalesce(F.sum(F.expr("bitmap_count(bits)")), F.lit(0))).first()[0]
    return levels.commit(spark, path, levels.merged(state, numbers, level, number, {**state["own"], "deleted": int(left)}))


def rebuild(spark: SparkSession, path: str, to: str, key: str, ranges: int = 64) -> None:
    """All that an index of documents by `key` holds as one folder, in another place."""
    state = levels.manifest(spark, path)
    if not state["own"]:
        raise ValueError(f"no index by {key} in {path}")
    schema = _schema(state["own"]["key"])
    rows = levels.read(spark, path, "postings", state, schema)
    with shuffles_dropped(spark):
        _write_ranged(_alive(rows, _deleted(spark, path, state)), to, 0, ranges, rows.count())
    levels.write(spark.createDataFrame([], _DELETED).coalesce(1), to, "deleted", 0)
    levels.commit(spark, to, levels.added({**levels.manifest(spark, to), "folders": []}, 0, {**state["own"], "deleted": 0}))


def parsed(query: str) -> tuple[list[tuple[str, bool]], list[list[str]]]:
    """The distinct terms of a query, each with whether it is the beginning of a term (it ends a token in *), and the tokens that are phrases of them."""
    slots: list[tuple[str, bool]] = []
    phrases = []
    for token in query.split():
        words = split_terms(token)
        begin = token.endswith("*") and len(words) == 1
        slots += [(w, begin) for w in words if (w, begin) not in slots]
        if len(words) > 1:
            phrases.append(words)
    return slots, phrases


def _adjacent(phrase: list[str]):
    """Whether a document's terms follow one another somewhere as in the phrase."""

    @F.pandas_udf("boolean")
    def follows(found: pd.Series) -> pd.Series:
        def one(rows) -> bool:
            places = {r["term"]: np.cumsum(r["gaps"]) for r in rows}
            at = places[phrase[0]]
            for i, w in enumerate(phrase[1:], 1):
                at = at[np.isin(at + i, places[w], assume_unique=False)]
            return len(at) > 0

        return found.map(one)

    return follows


def search(spark: SparkSession, path: str, key: str, query: str, depth: int = 50, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The `depth` documents that hold every token of a query, best Okapi BM25 first: (key, score, rank).

    A token with inner punctuation is a phrase; one that ends in * stands for all
    terms that begin so, whose counts are summed.
    """
    state = levels.manifest(spark, path)
    slots, phrases = parsed(query)
    kind, n, mean = state["own"].get("key", "string"), state["own"].get("n", 0), state["own"].get("length", 0) / max(state["own"].get("n", 0), 1)
    if not slots or not n:
        return spark.createDataFrame([], f"`{key}` {kind}, score double, rank int")
    whole = [w for w, begin in slots if not begin]
    meant = F.col("term").isin(whole) if whole else F.lit(False)
    for w, begin in slots:
        meant = meant | F.col("term").startswith(w) if begin else meant
    rows = levels.read(spark, path, "postings", state, _schema(kind)).where((F.col("term") != "") & meant)
    wanted = ["term", "key", "origin", "doc", "length", "tf", *(["gaps"] if phrases else [])]
    rows = _alive(rows.select(*wanted), _deleted(spark, path, state))
    # each posting counts for the slots that it fits
    fits = F.array_compact(F.array(*[F.when(F.col("term").startswith(w) if begin else F.col("term") == w, F.lit(i)) for i, (w, begin) in enumerate(slots)]))
    each = rows.withColumn("slot", F.explode(fits))
    if any(begin for _, begin in slots):
        gaps = [F.max_by("gaps", "tf").alias("gaps"), F.max("term").alias("term")] if phrases else []
        each = each.groupBy("slot", "key").agg(F.sum("tf").alias("tf"), F.first("length").alias("length"), *gaps)
    known = each.groupBy("slot").agg(F.count("*").alias("df"))  # a row a slot
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / mean))
    found = [F.collect_list(F.when(F.col("term").isin([w for p in phrases for w in p]), F.struct("term", "gaps"))).alias("found")] if phrases else []
    scores = each.join(F.broadcast(known), "slot").groupBy("key").agg(F.sum(part).alias("score"), F.count("*").alias("slots"), *found).where(F.col("slots") == len(slots))
    for phrase in phrases:
        scores = scores.where(_adjacent(phrase)("found"))
    return ranked(scores.select(F.col("key").alias(key), "score"), key, depth)
