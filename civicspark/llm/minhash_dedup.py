"""Near-duplicates: minima of universal hashes, banding, verification, components.

A document is the set of its distinct `shingle`-word sequences, lower-cased in
A-Z; with fewer words, the whole sequence is its one shingle.  Two documents are
linked when their sets' Jaccard similarity is at least `percent` / 100.

1. Each set gets BANDS * ROWS minima of hashes a * x + b; each band's minima make
   a bucket.  A pair at 0.8 shares none with a chance of (1 - 0.8**5)**40, 1.3e-7.
2. Equal sets are one from here on (a numbered node, whose text is that of the row
   with the least id), so a group of thousands of copies is one row.
3. Star rounds: each bucket names a centre, first by one order for all bands, then
   by another for each, and the members of other components are checked against it;
   the centre is then done with in its bucket.  Buckets with one component left are
   done with, too, so a group of near copies shrinks by a large part each round.
   When a round leaves more than half of the members outside their bucket's largest
   component, these are joined with the others of the bucket.
4. A bucket's join compares signatures of a bit a minimum (five standard deviations
   of slack) and 512 parity bits of the sets, which are an exact bound; a check then
   compares the full shingle sets.
5. Components: see `components`; the nodes of an id with several texts are linked,
   too, and a component is named by the least id among its nodes.

Defined cases: a null or empty text has no shingles and is linked with nothing;
rows of one id are one document, whose texts' links are all its own (each row has
its text's n_shingles); a row without an id is linked with nothing and kept; extra
columns are untouched.  Shingles are told apart by 64-bit
hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.llm import text as tx
from civicspark.llm.components import components
from civicspark.llm.rows import KEY, keyed
from civicspark.llm.scratch import drop, save, sent

BANDS, ROWS = 40, 5
_RANDOM = np.random.Generator(np.random.PCG64(808))
_A = _RANDOM.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_B = _RANDOM.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_JOIN = _RANDOM.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _RANDOM.integers(0, 2**63, BANDS, dtype=np.uint64)

#: Longs that hold a bit of each minimum.
BITS = [f"bit{i}" for i in range(-(-BANDS * ROWS // 64))]
#: Longs that hold parities of the set: each shingle flips one bit of 512, so sets cannot differ in fewer shingles than in bits.
FLIPS = [f"flip{i}" for i in range(8)]
_SIGNED = "id long, key long, n long, a long, b long, bands array<long>, " + ", ".join(f"{x} long" for x in BITS + FLIPS)
_SIGNED_ARROW = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("bands", pa.list_(pa.int64())), *[(x, pa.int64()) for x in BITS + FLIPS]])


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of the texts of a block, with repeats, and each text's first."""
    w = tx.words(tx.LOWER[data], offsets)
    gram = tx.grams(w.hashes, size)
    left, counts = w.left(), w.counts
    use = left >= size
    short = np.flatnonzero((counts > 0) & (counts < size))
    for i in short:  # the whole sequence, told from longer texts' shingles by its length
        own = w.hashes[w.first[i] : w.first[i + 1]]
        gram[w.first[i]] = tx.grams(own, len(own))[0]
        use[w.first[i]] = True
    return gram[use], np.concatenate([[0], np.cumsum(use)])[w.first]


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in tx.blocks(batches):
            gram, first = shingles(data, offsets, size)
            rows = len(first) - 1
            n, one, two = np.zeros(rows, np.int64), np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
            flips = np.zeros((rows, 64 * len(FLIPS)), np.uint8)
            for i in range(rows):
                own = np.unique(gram[first[i] : first[i + 1]])
                n[i], one[i], two[i] = len(own), own.sum(dtype=np.uint64), tx.mix(own).sum(dtype=np.uint64)
                flips[i] = np.bincount((tx.mix(own ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(55)).astype(np.int64), minlength=512) & 1
            full = np.flatnonzero(n)
            least = np.zeros((BANDS * ROWS, rows), np.uint32)
            if len(full):
                x = (gram >> np.uint64(32)).astype(np.uint32)
                for k in range(BANDS * ROWS):
                    least[k, full] = np.minimum.reduceat(x * _A[k] + _B[k], first[full])
            bands = np.empty((rows, BANDS), np.uint64)
            for j in range(BANDS):
                part = least[j * ROWS : (j + 1) * ROWS].astype(np.uint64)
                bands[:, j] = tx.mix((part * _JOIN[j][:, None]).sum(0, dtype=np.uint64) + _SALT[j])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * BANDS, pa.int32()), pa.array(tx.signed(bands.ravel())))
            bits = np.zeros((rows, 64 * len(BITS)), np.uint8)
            bits[:, : BANDS * ROWS] = (tx.mix(least.astype(np.uint64)) & np.uint64(1)).T
            bits = np.packbits(bits, axis=1).view(np.int64)
            yield tx.record(_SIGNED_ARROW, batch.column(0), batch.column(1), n, tx.signed(one), tx.signed(two), lists, *[np.ascontiguousarray(x) for y in (bits, np.packbits(flips, axis=1).view(np.int64)) for x in y.T])

    return run


_PAIR_ARROW = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _verified(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in tx.blocks(batches, "text"):
            one, lo = shingles(data, offsets, size)
            two, at = shingles(*_own(*tx.texts(batch, "other")), size)
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = np.unique(one[lo[i] : lo[i + 1]]), np.unique(two[at[i] : at[i + 1]])
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(ok)) for i in (0, 1)], schema=_PAIR_ARROW)

    return run


def _own(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: its id, n_shingles, component_id (the least id reachable) and kept (it is that id)."""
    docs = keyed(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "id")
    signed = save(docs.select("id", KEY, "text").mapInArrow(_sign(shingle), _SIGNED))
    usable = signed.where("n > 0 and id is not null")
    groups = usable.groupBy("a", "b").agg(F.min(F.struct("id", "key")).alias("first"))
    groups = save(groups.select("a", "b", F.col("first.id").alias("rep"), F.col("first.key").alias("rep_key"), F.monotonically_increasing_id().alias("node")))
    equal = F.col("id").isNotNull() & (F.col("n") > 0) & (F.col("a") == F.col("its_a")) & (F.col("b") == F.col("its_b"))
    copies = save(signed.select("id", "n", "a", "b").join(groups.select(F.col("a").alias("its_a"), F.col("b").alias("its_b"), "rep", "node"), equal, "left").select("id", "n", "rep", "node"))
    first = (F.col("id") == F.col("rep")) & (F.col("key") == F.col("rep_key"))
    reps = usable.join(groups.select("rep", "rep_key", "node"), first).dropDuplicates(["node"])
    sigs = save(reps.select(F.col("node").alias("id"), "n", "bands", *BITS, *FLIPS))
    drop(signed)
    banded = sigs.select("id", "n", F.explode("bands").alias("band"), *BITS, *FLIPS)
    shared = save(banded.groupBy("band").agg(F.count("*").alias("many")).where("many > 1").select("band"))
    members = save(banded.join(shared, "band", "left_semi").withColumn("label", F.col("id")))
    some = save(members.select(F.col("id").alias("own")).distinct())
    wanted = groups.join(some, F.col("node") == F.col("own"), "left_semi").select("rep", "rep_key", "node")
    held = docs.join(wanted, (F.col("id") == F.col("rep")) & (F.col(KEY) == F.col("rep_key")))
    held = save(held.select(F.col("node").alias("id"), "text").dropDuplicates(["id"]))
    drop(shared, some)
    # sets may be similar when so few bits differ, half of the minima that do and five standard deviations
    differ = int(BANDS * ROWS * ((1 - percent / 100) / 2 + 5 * (0.25 / (BANDS * ROWS)) ** 0.5))
    near = " + ".join(f"bit_count(a.{x} ^ b.{x})" for x in BITS)
    flipped = " + ".join(f"bit_count(a.{x} ^ b.{x})" for x in FLIPS)
    close = f"a.label <> b.label and 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) and {near} <= {differ} and ({flipped}) * {100 + percent} <= {100 - percent} * (a.n + b.n)"

    def check(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()
        pairs = pairs.join(held.select(F.col("id").alias("u"), "text"), "u").join(held.select(F.col("id").alias("v"), F.col("text").alias("other")), "v")
        return save(pairs.select("u", "v", "text", "other").mapInArrow(_verified(shingle, percent), "u long, v long"))

    def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
        """Components once links are there, too."""
        known = links if labels is None else links.unionByName(labels.select(F.col("id").alias("u"), F.col("component").alias("v")))
        now = save(components(known))
        drop(links, *([] if labels is None else [labels]))
        return now

    labels = seen = None
    for turn in count():
        if labels is not None:
            # members of the buckets that still hold two components, with the largest of each
            rows = members.drop("label").join(labels, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
            largest = rows.groupBy("band", "label").agg(F.count("*").alias("k")).groupBy("band").agg(F.max_by("label", "k").alias("main"), F.count("*").alias("kinds"))
            before, members = members, save(rows.join(largest.where("kinds > 1").drop("kinds"), "band"))
            drop(before)
            now = members.where("label <> main").count()
            if not now or turn > 2 and now > seen / 2:
                break
            seen = now
        order = F.xxhash64("id", "band") if turn else F.xxhash64("id")
        centre = members.groupBy("band").agg(F.min(F.struct(order.alias("o"), "id", "label", "n", *BITS, *FLIPS)).alias("c")).select("band", "c.*")
        own = [F.col(f"a.{c}") for c in ("id", "n", "label", *BITS, *FLIPS)]
        star = save(members.alias("a").join(centre.alias("b"), "band").select("band", *own, F.col("b.id").alias("centre"), F.expr(close).alias("meets")))
        drop(members)
        labels = merged(labels, check(star.where("meets").select(F.col("id").alias("x"), F.col("centre").alias("y"))))
        members = save(star.where("id <> centre").drop("centre", "meets"))
        drop(star)
    # what is left: those outside the largest component of a bucket, with all others in it; each pair once, from one side and in its first common band
    rest = save(members.join(sigs.select("id", "bands"), "id").withColumn("k", F.array_position("bands", F.col("band")).cast("int")))
    once = "(b.label = b.main or a.id < b.id) and not arrays_overlap(slice(a.bands, 1, a.k - 1), slice(b.bands, 1, a.k - 1))"
    pairs = rest.where("label <> main").alias("a").join(rest.alias("b"), F.expr(f"a.band = b.band and {close} and {once}"))
    labels = merged(labels, check(pairs.select(F.col("a.id").alias("x"), F.col("b.id").alias("y"))))
    drop(members, rest, sigs, held)
    # the nodes of one id belong together, and its rows without shingles with them
    own = copies.where("id is not null").groupBy(F.col("id").alias("own")).agg(F.min("node").alias("v"), F.max("node").alias("most"), F.min_by("rep", "node").alias("its"), F.count("*").alias("k"), F.count("node").alias("full"))
    own = save(own.where("v < most or full between 1 and k - 1"))
    if not own.isEmpty():
        copies = copies.join(sent(own), F.col("id") == F.col("own"), "left")
        labels = merged(labels, save(copies.where("node <> v").select(F.col("node").alias("u"), "v").distinct()))
        copies = copies.select("id", "n", F.coalesce("rep", "its").alias("rep"), F.coalesce("node", "v").alias("node"))
    named = labels.join(groups.select("node", "rep"), F.col("id") == F.col("node"))
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    names = save(labels.join(least, "component").select(F.col("id").alias("node"), "least"))
    drop(labels, groups)
    component = F.coalesce("least", "rep", "id")
    out = copies.join(names, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
