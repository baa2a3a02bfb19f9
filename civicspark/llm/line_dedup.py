"""Line deduplication by an exact set-similarity join.

A line is the set of its distinct words.  It is removed when an earlier line (by
document id, then text hash, then line number) has a Jaccard similarity of at least
`percent` / 100 with it, whether or not that one stays.

1. Words are ordered by rarity: counts over all documents, in BUCKETS hashed
   buckets, at most 12 MB at the driver (any one order gives exact results; the
   finer the counts, the fewer the candidates).
2. Equal sets become one, with its first place; later ones are removed.  Rows that
   repeat id and text have a number each, so one row of the first place is left.
3. The words of a set's prefix are its keys; of a word that comes more than
   FREQUENT times in the documents, each pair with the next words is a key instead
   (similar sets that differ share four words at least, so if the first they share
   is frequent they share a pair).  Sets of over LONG words keep single words, in a
   space of their own, in which shorter sets that may be similar to one take part.  So the sets that meet at a key stay few as the
   corpus grows.
4. The STARS words of least hash in a prefix bring similar sets together: where more
   than HOT meet, each is checked against
   the CENTRES earliest and as many others, and those with a match are done with.  What is left is probed by its full
   prefix against the shorter prefixes that an index of no longer sets needs (and
   against full ones of sets that are done with, which do not probe).  The join
   applies, most telling first, a filter by 64 parity bits (each word flips one, so
   sets cannot differ in fewer words than in bits), the length filter, the
   positional one (what can still be common after the word), and one by 128 parity
   bits for sets of over WIDE words, of which 64 bits part too few.
5. The words of candidates' lines, and of no others, are read again from the texts, with 512 parity bits of each set,
   which part nearly all pairs that are not similar before their words meet; of the
   others the Jaccard similarity is taken exactly.

Defined cases: blank lines always stay; a null text has no lines; rows that repeat
id and text are one document, different texts of one id are several; a null id
comes before all others; extra columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civicspark.llm import text as tx
from civicspark.llm.rows import KEY, keyed
from civicspark.llm.scratch import drop, save, sent

BUCKETS = 1 << 21
#: Buckets whose counts are a row on their way.
CHUNK = 1 << 12
#: A word of more occurrences is a key only together with another.
FREQUENT = 1024
#: Sets of more words keep single frequent words as keys, apart from those of shorter ones, as their pairs would be too many.
LONG = 128
#: Sets of more words have 128 parity bits.
WIDE = 64
#: The sets of keys of more sets are compared with so many earliest ones and as many others first; so many of a set's keys take part.
HOT, CENTRES, STARS = 256, 32, 3
#: A column's name while lines are removed; no table should have it.
GONE = "_civicspark_gone_lines"
#: What names a line.
PLACE = ["id", "key", "line"]

_COUNTS = pa.schema([("chunk", pa.int32()), ("buckets", pa.binary()), ("n", pa.binary())])
_RANKS = pa.schema([("chunk", pa.int32()), ("ranks", pa.binary())])
_LINES = "a long, parity long, wide long, id long, key long, line int, copy long, n int, keys array<long>, stars array<long>"
_LINES_ARROW = pa.schema([("a", pa.int64()), ("parity", pa.int64()), ("wide", pa.int64()), ("id", pa.int64()), ("key", pa.int64()), ("line", pa.int32()), ("copy", pa.int64()), ("n", pa.int32()), ("keys", pa.list_(pa.int64())), ("stars", pa.list_(pa.int64()))])
#: Longs of the parity bits that candidates are compared by.
FLIPS = [f"f{i}" for i in range(8)]
_SETS_ARROW = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("line", pa.int32()), ("words", pa.binary()), ("n", pa.int32()), *[(f, pa.int64()) for f in FLIPS]])
_PLACE_ARROW = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("line", pa.int32())])


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(40)).astype(np.int64) % BUCKETS


def _rank(n: np.ndarray) -> np.ndarray:
    """The order of words by their counts, rarest first, in 12 bits."""
    return np.minimum(np.round(64 * np.log2(np.asarray(n) + 1.0)), 4095).astype(np.uint16)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, held, size = np.zeros(BUCKETS, np.int64), [], 0
    for _, data, offsets in tx.blocks(batches):
        held.append(_bucket(tx.words(data, offsets).hashes))
        size += len(held[-1])
        if size > BUCKETS:
            n += np.bincount(np.concatenate(held), minlength=BUCKETS)
            held, size = [], 0
    if held:
        n += np.bincount(np.concatenate(held), minlength=BUCKETS)
    some = [np.flatnonzero(x) for x in n.reshape(-1, CHUNK)]
    chunks = [i for i, x in enumerate(some) if len(x)]
    yield tx.record(_COUNTS, chunks, [some[i].astype(np.uint16).tobytes() for i in chunks], [n[i * CHUNK + some[i]].tobytes() for i in chunks])


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ranks of the buckets of each chunk, by the sums of its counts; a chunk's rows are in one task."""
    sums = {}
    for batch in batches:
        for chunk, buckets, n in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            total = sums.setdefault(chunk, np.zeros(CHUNK, np.int64))
            total[np.frombuffer(buckets, np.uint16)] += np.frombuffer(n, np.int64)
    yield tx.record(_RANKS, list(sums), [_rank(n).tobytes() for n in sums.values()])


def _line_of(w: tx.Words, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word the number of its line in the block (texts begin lines, too); of each text the first line."""
    breaks = np.flatnonzero(w.data == 10)
    inner = np.searchsorted(breaks, w.starts)
    text = w.text_of()
    return inner + text, np.searchsorted(breaks, offsets[:-1]) + np.arange(len(offsets) - 1)


def _sets(hashes: np.ndarray, line: np.ndarray, rank: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words by line, rarest first (by hash without ranks): hashes, edges of lines, the lines."""
    key = hashes if rank is None else (rank[_bucket(hashes)].astype(np.uint64) << np.uint64(52)) | (hashes >> np.uint64(12))
    order = np.argsort(key)
    order = order[np.argsort((line[order] if line[-1:].sum() > 65535 else line[order].astype(np.uint16)), kind="stable")]
    line, hashes = line[order], hashes[order]
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (hashes[1:] != hashes[:-1])
    line, hashes = line[new], hashes[new]
    begins = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)
    return hashes, np.append(begins, len(line)), line[begins]


def _names(batch: pa.RecordBatch, rows: np.ndarray, *columns: str) -> list[pa.Array]:
    """Ids and keys of rows of a batch, and more columns."""
    return [batch.column(c).take(pa.array(rows)) for c in ("id", "key", *columns)]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _keys(hashes: np.ndarray, edges: np.ndarray, ranks: np.ndarray, percent: int, frequent: int, long: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The keys of sets (hash << 20 | place << 1 | in the index), how many each has, and the same of star words.

    A set of n words probes with its n - ceil(t n) + 1 rarest; met by no shorter
    ones, n - ceil(2 t / (1 + t) n) + 1 are enough.  Words of one occurrence meet nothing.
    """
    n = np.diff(edges)
    probe = n - -(-n * percent // 100) + 1
    index = n - -(-2 * percent * n // (100 + percent)) + 1
    owner = np.repeat(np.arange(len(n)), probe)
    at = _ranges(edges[:-1], probe)
    place = at - edges[owner]
    often = ranks[at] > _rank(frequent)
    use = (ranks[at] > _rank(1)) & ~often
    # pairs of a frequent word and one of those after it, as far as one word beyond the prefix
    few = often & (n[owner] <= long)
    most = np.minimum(probe, n - 1)[owner[few]] - place[few]
    left, right = np.repeat(at[few], most), _ranges(at[few] + 1, most)
    pair_owner = np.repeat(owner[few], most)
    many = often & (100 * n[owner] >= percent * long)
    hashed = np.concatenate([tx.mix(hashes[at[use]]), tx.mix(hashes[left] + tx.mix(hashes[right])), tx.mix(~hashes[at[many]])])
    who = np.concatenate([owner[use], pair_owner, owner[many]])
    where = np.concatenate([place[use], left - edges[pair_owner], place[many]])
    indexed = np.concatenate([place[use] < index[owner[use]], right - edges[pair_owner] <= index[pair_owner], place[many] < index[owner[many]]])
    order = np.argsort(who, kind="stable")
    packed = (hashed >> np.uint64(20) << np.uint64(20)) | (np.minimum(where, (1 << 19) - 1).astype(np.uint64) << np.uint64(1)) | indexed.astype(np.uint64)
    warm = np.flatnonzero(ranks[at] > _rank(1))
    stars = tx.mix(hashes[at[warm]])
    best = np.lexsort((stars, owner[warm]))
    stars, of = stars[best], owner[warm][best]
    turn = np.arange(len(of)) - np.searchsorted(of, of)
    return packed[order], np.bincount(who, minlength=len(n)), stars[turn < STARS], np.bincount(of[turn < STARS], minlength=len(n))


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(tx.signed(values)))


def _lines(shared, percent: int, frequent: int, long: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        for batch, data, offsets in tx.blocks(batches):
            w = tx.words(data, offsets)
            if not len(w.hashes):
                continue
            line, first = _line_of(w, offsets)
            hashes, edges, line = _sets(w.hashes, line, rank)
            text = np.searchsorted(first, line, "right") - 1
            one = np.add.reduceat(tx.mix(hashes), edges[:-1])
            bit = tx.mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
            flip = np.uint64(1) << (bit >> np.uint64(58))
            parity = np.bitwise_xor.reduceat(flip, edges[:-1])
            # of 128 bits, those of the upper half; the lower half are parity ^ wide
            wide = np.bitwise_xor.reduceat(np.where(bit & np.uint64(1), flip, np.uint64(0)), edges[:-1])
            wide[np.diff(edges) <= WIDE] = 0
            keys, sizes, stars, few = _keys(hashes, edges, rank[_bucket(hashes)], percent, frequent, long)
            own, key, copy = _names(batch, text, "copy")
            yield tx.record(_LINES_ARROW, tx.signed(one), tx.signed(parity), tx.signed(wide), own, key, (line - first[text]).astype(np.int32), copy, np.diff(edges).astype(np.int32), _lists(keys, sizes), _lists(stars, few))

    return run


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the lines that `lines` names, by hash, their number and parity bits: each word flips one.  No such line is blank."""
    for batch, data, offsets in tx.blocks(batches):
        asked, of = tx.lists(batch, "lines")
        if not len(asked):
            continue
        owner = np.repeat(np.arange(batch.num_rows), np.diff(of))
        # the asked lines' bytes, each as a text; texts begin lines, too
        breaks = np.flatnonzero(data == 10)
        first = np.searchsorted(breaks, offsets[:-1])
        begins = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
        at = first[owner] + owner + asked
        lo, hi = begins[at], np.append(begins[1:], len(data))[at]
        edges = np.append(0, np.cumsum(hi - lo))
        w = tx.words(data[_ranges(lo, hi - lo)], edges)
        hashes, edges, _ = _sets(w.hashes, w.text_of(), None)
        sizes = np.diff(edges)
        words = np.ascontiguousarray(hashes)
        ends = (8 * edges).astype(np.int32)
        binary = pa.Array.from_buffers(pa.binary(), len(asked), [None, pa.py_buffer(ends), pa.py_buffer(words)])
        bit = tx.mix(hashes ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(55)
        flip = np.uint64(1) << (bit & np.uint64(63))
        flips = [np.bitwise_xor.reduceat(np.where(bit >> np.uint64(6) == k, flip, np.uint64(0)), edges[:-1]) for k in range(len(FLIPS))]
        yield tx.record(_SETS_ARROW, *_names(batch, owner), asked.astype(np.int32), binary, sizes.astype(np.int32), *map(tx.signed, flips))


def _similar(percent: int):
    """Of rows (id, key, line, x_words, y_words) those whose sorted sets of hashes are similar."""

    def sets(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = tx.texts(batch, name)
        return data[offsets[0] : offsets[-1]].view(np.uint64), np.diff(offsets) // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                batch = whole.slice(lo, 4096)
                (x, nx), (y, ny) = sets(batch, "x_words"), sets(batch, "y_words")
                # rows one after the other, and hashes in order: one search finds what is common
                row = lambda n: np.repeat(np.arange(len(n), dtype=np.uint64), n) << np.uint64(50)
                own, other = row(nx) | (x >> np.uint64(14)), row(ny) | (y >> np.uint64(14))
                at = np.minimum(np.searchsorted(own, other), max(0, len(own) - 1))
                common = (own[at] == other) & (x[at] == y) if len(own) else np.zeros(len(other), bool)
                both = np.bincount(np.repeat(np.arange(len(ny)), ny)[common], minlength=len(ny))
                ok = pa.array(100 * both >= percent * (nx + ny - both))
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(ok) for i in (0, 1, 2)], schema=_PLACE_ARROW)

    return run


def _earlier(y: str, x: str) -> str:
    """Whether y stands before x; a null id is before all others."""
    return f"({y}.id < {x}.id or ({y}.id is null and {x}.id is not null) or ({y}.id <=> {x}.id and ({y}.key < {x}.key or ({y}.key = {x}.key and {y}.line < {x}.line))))"


def _same(x: str, y: str) -> str:
    return " and ".join(f"{x}.{c} <=> {y}.{c}" for c in PLACE)


def _exploded(sets: DataFrame) -> DataFrame:
    """A row (word, at, ...) for each key of a set; at, as the rows are many: n << 21 | place << 2 | in the index << 1 | open."""
    packed = sets.select(F.explode("keys").alias("k"), "n", "open", *[c for c in sets.columns if c not in ("keys", "n", "open")])
    at = F.expr("shiftleft(n::long, 21) | shiftleft(k & 1048575L, 1) | if(open, 1L, 0L)")
    return packed.select(F.shiftright("k", 20).alias("word"), at.alias("at"), *packed.columns[3:])


def removed(docs: DataFrame, percent: int, frequent: int = FREQUENT, hot: int = HOT, long: int = LONG) -> DataFrame:
    """(id, key, line) of the lines to remove, for docs (id, key, text)."""
    spark = docs.sparkSession
    counts = docs.select("text").mapInArrow(_counted, "chunk int, buckets binary, n binary").repartition("chunk")
    ranks = counts.mapInArrow(_ranked, "chunk int, ranks binary").toArrow()  # BUCKETS numbers of 16 bits at most
    rank = np.zeros((BUCKETS // CHUNK, CHUNK), np.uint16)
    for chunk, own in zip(*(x.to_pylist() for x in ranks.columns), strict=True):
        rank[chunk] = np.frombuffer(own, np.uint16)
    shared = spark.sparkContext.broadcast(rank.reshape(-1))
    # copy: tells rows apart that repeat id and text
    copies = docs.withColumn("copy", F.monotonically_increasing_id())
    lines = save(copies.mapInArrow(_lines(shared, percent, frequent, long), _LINES))
    # equal sets: the row of the first place stays
    first = lines.groupBy("a", "parity").agg(F.min(F.struct(*PLACE, "copy")).alias("f"), F.count("*").alias("k")).where("k > 1").drop("k")
    first = save(first.withColumnsRenamed({"a": "f_a", "parity": "f_parity"}))
    marked = lines.join(sent(first), F.expr("a = f_a and parity = f_parity"), "left").withColumn("first", F.expr("f is null or f <=> struct(id, key, line, copy)"))
    later = save(marked.where("not first").select(*PLACE, F.expr("f.id <=> id and f.key = key and f.line = line").alias("same")))
    again, repeats = later.where("not same").select(*PLACE), not later.where("same").isEmpty()
    sets = save(marked.where("first").select("id", "key", "line", "n", "parity", "wide", "keys", "stars"))
    drop(lines, first)

    def close(x_n: str, y_n: str) -> str:
        """Whether the lengths and the parity bits, which part most, let x and y be similar."""
        bits = f"bit_count(x.parity ^ y.parity) * {100 + percent} <= {100 - percent} * ({x_n} + {y_n})"
        return f"{bits} and 100 * least({x_n}, {y_n}) >= {percent} * greatest({x_n}, {y_n})"

    def paired(rows: DataFrame) -> DataFrame:
        """(x_id, ..., y_id, ...) once for each pair of rows (x, y)."""
        return save(rows.select(*[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in "xy" for c in PLACE]).distinct())

    def check(pairs: DataFrame) -> DataFrame:
        """The places x of pairs that are similar; the table of pairs is dropped."""
        asked = pairs.select(F.explode(F.array(*[F.struct(*[F.col(f"{side}_{c}").alias(c) for c in PLACE]) for side in "xy"])).alias("at"))
        asked = asked.distinct().groupBy(F.col("at.id").alias("own"), F.col("at.key").alias("own_key")).agg(F.collect_list("at.line").alias("lines"))
        asked = save(asked)
        columns = f"id long, key long, line int, words binary, n int, {', '.join(f'{f} long' for f in FLIPS)}"
        words = docs.join(sent(asked, "lines"), F.expr("id <=> own and key = own_key")).select("id", "key", "text", "lines").mapInArrow(_words_of, columns)
        words = save(words.dropDuplicates(PLACE) if repeats else words)
        drop(asked)

        def beside(some: DataFrame, side: str, *columns: str) -> DataFrame:
            """Pairs with columns of the words of one side, named after it."""
            own = words.select(*[F.col(c).alias(f"w_{c}") for c in PLACE], *[F.col(c).alias(f"{side}_{c}") for c in columns])
            return some.join(own, F.expr(f"{side}_id <=> w_id and {side}_key = w_key and {side}_line = w_line")).drop("w_id", "w_key", "w_line")

        apart = " + ".join(f"bit_count(x_{f} ^ y_{f})" for f in FLIPS)
        near = beside(beside(pairs, "x", "n", *FLIPS), "y", "n", *FLIPS).where(f"({apart}) * {100 + percent} <= {100 - percent} * (x_n + y_n)")
        near = save(near.select(*pairs.columns))
        both = beside(beside(near, "x", "words"), "y", "words").select(*[F.col(f"x_{c}").alias(c) for c in PLACE], "x_words", "y_words")
        found = save(both.mapInArrow(_similar(percent), "id long, key long, line int").distinct())
        drop(pairs, words, near)
        return found

    stars = sets.select(F.explode("stars").alias("word"), *PLACE, "n", "parity")
    many = save(stars.groupBy("word").agg(F.count("*").alias("k")).where(F.col("k") > hot).select("word"))
    stars = save(stars.join(sent(many), "word", "left_semi"))
    first_by = lambda *order: stars.withColumn("turn", F.row_number().over(Window.partitionBy("word").orderBy(*order))).where(F.col("turn") <= CENTRES).drop("turn")
    centres = save(first_by(*PLACE).unionByName(first_by(F.xxhash64("word", *PLACE), *PLACE)))
    done = check(paired(stars.alias("x").join(centres.alias("y"), F.expr(f"x.word = y.word and {close('x.n', 'y.n')} and {_earlier('y', 'x')}"))))
    drop(many, stars, centres)

    marks = sets.drop("stars").alias("s").join(sent(done).withColumn("done", F.lit(True)).alias("d"), F.expr(_same("s", "d")), "left")
    every = _exploded(marks.select("s.*", F.col("done").isNull().alias("open")))
    # the longer set, or of equal ones the later, probes; of a pair the later one must be open, and only open ones probe
    before = _earlier("y", "x")
    x_n, y_n = (f"shiftright({side}.at, 21)" for side in "xy")
    left = [f"{n} - (shiftright({side}.at, 2) & {(1 << 19) - 1})" for side, n in (("x", x_n), ("y", y_n))]
    fits = f"{close(x_n, y_n)} and least({', '.join(left)}) * {100 + percent} >= {percent} * ({x_n} + {y_n})"
    wide = "bit_count(x.wide ^ y.wide) + bit_count(x.parity ^ x.wide ^ y.parity ^ y.wide)"
    fits = f"{fits} and (least({x_n}, {y_n}) <= {WIDE} or ({wide}) * {100 + percent} <= {100 - percent} * ({x_n} + {y_n}))"
    longer = f"y.at & 2 > 0 and ({x_n} > {y_n} and ({before} or y.at & 1 > 0) or {x_n} = {y_n} and {before})"
    shorter = f"x.at & 2 > 0 and {x_n} < {y_n} and y.at & 1 = 0 and {before}"
    # open ones against those of the index or done with
    met = every.where("at & 1 > 0").alias("x").join(every.where("at & 3 != 1").alias("y"), F.expr(f"x.word = y.word and {fits} and ({longer} or {shorter})"))
    rows = F.struct(*[F.struct(*[F.col(f"{side}.{c}").alias(c) for c in PLACE]).alias(side) for side in "xy"])
    met = met.select(rows.alias("r"), F.expr(before).alias("before"))
    pairs = paired(met.select(F.expr("if(before, r.x, r.y)").alias("x"), F.expr("if(before, r.y, r.x)").alias("y")))
    drop(sets)
    return again.unionByName(done).unionByName(check(pairs)).distinct()


def _named(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return keyed(rows, "id").select("id", F.col(KEY).alias("key"), "text")


def _by_document(gone: DataFrame) -> DataFrame:
    """(GONE_id, GONE_key, GONE): the removed lines of each document that has some, in order."""
    return save(gone.groupBy(F.col("id").alias(f"{GONE}_id"), F.col("key").alias(f"{GONE}_key")).agg(F.array_sort(F.collect_list("line")).alias(GONE)))


def removed_lines(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", frequent: int = FREQUENT, hot: int = HOT, long: int = LONG) -> DataFrame:
    """Per row of docs: its id, n_lines, n_removed and the removed lines' numbers, from 0 and comma-joined."""
    rows = _named(docs, id_col)
    gone = _by_document(removed(rows, percent, frequent, hot, long))
    text = F.coalesce("text", F.lit(""))
    n = F.when(text == "", 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    out = rows.select("id", "key", n.cast("long").alias("n_lines")).join(gone, F.expr(f"id <=> {GONE}_id and key = {GONE}_key"), "left")
    return out.select(F.col("id").alias(id_col), "n_lines", F.coalesce(F.size(GONE), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join(GONE, ","), F.lit("")).alias("removed"))


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their removed lines; the column of these is dropped."""
    for whole in batches:
        for batch, _, _ in tx.blocks(iter([whole])):
            at, of = batch.schema.get_field_index("text"), batch.schema.get_field_index(GONE)
            column, gone = batch.column(at), batch.column(of)
            if gone.null_count < batch.num_rows:
                texts = column.to_pylist()
                for i, drop_ in enumerate(gone.to_pylist()):
                    if drop_ is not None:
                        drop_ = set(drop_)
                        texts[i] = "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in drop_)
                column = pa.array(texts, pa.string())
            keep = [i for i in range(batch.num_columns) if i != of]
            yield pa.RecordBatch.from_arrays([column if i == at else batch.column(i) for i in keep], names=[batch.schema.field(i).name for i in keep])


def remove_lines(docs: DataFrame, percent: int = 80, id_col: str = "doc_id") -> DataFrame:
    """docs with the removed lines gone from text; all columns stay."""
    rows = keyed(docs, id_col)
    gone = _by_document(removed(rows.select(F.col(id_col).cast("long").alias("id"), F.col(KEY).alias("key"), "text"), percent))
    rows = rows.join(sent(gone, GONE), F.col(id_col).cast("long").eqNullSafe(F.col(f"{GONE}_id")) & (F.col(KEY) == F.col(f"{GONE}_key")), "left").drop(f"{GONE}_id", f"{GONE}_key", KEY)
    return rows.mapInArrow(_rewritten, docs.schema)
