"""Secret scans with DataFrame functions only.

Base spans come from three patterns.  The method adds spans of kind `entropy`: a
candidate is a run of at least WINDOW characters of CANDIDATE, and a class's run
within it counts when a sliding window reaches the class's bits of Shannon entropy,
which 99 of 100 windows of random characters of the class do.  Moving the window by
one takes one from the count of a character and adds one to that of another; the
counts, and the sum of k * log2(k), go from step to step.

Allow-lists suppress stretches, not candidates: what matches ALLOWED is cut out
first, and a run made of words (in lower, upper or camel case, joined by separators,
with one number of WORD_DIGITS digits at most) does not count.

Entropy is taken where the texts are read; only the places of matches are
shuffled.  All kinds' matches of a text become rows; a running sum of lengths gives
their places, in code points.  Every pattern reads a text in one pass, and long
runs are looked at in overlapping parts of PART characters.

Defined cases: a null text is empty and has no spans; rows are told apart by
themselves, so repeated rows and null ids are scanned each; extra columns are
untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicspark.llm.scratch import save

#: The base patterns, by kind and in the order of their kinds; the group that is judged, and its least length.
BASE = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
WINDOW = 20
PART = 4096
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Class: its runs within a candidate, and the bits that a window of random characters falls below once in 100 times.
CLASSES = {"hex": (r"[0-9A-Fa-f]{20,}", 2.90), "lower": (r"[a-z0-9]{20,}", 3.40), "upper": (r"[A-Z0-9]{20,}", 3.40), "base64": (r"[A-Za-z0-9+/_=-]{20,}", 3.64)}
#: Not secrets: UUIDs, placeholders, alphabets in order.
ALLOWED = (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", r"EXAMPLE|example|XXXXXX|xxxxxx|000000", r"abcdefgh|ABCDEFGH|01234567")
#: Words and what joins them; what is left of a run of words are a few digits in one place.
WORDS, WORD_DIGITS = r"[A-Z]?[a-z]{2,}|[A-Z]{2,}|[-+/_=]", 4


def _weight(k: Column) -> Column:
    return F.when(k > 1, k * F.log2(k)).otherwise(F.lit(0.0))


def _let(value: Column, then) -> Column:
    """then(value), with the value taken once."""
    return F.get(F.transform(F.array(value), then), 0)


def most_bits(text: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits a character, of any `window` characters in a row; null for shorter texts."""

    def of(codes: Column, counts: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            gone, new = F.get(codes, i - 1) - 1, F.get(codes, i + window - 1) - 1
            out, into = F.get(state["counts"], gone), F.get(state["counts"], new)
            moved = state["now"] + F.when(gone == new, 0.0).otherwise(_weight(out - 1) - _weight(out) + _weight(into + 1) - _weight(into))
            after = F.transform(state["counts"], lambda k, at: k - (at == gone).cast("int") + (at == new).cast("int"))
            return F.struct(after.alias("counts"), moved.alias("now"), F.least(state["least"], moved).alias("least"))

        begin = F.aggregate(counts, F.lit(0.0), lambda a, k: a + _weight(k))
        moves = F.when(F.size(codes) > window, F.sequence(F.lit(1), F.size(codes) - window)).otherwise(F.array().cast("array<int>"))
        least = F.aggregate(moves, F.struct(counts.alias("counts"), begin.alias("now"), begin.alias("least")), step, lambda s: s["least"])
        return F.log2(F.lit(float(window))) - least / window

    def by_kinds(chars: Column, kinds: Column) -> Column:
        codes = F.transform(chars, lambda c: F.array_position(kinds, c).cast("int"))
        counts = F.transform(kinds, lambda kind: F.size(F.filter(F.slice(chars, 1, window), lambda c: c == kind)))
        return _let(codes, lambda own: _let(counts, lambda first: of(own, first)))

    bits = _let(F.split(text, ""), lambda chars: _let(F.array_distinct(chars), lambda kinds: by_kinds(chars, kinds)))
    return F.when(F.length(text) >= window, bits)


def _any_window(run: Column, bits: float) -> Column:
    """Whether a window of a run has so many bits; parts overlap by all but one character of a window."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(run) - WINDOW + 1, F.lit(1)), F.lit(PART))
    part = lambda at: F.substring(run, at, F.lit(PART + WINDOW - 1))
    return F.exists(starts, lambda at: _let(part(at), lambda own: F.coalesce(most_bits(own) >= bits, F.lit(False))))


def _random(value: Column, allowed: Iterable[str]) -> Column:
    """Whether a candidate, without what is allowed, has a run of a class with a window of high entropy."""
    for pattern in allowed:
        value = F.regexp_replace(value, F.lit(pattern), F.lit(" "))

    def by_class(free: Column) -> Column:
        out = F.lit(False)
        for pattern, bits in CLASSES.values():
            out = out | F.exists(F.regexp_extract_all(free, F.lit(pattern), F.lit(0)), _counts(bits))
        return out

    return _let(value, by_class)


def _counts(bits: float):
    """Whether a run is not made of words and has a window of so many bits."""
    return lambda run: ~F.regexp_replace(run, F.lit(WORDS), F.lit(" ")).rlike(f"^ *[0-9]{{0,{WORD_DIGITS}}} *$") & _any_window(run, bits)


def _judged(kind: str, allowed: Iterable[str]):
    """A match (gap, size, value) to (gap, size, ok)."""
    ok = lambda value: _random(value, allowed) if kind == "entropy" else F.length(value) >= BASE[kind][2]
    return lambda x: F.struct(x["gap"].alias("gap"), x["size"].alias("size"), ok(x["value"]).alias("ok"))


def _of_kind(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda x: x.kind == kind)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allowed: Iterable[str] = ALLOWED) -> DataFrame:
    """Per row of docs: its id and `found`, the spans as array<struct<start, kind, end, order>> by start, then kind."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kinds = {k: (p, g) for k, (p, g, _) in BASE.items()} | {"entropy": (CANDIDATE, 0)}
    order = {k: i for i, k in enumerate(kinds)}
    parts = []
    for kind, (pattern, group) in kinds.items():
        all_ = lambda g, p=pattern: F.regexp_extract_all("text", F.lit(p), F.lit(g))
        gaps = F.transform(F.split("text", pattern, -1), F.length)
        zipped = F.arrays_zip(F.slice(gaps, 1, F.size(all_(0))).alias("gap"), F.transform(all_(0), F.length).alias("size"), all_(group).alias("value"))
        zipped = F.transform(zipped, _judged(kind, allowed))
        empty = F.lit(None).cast("array<struct<gap:int,size:int,ok:boolean>>")
        parts.append(F.when(F.col("text").rlike(pattern), zipped).otherwise(empty).alias(kind))
    rows = save(docs.select(F.col(id_col).alias("id"), text.alias("text")).select(F.monotonically_increasing_id().alias("row"), "id", *parts))
    some = rows.where(" or ".join(f"{k} is not null" for k in kinds))
    each = [some.select("row", F.lit(order[k]).alias("order"), F.lit(k).alias("kind"), F.posexplode(k).alias("pos", "m")) for k in kinds]
    spans = each[0]
    for x in each[1:]:
        spans = spans.unionByName(x)
    so_far = Window.partitionBy("row", "order").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    spans = spans.withColumn("end", F.sum(F.col("m.gap") + F.col("m.size")).over(so_far)).withColumn("start", F.col("end") - F.col("m.size")).where("m.ok")
    found = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "order", "kind", "end"))).alias("found"))
    out = rows.select("row", "id").join(found, "row", "left")
    none = F.array().cast("array<struct<start:bigint,order:int,kind:string,end:bigint>>")
    return out.select(F.col("id").alias(id_col), F.coalesce("found", none).alias("found"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of base spans, the SHA-256 of their list, and the list of all spans."""
    base = F.filter("found", lambda x: x.kind != "entropy")
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")
    counts = [F.size(_of_kind("found", kind)).cast("long").alias(f"n_{kind}") for kind in BASE]
    return found.select(id_col, *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))
