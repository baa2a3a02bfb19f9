"""Token counts at every prefix, by dynamic programming over byte-level BPE.

The encoding of a prefix ends in one token t, and what is before t is the
encoding of a shorter prefix; t is right exactly when t and the last token
before it stay apart as BPE encodes the two alone.  So one pass over the bytes, by
an automaton that knows the tokens ending at each, gives the last token and the
count at every prefix.  The pass runs per distinct
piece of text (white space and what follows it); a piece's result is the change
of the count at each of its characters, one signed byte each, and a document's
is the pieces' one after the other.  `count_at` and `cut_at` answer from these
bytes what a prefix costs and how much of a text a budget holds.

Pieces end where white space follows something else: no token spans such a
place, so pieces can be treated alone.  Within a piece the tokenizer's own rules
part it.  A special token's string in a text is that token, as the library's
default has it.

Defined cases: a null or empty text has no tokens; rows that repeat an id are
counted each; a null id is returned as it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.llm import text as tx

#: The characters with Unicode's White_Space property.
WHITE = "\t-\r \x85\xa0  -     　"
PIECE = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: A plain piece: perhaps a line end, perhaps a space, letters of Latin 1, perhaps one sign.
PLAIN = re.compile(r"\n? ?[A-Za-zÀ-ÖØ-öø-ÿ]+[.,;:!?|%&$#*)]?")
#: Entries of a cache before it becomes the older one; two are kept.
CACHE = 300_000
#: Bytes of a word's beginning whose counts are kept.
HEAD = 6
#: Characters of a text that are looked at together.
PART = 1 << 20
#: Where a piece may begin: white space after something else.
EDGE = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")

_COUNTERS: dict[str, PrefixCounter] = {}


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Recent(dict):
    """A cache of what `make` gives; of full caches the last one stays beside the new."""

    def __init__(self, make, size: int = CACHE):
        super().__init__()
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


class PrefixCounter:
    """Counts of tokens at every prefix: `pieces` has the change at each character of a piece."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(self.letters)}
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.vocab = {bytes(byte_of[c] for c in t): i for t, i in self.tokenizer.get_vocab().items() if t not in special}
        self.bytes_of = {i: t for t, i in self.vocab.items()}
        self.stay = Recent(self.apart, 4 * CACHE)
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        # an automaton that reads bytes: its state is the longest end of what is read that begins a token
        self.begins = {t[:n] for t in self.vocab for n in range(len(t) + 1)}
        self.states: dict[bytes, int] = {}
        self.names: list[bytes] = []
        self.ends: list[list[tuple[int, int]]] = []  # of each state the tokens that end there, longest first
        self.state(b"")
        self.steps = dict[int, int]()
        self.heads = Recent(self.head)
        self.pieces = Recent(self.piece)

    def state(self, name: bytes) -> int:
        if name not in self.states:
            self.states[name] = len(self.names)
            self.names.append(name)
            self.ends.append([(len(name) - k, self.vocab[name[k:]]) for k in range(len(name)) if name[k:] in self.vocab])
        return self.states[name]

    def step(self, key: int) -> int:
        """From a state (key >> 8) by a byte (key & 255)."""
        name = self.names[key >> 8] + bytes([key & 255])
        while name not in self.begins:
            name = name[1:]
        found = self.steps[key] = self.state(name)
        return found

    def apart(self, key: int) -> bool:
        """Whether BPE leaves two tokens (left << 32 | right) as they are."""
        left, right = key >> 32, key & 0xFFFFFFFF
        text = "".join(self.letters[b] for b in self.bytes_of[left] + self.bytes_of[right])
        return [t.id for t in self.tokenizer.model.tokenize(text)] == [left, right]

    def head(self, word: bytes) -> tuple[int, list[int], list[int]]:
        return self.read(word, 0, 0, [-1], [0])

    def read(self, word: bytes, at: int, state: int, last: list[int], count: list[int]) -> tuple[int, list[int], list[int]]:
        """Go on from byte `at`; last, count: the last token and the count at every prefix so far."""
        steps, ends, stay = self.steps, self.ends, self.stay
        for end in range(at + 1, len(word) + 1):
            key = state << 8 | word[end - 1]
            state = steps.get(key)
            if state is None:
                state = self.step(key)
            for size, token in ends[state]:
                if size == end or stay[last[end - size] << 32 | token]:
                    last.append(token)
                    count.append(count[end - size] + 1)
                    break
        return state, last, count

    def counts(self, word: bytes) -> list[int]:
        """Tokens of each prefix of a word that the tokenizer does not part; words of one beginning share its part."""
        state, last, count = self.heads[word[:HEAD]]
        if len(word) > HEAD:
            count = self.read(word, HEAD, state, last.copy(), count.copy())[2]
        return count[1:]

    def parts(self, piece: str) -> list[tuple[str, int]]:
        return [(piece[a:b], a) for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(piece)]

    def piece(self, piece: str) -> bytes:
        """The change of the token count at each character of a piece, a signed byte each."""
        if PLAIN.fullmatch(piece):
            if not piece[-1].isalpha():  # the sign is a part, and a token, of its own
                return self.pieces[piece[:-1]] + b"\x01"
            if piece[0] == "\n":
                return b"\x01" + self.pieces[piece[1:]]
            counts = self.chars(piece)
        else:
            counts = self.general(piece)
        return bytes([(n - before) & 255 for before, n in pairwise([0, *counts])])

    def general(self, piece: str) -> list[int]:
        """Counts at each character of any piece: the parts before a prefix's last one stay, the last one is cut."""
        solid = len(piece) - len(piece.lstrip())
        blank = self.chars(piece[:solid]) if solid else []
        out, done = list(blank), 0
        for part, at in self.parts(piece):
            if at + len(part) <= solid:  # white space before the last of a run; as a prefix's end it is one part with what follows
                done += self.chars(part)[-1]
                continue
            own = self.chars(part)
            if part in ("'re", "'ve", "'ll"):  # cut after two characters it is a sign and a letter
                own = [own[0], self.chars(part[0])[-1] + self.chars(part[1])[-1], own[2]]
            skip = max(0, solid - at)
            out.extend(done + n for n in own[skip:])
            done += own[-1]
        return out

    def chars(self, part: str) -> list[int]:
        counts = self.counts(part.encode())
        if len(counts) == len(part):
            return counts
        ends = accumulate(len(c.encode()) for c in part)
        return [counts[e - 1] for e in ends]

    def _spelt(self, text: str) -> bytes:
        return b"".join(b"".join(map(self.pieces.__getitem__, PIECE.findall(x))) for x in parts(text))

    def changes(self, text: str) -> bytes:
        """The change of the token count at each character of a text."""
        if self.special is None or not self.special.search(text):
            return self._spelt(text)
        *pairs, rest = self.special.split(text)
        out = bytearray()
        for own, token in zip(pairs[::2], pairs[1::2], strict=True):
            with_token = bytearray(self._spelt(own + token))
            with_token[-1] = (total(self._spelt(own)) + 1 - total(bytes(with_token[:-1]))) & 255
            out += with_token
        return bytes(out + self._spelt(rest))


def parts(text: str) -> Iterator[str]:
    """A text in parts of about PART characters, between pieces."""
    lo = 0
    while len(text) - lo > PART:
        edge = EDGE.search(text, lo + PART)
        if not edge:
            break
        yield text[lo : edge.start()]
        lo = edge.start()
    yield text[lo:] if lo else text


def total(changes: bytes) -> int:
    return int(np.frombuffer(changes, np.int8).sum(dtype=np.int64))


def counter(path: str) -> PrefixCounter:
    """One for each tokenizer in a worker; it outlives the task."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def _counted(path: str, keep: bool, budget: int | None, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch, _, offsets in tx.blocks(batches):
            found = [own.changes(x) for x in pc.fill_null(batch.column(1), "").to_pylist()]
            columns = [[total(x) for x in found]]
            if budget is not None:
                columns.append([len(x) if n <= budget else longest(x, budget) for x, n in zip(found, columns[0], strict=True)])
            yield tx.record(schema, batch.column(0), np.diff(offsets), *columns, *([found] if keep else []))

    return run


def prefix_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = True, budget: int | None = None) -> DataFrame:
    """Per row: its id, n_bytes, n_tokens, with a budget `fits`, the characters of the longest prefix of at most so many tokens, and with keep `changes`, the change of the count at each code point.

    path: a byte-level BPE file of `tokenizers`, there on every executor.
    """
    more = [("fits", pa.int64())] * (budget is not None) + [("changes", pa.binary())] * keep
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), *more])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_counted(path, keep, budget, schema), "id long, n_bytes long, n_tokens long" + ", fits long" * (budget is not None) + ", changes binary" * keep)
    return out.withColumnRenamed("id", id_col)


def longest(changes: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most `budget` tokens."""
    fits = np.flatnonzero(np.cumsum(np.frombuffer(changes, np.int8), dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def _count_at(changes, chars):
    return changes.combine(chars, lambda c, n: int(np.frombuffer(c, np.int8)[: max(0, n)].sum(dtype=np.int64)))


def _cut_at(changes, budget):
    return changes.combine(budget, longest)


def count_at(changes: Column | str, chars: Column | int) -> Column:
    """Tokens of a text's first `chars` characters, from `changes`; nothing is encoded again."""
    return F.pandas_udf(_count_at, "long")(changes, F.lit(chars) if isinstance(chars, int) else chars)


def cut_at(changes: Column | str, budget: Column | int) -> Column:
    """Characters of the longest prefix of at most `budget` tokens."""
    return F.pandas_udf(_cut_at, "long")(changes, F.lit(budget) if isinstance(budget, int) else budget)
