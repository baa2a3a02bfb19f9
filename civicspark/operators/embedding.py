"""Embedding of texts by a service: batches within a task, retries, and single texts where a batch fails."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Attempts after the first, and the first wait in seconds, which doubles.
RETRIES, WAIT = 4, 0.2

Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]


class Busy(Exception):
    """The service asks to come again (429 or 5xx)."""


def _sent(embed: Embedder, texts: Sequence[str], wait: float) -> Sequence[Sequence[float]] | None:
    """Vectors of a batch, after some retries; None when their number is wrong or the service stays busy."""
    for turn in range(RETRIES + 1):
        try:
            found = embed(texts)
        except Busy:
            if turn < RETRIES:
                time.sleep(wait * 2**turn * (1 + random.random() / 2))
        else:
            return found if len(found) == len(texts) else None
    return None


def embedded(docs: DataFrame, key: str, text: str, embed: Embedder, batch: int = 64, wait: float = WAIT) -> DataFrame:
    """(key, vector, sent): vectors of texts, and how many texts were sent along with each.

    An empty text is never sent and has no vector.  A batch that fails is sent again
    text by text; a text that fails alone has no vector.  A task holds one batch.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), batch):
                part = frame.iloc[lo : lo + batch]
                blank = part[text].fillna("").str.strip() == ""
                own = part[~blank]
                found = _sent(embed, own[text].tolist(), wait) if len(own) else []
                sent = len(own)
                if found is None:
                    found, sent = [(_sent(embed, [x], wait) or [None])[0] for x in own[text]], 1
                out = pd.DataFrame({key: own[key], "vector": [None if v is None else [float(x) for x in v] for v in found], "sent": sent})
                none = pd.DataFrame({key: part[blank][key], "vector": None, "sent": 0})
                yield pd.concat([out, none]) if len(own) and blank.any() else out if len(own) else none

    return docs.select(key, text).mapInPandas(run, f"`{key}` {dict(docs.dtypes)[key]}, vector array<double>, sent int")


def to_embed(diff: DataFrame, bodies: DataFrame, key: str) -> DataFrame:
    """Bodies of the documents whose action asks for a new vector."""
    return bodies.join(diff.where(F.col("action").isin("insert", "update", "reembed")).select(key), key, "left_semi")
