"""Metering as Structured Streaming; each stream has a batch twin that gives the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def by_window(events: DataFrame, key: str, at: str, value: str, width: str, late: str | None = None) -> DataFrame:
    """Counts and sums by key and window of event time, of a batch or, with the lateness allowed, a stream."""
    rows = events.withWatermark(at, late) if late else events
    sums = rows.groupBy(key, F.window(at, width).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return sums.select(key, F.col("w.start").alias("window_start"), "n", "total")


def sessions(events: DataFrame, key: str, at: str, gap: str, late: str | None = None) -> DataFrame:
    """Events of a key with less than `gap` between them."""
    rows = events.withWatermark(at, late) if late else events
    found = rows.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


_BUCKET = "key string, at timestamp, admitted boolean, tokens double, retry_after long"


def _admit(tokens: float, last: float, times: pd.Series, rate: float) -> tuple[list[tuple[bool, float, int]], float, float]:
    out = []
    for now in times:
        tokens, last = min(rate, tokens + max(0.0, now - last) * rate / 60), max(now, last)
        ok = tokens >= 1
        tokens -= ok
        out.append((bool(ok), tokens, 0 if ok else max(1, int(-(-(1 - tokens) * 60 // rate)))))
    return out, tokens, last


def _rows(key: str, frame: pd.DataFrame, found: list[tuple[bool, float, int]]) -> pd.DataFrame:
    return pd.DataFrame({"key": key, "at": frame["at"].to_numpy(), "admitted": [x[0] for x in found], "tokens": [x[1] for x in found], "retry_after": [x[2] for x in found]})


class _Buckets(StatefulProcessor):
    """A key's tokens and the time of its last request; a timer drops them when the bucket is full again, as a new key's is."""

    def __init__(self, rate: float):
        self.rate = rate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("bucket", "tokens double, last double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(rows).sort_values("at", kind="stable")
        times = frame["at"].map(pd.Timestamp.timestamp)
        tokens, last = self.held.get() if self.held.exists() else (self.rate, float(times.iloc[0]))
        found, tokens, last = _admit(tokens, last, times, self.rate)
        self.held.update((float(tokens), float(last)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # `rate` tokens a minute fill a bucket of `rate` within one
        self.handle.registerTimer(int((last + 60) * 1000) + 1)
        yield _rows(key[0], frame, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter([])

    def close(self) -> None:
        pass


#: The state store that timers need; the session that starts the stream must name it.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def token_bucket(requests: DataFrame, rate: float, late: str = "10 minutes") -> DataFrame:
    """Admit requests (key, at) of a stream: a bucket of `rate` tokens a key, filled at `rate` a minute.

    Within a micro-batch a key's requests are taken by time; a request from before
    the last one seen finds no new tokens, and one that is later than `late` behind
    the newest is dropped.  A key without requests for a minute of event time holds
    no state: its bucket is full, as a new one is.
    """
    spark = requests.sparkSession
    if spark.conf.get(STORE[0]) != STORE[1]:
        raise ValueError(f"{STORE[0]} must be {STORE[1]}")
    rows = requests.select("key", "at").withWatermark("at", late).groupBy("key")
    return rows.transformWithStateInPandas(_Buckets(rate), _BUCKET, "append", "eventTime")


def token_bucket_batch(requests: DataFrame, rate: float) -> DataFrame:
    """The same over a table; a key's requests pass through in time order, a slice at a time.

    Requests of one key depend on each other, so a key is one task: it is read
    as a sorted run of rows and never held whole.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, tokens, last = None, rate, 0.0
        for frame in frames:
            for key, part in frame.groupby("key", sort=False):
                times = part["at"].map(pd.Timestamp.timestamp)
                if key != now:
                    now, tokens, last = key, rate, float(times.iloc[0])
                found, tokens, last = _admit(tokens, last, times, rate)
                yield _rows(key, part, found)

    return requests.select("key", "at").repartition("key").sortWithinPartitions("key", "at").mapInPandas(run, _BUCKET)


def running_totals(events: DataFrame, key: str, value: str) -> DataFrame:
    """Sums so far of a stream, for update mode."""
    return events.groupBy(key).agg(F.sum(value).alias("total"), F.count("*").alias("n"))
