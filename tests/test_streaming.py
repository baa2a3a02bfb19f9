from __future__ import annotations

import datetime as dt

from civicspark.streaming import index as stream_index
from civicspark.streaming import metering

AT = dt.datetime(2026, 1, 1)


def streamed(spark, rows, schema, path, transform, mode, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    query = transform(spark.readStream.schema(schema).parquet(path)).writeStream.outputMode(mode).format("memory").queryName(name).start()
    query.processAllAvailable()
    query.stop()
    return spark.sql(f"SELECT * FROM {name}")


def test_window_stream_equals_batch(spark, tmp_path):
    schema = "key string, at timestamp, value double"
    rows = [(f"k{i % 3}", AT + dt.timedelta(minutes=7 * i), float(i)) for i in range(40)]
    out = streamed(spark, rows, schema, str(tmp_path / "in"), lambda s: metering.by_window(s, "key", "at", "value", "1 hour", "1 day"), "update", "windows")
    batch = metering.by_window(spark.createDataFrame(rows, schema), "key", "at", "value", "1 hour")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))


def test_token_bucket_stream_equals_batch(spark, tmp_path):
    schema = "key string, at timestamp"
    rows = [("a", AT + dt.timedelta(seconds=5 * i)) for i in range(12)] + [("b", AT)]
    batch = metering.token_bucket_batch(spark.createDataFrame(rows, schema), 4).collect()
    out = streamed(spark, rows, schema, str(tmp_path / "in"), lambda s: metering.token_bucket(s, 4), "append", "buckets")
    key = lambda r: (r.key, r["at"], r.admitted, round(r.tokens, 6), r.retry_after)
    assert sorted(map(key, out.collect())) == sorted(map(key, batch))
    a = [r.admitted for r in sorted(batch, key=lambda r: r["at"]) if r.key == "a"]
    assert a[:5] == [True] * 5 and not all(a)


def test_sessions(spark):
    rows = spark.createDataFrame([("a", AT), ("a", AT + dt.timedelta(minutes=4)), ("a", AT + dt.timedelta(minutes=30))], "key string, at timestamp")
    assert sorted(r.n for r in metering.sessions(rows, "key", "at", "5 minutes").collect()) == [1, 2]


def test_index_stream_indexes_changes_once(spark, tmp_path):
    schema, source, seen = "id string, text string, version long", str(tmp_path / "in"), []

    def go(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        query = stream_index.index_stream(spark.readStream.schema(schema).parquet(source), str(tmp_path / "state"), "id", "text", str(tmp_path / "check"), lambda df: seen.append(sorted(r.id for r in df.collect()))).start()
        query.processAllAvailable()
        query.stop()

    go([("a", "x", 1), ("b", "y", 1)])
    go([("a", "x", 2), ("b", "z", 2), ("c", "w", 2)])
    assert seen == [["a", "b"], ["b", "c"]]
    assert stream_index.state(spark, str(tmp_path / "state"), "id").count() == 3


def test_idle_buckets_hold_no_state(spark, tmp_path):
    """Three micro-batches, minutes apart: a key that is idle for a minute is forgotten, and comes back with a full bucket, as in the batch twin."""
    schema, path = "key string, at timestamp", str(tmp_path / "in")
    batches = [
        [("a", AT + dt.timedelta(seconds=i)) for i in range(5)] + [("b", AT)],
        [("c", AT + dt.timedelta(minutes=20))],
        [("a", AT + dt.timedelta(minutes=21, seconds=i)) for i in range(5)] + [("c", AT + dt.timedelta(minutes=21))],
    ]
    held = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        stream = metering.token_bucket(spark.readStream.schema(schema).parquet(path), 3, "1 minute").writeStream.outputMode("append").format("parquet")
        query = stream.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).start()
        query.processAllAvailable()
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"] if query.lastProgress["stateOperators"] else None)
        query.stop()
    key = lambda r: (r.key, r["at"], r.admitted, round(r.tokens, 6), r.retry_after)
    everything = spark.createDataFrame([r for rows in batches for r in rows], schema)
    assert sorted(map(key, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(key, metering.token_bucket_batch(everything, 3).collect()))
    keys = spark.read.format("statestore").option("path", str(tmp_path / "check")).option("stateVarName", "bucket").load().select("key.key").collect()
    assert sorted(r.key for r in keys) == ["a", "c"]


def test_state_of_many_batches_is_read_from_few_folders(spark, tmp_path):
    from civicspark.operators import levels

    path, seen, texts = str(tmp_path / "state"), [], {}
    for number in range(20):
        rows = [(k, f"t{k * number % 3}", number) for k in range(number % 5, 12, 2)]
        new = {k for k, t, _ in rows if texts.get(k) != t}
        texts |= {k: t for k, t, _ in rows}
        frame = spark.createDataFrame(rows, "id long, text string, version long")
        stream_index.take_in(frame, number, path, "id", "text", lambda df: seen.append({r.id for r in df.collect()}), buckets=4, fan=3)
        assert seen.pop() == new
        assert len(levels.manifest(spark, path)["folders"]) <= 6
    # a committed batch hands on nothing; one that failed while handing on comes again
    stream_index.take_in(frame, 19, path, "id", "text", seen.append)
    assert not seen

    def fails(rows):
        raise RuntimeError("index is away")

    late = spark.createDataFrame([(1, "new", 20)], "id long, text string, version long")
    try:
        stream_index.take_in(late, 20, path, "id", "text", fails)
    except RuntimeError:
        pass
    stream_index.take_in(late, 20, path, "id", "text", lambda df: seen.append([r.id for r in df.collect()]))
    assert seen == [[1]]
    state = {r.id: r.version for r in stream_index.state(spark, path, "id").collect()}
    assert set(state) == set(texts) and state[1] == 20
