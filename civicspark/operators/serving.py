"""What the serving side asks for: entity and ranked search, citations, map anchors, answer guards, settings, keys, memberships, exports, places in shapes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicspark.operators import spatial

#: Letters of the Bulgarian alphabet and yat.
CYRILLIC = "[абвгдежзийклмнопрстуфхцчшщъьюяѣАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЬЮЯѢ]"


def has_cyrillic(text: Column) -> Column:
    """Whether a text has a letter of CYRILLIC: looked for only in texts with a byte that all of them begin with in UTF-8, and no other character has."""
    some = [F.contains(text.cast("binary"), F.lit(bytearray([first]))) for first in sorted({c.encode()[0] for c in CYRILLIC.strip("[]")})]
    return reduce(Column.__or__, some) & text.rlike(CYRILLIC)


def extension(declared: Column) -> Column:
    """A file extension for a declared format: letters and digits, eight at most, else bin."""
    out = F.substring(F.regexp_replace(F.lower(F.coalesce(declared, F.lit(""))), "[^a-z0-9]", ""), 1, 8)
    return F.when(out == "", "bin").otherwise(out)


def column_labels(schema_json: Column) -> Column:
    """Source names, else canonical names, of a curated schema's columns; malformed JSON has none."""
    parsed = F.from_json(schema_json, "columns array<struct<sourceName:string, canonicalName:string>>")
    return F.coalesce(F.filter(F.transform(parsed.columns, lambda c: F.coalesce(c.sourceName, c.canonicalName)), lambda x: x.isNotNull()), F.array().cast("array<string>"))


def entity_search(attachments: DataFrame, entities: DataFrame, entity: str, limit: int = 50) -> DataFrame:
    """Datasets of an entity by id: (dataset, score, match_kind)."""
    known = entities.where(F.col("id") == entity).select("id")
    hits = attachments.where(F.col("entity") == entity).join(known, F.col("entity") == F.col("id"), "left_semi").select("dataset").distinct()
    return hits.orderBy("dataset").limit(limit).select("dataset", F.lit(1.0).alias("score"), F.lit("entity").alias("match_kind"))


def ranked_page(ranked: DataFrame, catalogue: DataFrame, keep: Column, key: str, order: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of ranked hits that are in the catalogue and pass a filter; the total counts what passed."""
    rows = ranked.join(catalogue, key).where(keep)
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(order, key).offset(max(0, offset)).limit(max(1, limit)).join(F.broadcast(total), how="cross")


def fill_up(chosen: DataFrame, hits: DataFrame, more: DataFrame, key: str, limit: int) -> DataFrame:
    """At most `limit` keys: chosen ones first, then ranked hits, then others, each once; inputs are (key, place)."""
    each = [df.select(key, F.lit(i).alias("leg"), "place") for i, df in enumerate((chosen, hits, more))]
    rows = each[0].unionByName(each[1]).unionByName(each[2])
    first = rows.groupBy(key).agg(F.min(F.struct("leg", "place")).alias("at"))
    return first.orderBy("at", key).limit(limit).select(key, "at.leg", "at.place")


def citations(mentions: DataFrame, scope: DataFrame, key: str, order: str) -> DataFrame:
    """Mentioned keys in scope, each once, in order of first mention."""
    first = mentions.groupBy(key).agg(F.min(order).alias("first")).join(scope.select(key), key, "left_semi")
    return first.select(key, "first")


def map_anchors(links: DataFrame) -> DataFrame:
    """(dataset, region) of datasets that touch one region only."""
    each = links.groupBy("dataset").agg(F.min("region").alias("region"), F.max("region").alias("last"))
    return each.where("region = last").select("dataset", "region")


def ghost_ids(answer: Column, known: Column, pattern: str) -> Column:
    """Ids an answer names that are not known."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(answer, F.lit(pattern), F.lit(0))), known)


def inflated_counts(answer: Column, size: Column, pattern: str = r"\b(\d+)\s+datasets") -> Column:
    """Numbers of datasets an answer claims that exceed how many there are."""
    return F.filter(F.transform(F.regexp_extract_all(answer, F.lit(pattern), F.lit(1)), lambda x: x.cast("int")), lambda n: n > size)


def to_translate(subjects: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Subjects whose text is not blank and not translated yet as it is; a null translation is none."""
    known = done.where("text_en is not null").select(*key, F.col("text_bg").alias("text"))
    return subjects.where("text is not null and trim(text) <> ''").join(known, [*key, "text"], "left_anti")


def lifecycle(datasets: DataFrame, observed: DataFrame, in_scope: Column, key: str) -> DataFrame:
    """State of each dataset after a crawl, with a reason for withdrawn ones only."""
    rows = datasets.join(observed.select(key).distinct().withColumn("_seen", F.lit(True)), key, "left")
    state = F.when(F.col("_seen").isNull(), "withdrawn").when(~in_scope, "out_of_scope").otherwise("active")
    return rows.withColumn("state", state).withColumn("reason", F.when(F.col("state") == "withdrawn", "not observed")).drop("_seen")


def validator(updated: Column, *fields: Column) -> Column:
    """What tells a dataset's versions apart: its time of update, else a hash of its fields."""
    return F.coalesce(F.concat(F.lit("ts:"), updated.cast("string")), F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256))


def inherited(tenants: DataFrame, settings: DataFrame, tenant: str, name: str, value: str) -> DataFrame:
    """Every setting of every tenant: its own value, else the global one (of the null tenant)."""
    own = settings.where(F.col(tenant).isNotNull())
    common = settings.where(F.col(tenant).isNull()).select(name, F.col(value).alias("_global"))
    names = settings.select(name).distinct()
    rows = tenants.select(tenant).join(names, how="cross").join(own, [tenant, name], "left").join(common, name, "left")
    return rows.select(tenant, name, F.coalesce(value, "_global").alias(value), F.col(value).isNotNull().alias("own"))


def key_status(hash_: Column, revoked: Column, expires: Column, now: Column) -> Column:
    """invalid without a key, then revoked, then expired (from its very time on), then ok."""
    return F.when(hash_.isNull(), "invalid").when(revoked.isNotNull(), "revoked").when(expires <= now, "expired").otherwise("ok")


def active_membership(users: DataFrame, members: DataFrame, user: str, tenant: str, preferred: str, created: str) -> DataFrame:
    """Each user's tenant: the preferred one while they are a member, else the oldest membership."""
    oldest = members.groupBy(user).agg(F.min_by(F.col(tenant), F.struct(created, tenant)).alias("_oldest"))
    valid = members.select(user, F.col(tenant).alias(preferred)).distinct().withColumn("_valid", F.lit(True))
    rows = users.join(valid, [user, preferred], "left").join(oldest, user, "left")
    return rows.select(user, F.coalesce(F.when(F.col("_valid"), F.col(preferred)), F.col("_oldest")).alias("active"))


def numbered_hits(hits: DataFrame, score: str, key: str) -> DataFrame:
    """Hits of a bounded list with their rank, best first, ties by key."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)))


def members_of(members: DataFrame, users: DataFrame, user: str, created: str) -> DataFrame:
    """Members with their users' columns, and their place in order of joining within each tenant; a membership without a user is none."""
    at = Window.partitionBy("tenant").orderBy(created, user)
    return members.join(users, user).withColumn("place", F.row_number().over(at))


def allocation(tenants: DataFrame, pool: str, allowance: str) -> DataFrame:
    """Allowances of each pool: how many, their sum (null counts 0), and how many are unset."""
    return tenants.groupBy(pool).agg(F.count("*").alias("members"), F.sum(F.coalesce(allowance, F.lit(0))).alias("allocated"), F.count_if(F.col(allowance).isNull()).alias("unset"))


def manifest(events: DataFrame, run: str, fields: Sequence[str]) -> DataFrame:
    """One JSON text a run: totals and its events in order; a run's manifest is one file, as the feature has it."""
    rows = events.groupBy(run).agg(F.count("*").alias("total"), F.array_sort(F.collect_list(F.struct(*fields))).alias("events"))
    return rows.select(run, F.to_json(F.struct("total", "events")).alias("manifest"))


def exposition(metrics: DataFrame) -> DataFrame:
    """Prometheus lines of (name, labels, value), as `line` with an order."""
    escaped = F.transform_values("labels", lambda k, v: F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')))
    pairs = F.array_sort(F.transform(F.map_entries(escaped), lambda e: F.concat(e.key, F.lit('="'), e.value, F.lit('"'))))
    body = F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    return metrics.select("name", F.concat(F.col("name"), body, F.lit(" "), F.col("value").cast("string")).alias("line"))


def located(points: DataFrame, shapes: Sequence[tuple[str, list[list[tuple[float, float]]]]]) -> DataFrame:
    """The shape that holds each point (id, x, y), else the one of the nearest centre: (id, shape, inside).

    shapes: names with rings, as a list; for a table of them see `spatial.located`.
    """
    rows = [(k, name, [[[float(c) for c in p] for p in ring] for ring in rings]) for k, (name, rings) in enumerate(shapes)]
    return spatial.located(points, points.sparkSession.createDataFrame(rows, "place long, shape string, rings array<array<array<double>>>"))


def rates(answers: DataFrame, kinds: Sequence[str], kind: str) -> DataFrame:
    """Share of answers of each kind."""
    return answers.agg(*[F.coalesce(F.avg((F.col(kind) == k).cast("double")), F.lit(0.0)).alias(k) for k in kinds])


def oldest_sync(datasets: DataFrame, at: str, seconds: int, now: Column) -> DataFrame:
    """The last sync of a catalogue and whether it is stale; an empty catalogue is."""
    last = datasets.agg(F.max(at).alias("last_sync"))
    return last.withColumn("stale", F.col("last_sync").isNull() | (F.unix_seconds(now) - F.unix_seconds("last_sync") > seconds))


def attempts_in_order(events: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last event of each key: later ones overwrite earlier ones."""
    at = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return events.withColumn("_r", F.row_number().over(at)).where("_r = 1").drop("_r")


def member_counts(tenants: DataFrame, members: DataFrame, tenant: str) -> DataFrame:
    """Tenants with their number of members, 0 without any."""
    counts = members.groupBy(tenant).agg(F.count("*").alias("members"))
    return tenants.join(counts, tenant, "left").withColumn("members", F.coalesce("members", F.lit(0)))


def allocation_fits(changes: DataFrame, tenants: DataFrame, pools: DataFrame, key: str, pool: str, allowance: str) -> DataFrame:
    """Whether a pool holds once a member's allowance is as asked: sum - current + new <= pool; unset ones count 0.

    changes: (key, new); tenants: (key, pool, allowance); pools: (pool, size).
    """
    total = tenants.groupBy(pool).agg(F.sum(F.coalesce(allowance, F.lit(0))).alias("_sum"))
    rows = changes.join(tenants, key).join(total, pool).join(pools, pool)
    after = F.col("_sum") - F.coalesce(allowance, F.lit(0)) + F.coalesce("new", F.lit(0))
    return rows.select(key, after.alias("allocated"), (after <= F.col("size")).alias("fits"))


def snapshot(samples: DataFrame, name: str, value: str) -> DataFrame:
    """Count, sum and mean of each metric and of all (null name); the mean of none is 0."""
    rows = samples.rollup(name).agg(F.count(value).alias("n"), F.coalesce(F.sum(value), F.lit(0.0)).alias("total"))
    return rows.withColumn("mean", F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(0.0))


def latest(rows: DataFrame, at: str, key: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of what came last, the highest key first at equal times: recent runs, the audit log."""
    return rows.orderBy(F.desc(at), F.desc(key)).offset(max(0, offset)).limit(max(1, limit))


def alerts(rates_: DataFrame, rate: str, threshold: float) -> DataFrame:
    """Rows strictly above a threshold."""
    return rates_.where(F.col(rate) > threshold)


def usage_fact(**counts: Column) -> list[Column]:
    """Token counts as they are appended: whole numbers, 0 at least."""
    return [F.greatest(F.coalesce(value, F.lit(0)).cast("double").cast("long"), F.lit(0)).alias(name) for name, value in counts.items()]


def deliver(alerts_: DataFrame, send, path: str, key: str) -> DataFrame:
    """Send alerts from tasks and append those that were delivered; returns the latter.

    send(row) says whether it worked.  Keys that are in `path` already are not sent
    again; those that failed are, at the next turn.
    """
    spark, turn = alerts_.sparkSession, uuid.uuid4().hex
    try:
        known = spark.read.parquet(path).select(key)
    except AnalysisException:  # nothing was delivered yet
        known = alerts_.select(key).where("false")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[[bool(send(row)) for row in frame.to_dict("records")]]

    done = alerts_.join(known, key, "left_anti").mapInPandas(run, alerts_.schema)
    done.write.parquet(f"{path}/turn={turn}")
    return spark.read.schema(alerts_.schema).parquet(f"{path}/turn={turn}")
