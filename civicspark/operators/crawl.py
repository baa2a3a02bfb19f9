"""Crawl state: reconciliation, drift, session plans, skips, progress, robots, schedules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicspark.functions.text import trimmed
from civicspark.session import kept


def withdrawn(active: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    return active.join(observed, key, "left_anti")


def drift(frozen: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """(key, change): added to or vanished from the frozen list."""
    return now.select(key).join(frozen, key, "left_anti").withColumn("change", F.lit("added")).unionByName(frozen.select(key).join(now, key, "left_anti").withColumn("change", F.lit("vanished")))


def numbered(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Rows with their place in order of a key of their own, from 0: ranges of the key are numbered apart, behind the counts of those before."""
    parts = kept(rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("_part", F.spark_partition_id()))
    counts = parts.groupBy("_part").agg(F.count("*").alias("_k"))  # a row a partition
    before = counts.withColumn("_before", F.coalesce(F.sum("_k").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_k")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return parts.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(position, F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


def enumerated(ids: DataFrame, key: str, explicit: Sequence[str] | None = None) -> DataFrame:
    """The frozen list of a campaign: (key, position) in order of key; explicit ids stand as they are given, without paging."""
    if explicit is not None:
        ids = ids.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(explicit)], f"`{key}` string")
    return numbered(ids.select(key).where(F.col(key).isNotNull()).distinct(), key, "position")


def append_unseen(frozen: DataFrame, now: DataFrame, key: str, position: str = "position") -> DataFrame:
    """The ordered list with new keys behind it, in order of key."""
    end = F.broadcast(frozen.agg(F.coalesce(F.max(position), F.lit(-1)).alias("_end")))
    new = numbered(now.select(key).distinct().join(frozen, key, "left_anti"), key, position).join(end, how="cross")
    return frozen.select(key, position).unionByName(new.select(key, (F.col(position) + F.col("_end") + 1).alias(position)))


#: Dimensions of a scope that the portal can be asked for.
DIMENSIONS = ("organizations", "groups", "tags", "datasetIds")


def supported(scope: dict[str, Sequence[str]], dimensions: Sequence[str] = DIMENSIONS) -> dict[str, Sequence[str]]:
    """The scope itself; one with a dimension that cannot be asked for raises, as a crawl of more than was meant would follow."""
    unknown = sorted(k for k, v in scope.items() if v and k not in dimensions)
    if unknown:
        raise ValueError(f"a crawl cannot be limited by {', '.join(unknown)}")
    return scope


def prefiltered(summaries: DataFrame, scope: dict[str, Sequence[str]]) -> DataFrame:
    """Summaries (organization, group) that may be in scope; with tags or ids all stay, as summaries do not tell."""
    if scope.get("tags") or scope.get("datasetIds"):
        return summaries
    asked = [(c, [x.lower() for x in scope.get(name, ())]) for c, name in (("organization", "organizations"), ("group", "groups"))]
    keep = F.lit(False)
    for column, values in asked:
        keep = keep | F.coalesce(F.lower(column).isin(values), F.lit(False)) if values else keep
    return summaries.where(keep) if any(v for _, v in asked) else summaries


def retry_after(header: Column, now: Column) -> Column:
    """Seconds to wait by a Retry-After header: whole seconds, or an HTTP date less now, 0 at least; else null."""
    text = F.trim(header)
    date = F.try_to_timestamp(F.regexp_replace(text, "^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = F.when(date.isNotNull(), F.greatest(F.unix_seconds(date) - F.unix_seconds(now), F.lit(0)))
    return F.coalesce(F.when(text.rlike("^[0-9]+$"), text.try_cast("long")), wait)


def backfilled(datasets: DataFrame, fresh: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Datasets with fields that are null or blank filled from fresh metadata; others and lifecycles stay."""
    new = fresh.select(key, *[F.col(f).alias(f"_new_{f}") for f in fields])
    rows = datasets.join(new, key, "left")
    value = lambda f: F.when(F.coalesce(F.trim(F.col(f)) == "", F.lit(True)), F.coalesce(f"_new_{f}", f)).otherwise(F.col(f))
    return rows.select(*[value(c).alias(c) if c in fields else F.col(c) for c in datasets.columns])


def plan_session(items: DataFrame, cursor: DataFrame, key: str, most: int | None = None, retry: bool = False, attempts: int = 3) -> DataFrame:
    """The next items of a campaign: those behind the cursor that are pending, or failed ones to retry.

    items: (key, position, outcome, attempts); cursor: one row with `cursor`, a
    key.  A cursor that is null or no longer listed leaves everything eligible.
    """
    at = items.join(F.broadcast(cursor.select(F.col("cursor").alias(key))), key, "left_semi").agg(F.coalesce(F.max("position"), F.lit(-1)).alias("_at"))
    rows = items.join(F.broadcast(at), how="cross")
    pending = (F.col("position") > F.col("_at")) & F.coalesce(F.col("outcome") == "pending", F.lit(True))
    again = (F.col("outcome") == "failed") & (F.col("attempts") < attempts) if retry else F.lit(False)
    out = rows.where(pending | again).drop("_at").orderBy("position", key)
    return out if most is None else out.limit(most)


def skippable(resources: DataFrame, key: str, outcome: str, old: str, new: str) -> DataFrame:
    """Whether each dataset may be skipped: it has resources, and all succeeded with an unchanged validator."""
    fine = (F.col(outcome) == "success") & F.coalesce(F.col(old) == F.col(new), F.lit(False))
    return resources.groupBy(key).agg(F.bool_and(fine).alias("skip"), F.count("*").alias("resources"))


def progress(items: DataFrame, total: Column | None = None, attempts: int = 3) -> DataFrame:
    """Items by state, and what is left: neither complete nor failed for good."""
    done = (F.col("outcome") == "complete") | ((F.col("outcome") == "failed") & (F.col("attempts") >= attempts))
    counts = [F.count_if(F.col("outcome") == x).alias(x) for x in ("complete", "failed", "pending")]
    return items.agg(F.count("*").alias("total"), *counts, (F.count("*") - F.count_if(done)).alias("remaining"))


def allowed(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """robots.txt: the longest rule that begins a path decides, allow wins ties, no rule allows.

    paths: (agent, path); rules: (agent, prefix, allow).  An agent's own rules replace those of `*`.
    """
    own = rules.select("agent").distinct().withColumn("group", F.col("agent"))
    rows = paths.join(own, "agent", "left").withColumn("group", F.coalesce("group", F.lit("*")))
    hits = rows.join(rules.select(F.col("agent").alias("group"), "prefix", "allow"), "group", "left")
    fits = F.coalesce(F.col("path").startswith(F.col("prefix")) & (F.col("prefix") != ""), F.lit(False))
    best = F.max_by(F.col("allow"), F.when(fits, F.struct(F.length("prefix"), F.col("allow"))))
    return hits.groupBy("agent", "path").agg(F.coalesce(best, F.lit(True)).alias("allowed"))


def next_fires(crons: DataFrame, after: Column, days: int = 366) -> DataFrame:
    """The next minute of each five-field cron after a time; day of month and day of week must both fit.

    crons: (cron).  A field is a comma-joined list of *, n, a-b, each with /step; a
    single value with a step is that value.  Days are tried first, then the minutes
    of the first day that fits.
    """
    lows, highs = (0, 0, 1, 1, 0), (59, 23, 31, 12, 6)

    def fits(field: Column, value: Column, low: int, high: int) -> Column:
        def piece(p: Column) -> Column:
            base, step = F.split(p, "/")[0], F.coalesce(F.get(F.split(p, "/"), F.lit(1)).cast("int"), F.lit(1))
            first = F.when(base.isin("*", ""), low).otherwise(F.split(base, "-")[0].cast("int"))
            last = F.when(base.isin("*", ""), high).otherwise(F.element_at(F.split(base, "-"), -1).cast("int"))
            return (value >= first) & (value <= last) & ((value - first) % step == 0)

        return F.exists(F.split(field, ","), piece)

    rows = crons.select("cron", F.split(F.trim("cron"), r"\s+").alias("f"), (F.date_trunc("minute", after) + F.expr("interval 1 minute")).alias("from"))
    day = rows.withColumn("day", F.explode(F.sequence(F.to_date("from"), F.date_add(F.to_date("from"), days))))
    day = day.where(
        fits(F.col("f")[2], F.dayofmonth("day"), lows[2], highs[2]) & fits(F.col("f")[3], F.month("day"), lows[3], highs[3]) & fits(F.col("f")[4], F.dayofweek("day") - 1, lows[4], highs[4])
    )
    # the first two days that fit hold the next minute, if any day has one
    day = day.withColumn("r", F.row_number().over(Window.partitionBy("cron").orderBy("day"))).where("r <= 2")
    minute = day.withColumn("at", F.explode(F.sequence(F.to_timestamp("day"), F.to_timestamp("day") + F.expr("interval 1439 minutes"), F.expr("interval 1 minute"))))
    minute = minute.where((F.col("at") >= F.col("from")) & fits(F.col("f")[0], F.minute("at"), lows[0], highs[0]) & fits(F.col("f")[1], F.hour("at"), lows[1], highs[1]))
    return minute.groupBy("cron").agg(F.min("at").alias("next_fire"))


def scope_hash(dimensions: dict[str, Sequence[str]], version: str = "v1") -> Column:
    """SHA-256 of a scope, whatever the order and case of its values; an empty one has no version."""
    own = {k: v for k, v in sorted(dimensions.items()) if [x for x in v if x.strip()]}
    if not own:
        return F.sha2(F.lit('{"all":true}'), 256)
    lists = [F.sort_array(F.array_distinct(F.transform(F.array(*map(F.lit, v)), lambda x: F.lower(F.trim(x))))).alias(k) for k, v in own.items()]
    return F.sha2(F.to_json(F.struct(F.lit(version).alias("version"), *lists)), 256)


#: A scope's lists in their order, and the version of what a scope means.
SCOPE_LISTS, SCOPE_VERSION = ("publishers", "categories", "tags", "datasetIds"), "v2-egov-scope-fidelity"


def scope_json(lists: Mapping[str, Column]) -> Column:
    """The canonical scope of each row as JSON text: trimmed, small letters, in order, once each; without any value {"all":true}."""
    clean = {}
    for name in SCOPE_LISTS:
        values = F.coalesce(lists[name], F.array().cast("array<string>")) if name in lists else F.array().cast("array<string>")
        clean[name] = F.array_sort(F.array_distinct(F.filter(F.transform(values, lambda x: F.lower(trimmed(x))), lambda x: x != "")))
    some = F.lit(False)
    for values in clean.values():
        some = some | (F.size(values) > 0)
    return F.when(some, F.to_json(F.struct(*[v.alias(n) for n, v in clean.items()]))).otherwise('{"all":true}')


def scope_hashes(lists: Mapping[str, Column], version: str = SCOPE_VERSION) -> Column:
    """SHA-256 of each row's canonical scope; the version is part of all but the one of everything."""
    text = scope_json(lists)
    versioned = F.concat(F.lit(f'{{"v":"{version}",'), F.substring(text, F.lit(2), F.length(text)))
    return F.sha2(F.when(text == '{"all":true}', text).otherwise(versioned), 256)
