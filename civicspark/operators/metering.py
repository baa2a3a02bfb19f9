"""Metering operators: usage totals, trailing quotas, histograms, costs, run outcomes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicspark.functions.text import half_up


def totals(events: DataFrame, by: Sequence[str], sums: Sequence[str], at: str) -> DataFrame:
    """Sums (0 over nothing), number of rows and last time, for each key or, without keys, one row even of no rows."""
    aggs = [*(F.coalesce(F.sum(c), F.lit(0)).alias(f"sum_{c}") for c in sums), F.count("*").alias("events"), F.max(at).alias("last_at")]
    return events.groupBy(*by).agg(*aggs) if by else events.agg(*aggs)


def totals_since_reset(users: DataFrame, events: DataFrame, key: str, at: str, reset: str, value: str) -> DataFrame:
    """Each user's events since their reset, users without any included: the condition on time is part of the join."""
    facts = events.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.col(value).alias("_value"))
    on = (F.col(key) == F.col("_key")) & (F.col(reset).isNull() | (F.col("_at") >= F.col(reset)))
    rows = users.join(facts, on, "left")
    return rows.groupBy(key).agg(F.coalesce(F.sum("_value"), F.lit(0)).alias("total"), F.count("_key").alias("events"), F.max("_at").alias("last_at"))


def summed_in_order(events: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """With each event the sum of the key's values up to it, added one by one in order, and its place.

    A sum of doubles hangs on the order of addition, and partial sums on how rows are
    dealt to tasks; the sum at a key's last place does not.
    """
    at = Window.partitionBy(*by).orderBy(*order)
    return events.withColumns({"summed": F.sum(value).over(at.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "place": F.row_number().over(at)})


def usage_within(members: DataFrame, events: DataFrame, keys: Sequence[str], total: str, cached: str) -> DataFrame:
    """Each member's use within their tenant, of all time: no reset counts there; numbers that are missing or negative are 0."""
    clean = lambda c: F.greatest(F.floor(F.coalesce(F.col(c), F.lit(0))), F.lit(0))
    sums = events.groupBy(*keys).agg(F.sum(clean(total)).alias("used"), F.sum(clean(cached)).alias("cached"))
    return members.join(sums, list(keys), "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("used", "cached")})


def class_counts(events: DataFrame, key: str, kind: str, classes: Sequence[str]) -> DataFrame:
    """Events of each class by key; `total` is of these classes alone."""
    counts = [F.count_if(F.col(kind) == c).alias(f"n_{c}") for c in classes]
    return events.groupBy(key).agg(*counts, F.count_if(F.col(kind).isin(list(classes))).alias("total"))


def trailing_count(events: DataFrame, key: str, at: str, order: str, seconds: int = 86_400) -> DataFrame:
    """With each event the number of the key's events in the seconds up to and including it."""
    frame = Window.partitionBy(key).orderBy(F.unix_micros(at)).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("in_window", F.count(order).over(frame))


def cumulative_histogram(values: DataFrame, value: str, bounds: Sequence[float]) -> DataFrame:
    """Values up to each bound (inclusive) and up to infinity, with their number running up.

    The counts of all bounds are taken in one pass; only as many rows as bounds
    are ordered.
    """
    le = [*map(float, bounds), float("inf")]
    counts = values.agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(le)], F.coalesce(F.sum(value), F.lit(0.0)).alias("sum"))
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit("+Inf" if b == float("inf") else f"{b:g}").alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(le)]))
    return counts.select(rows.alias("r")).select("r.place", "r.le", "r.n")


def billable(total: Column, cached: Column, weight: float) -> Column:
    """Tokens to bill: cached ones count by weight, halves round up, never below 0."""
    return F.greatest(F.lit(0), half_up(total - (1 - weight) * F.least(cached, total))).cast("long")


def quota(used: Column, limit: Column) -> Column:
    """struct(used, limit, remaining, exceeded): no limit for null or 0; reached is exceeded."""
    free = limit.isNull() | (limit == 0)
    return F.struct(
        used.alias("used"), limit.alias("limit"), F.when(~free, F.greatest(F.lit(0), limit - used)).alias("remaining"), F.when(free, False).otherwise(used >= limit).alias("exceeded")
    )


def cost(prices: Mapping[str, tuple[float, float]], model: Column, tokens_in: Column, tokens_out: Column, cached: Column, cached_weight: float = 0.1) -> Column:
    """Price by exact model, else by the longest prefix, else 0; prices are for a million tokens in and out."""
    names = sorted(prices, key=lambda x: (-len(x), x))
    tests = [(model == n, prices[n]) for n in prices] + [(model.startswith(n), prices[n]) for n in names]
    rate = lambda i: F.coalesce(*[F.when(test, F.lit(p[i])) for test, p in tests], F.lit(0.0))
    paid = (tokens_in - F.least(cached, tokens_in)) + cached_weight * F.least(cached, tokens_in)
    return (paid * rate(0) + tokens_out * rate(1)) / 1_000_000


def run_outcomes(events: DataFrame, run: str, outcome: str) -> DataFrame:
    """Per run: events by outcome, failure rate and result (success, partial or failed)."""
    names = ("captured", "skipped", "failed")
    counts = events.groupBy(run).agg(F.count("*").alias("discovered"), *[F.count_if(F.col(outcome) == x).alias(x) for x in names])
    result = F.when(F.col("failed") == 0, "success").when(F.col("captured") + F.col("skipped") > 0, "partial").otherwise("failed")
    return counts.withColumn("failure_rate", F.col("failed") / F.greatest("discovered", F.lit(1))).withColumn("result", result)


def bounded_labels(events: DataFrame, label: str, order: Sequence[str], most: int = 100) -> DataFrame:
    """Labels beyond the first `most`, by first appearance, become `other`; counted by label."""
    seen = events.groupBy(label).agg(F.min(F.struct(*order)).alias("_first"), F.count("*").alias("n"))
    kept = seen.orderBy("_first", label).limit(most).select(F.col(label).alias("_kept"))
    named = seen.join(F.broadcast(kept), F.col(label) == F.col("_kept"), "left")
    return named.groupBy(F.when(F.col("_kept").isNotNull(), F.col(label)).otherwise("other").alias(label)).agg(F.sum("n").alias("n"))


def throttled(events: DataFrame, key: str, at: str, seconds: int = 300) -> DataFrame:
    """Events that follow the key's event before by at least `seconds`, and each key's first."""
    before = F.lag(F.unix_seconds(at)).over(Window.partitionBy(key).orderBy(at))
    return events.withColumn("_gap", F.unix_seconds(at) - before).where("_gap is null or _gap >= %d" % seconds).drop("_gap")
