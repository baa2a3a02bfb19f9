"""Entities from datasets: extractors, their registration, name crosswalks, mentions, scoped search."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicspark.operators.linking import gazetteer
from civicspark.operators.serving import fill_up

#: How sure a place is by where its name stands and by the kind of match.
SURE = {"content": (0.95, 0.75), "publisher": (0.7, 0.6)}
#: What every extractor returns.
COLUMNS = ("dataset", "entity", "kind", "label", "extractor", "confidence")


def places(datasets: DataFrame, key: str, texts: Sequence[Column], names: DataFrame, source: str) -> DataFrame:
    """Administrative units named in a dataset's own texts (`content`) or its publisher's title (`publisher`)."""
    canonical, alias = SURE[source]
    hits = gazetteer(datasets, key, F.concat_ws("\n", *texts), names)
    sure = F.when(F.col("match_type") == "canonical", canonical).otherwise(alias)
    return hits.select(F.col(key).alias("dataset"), "entity", F.lit("geographic_unit").alias("kind"), F.col("pattern").alias("label"), F.lit(f"place_{source}").alias("extractor"), sure.alias("confidence"))


def organizations(datasets: DataFrame, key: str, publisher: Column, title: Column) -> DataFrame:
    """A dataset's publisher, where it has one."""
    rows = datasets.where(publisher.isNotNull())
    return rows.select(F.col(key).alias("dataset"), F.concat(F.lit("org:"), publisher.cast("string")).alias("entity"), F.lit("organization").alias("kind"), title.alias("label"), F.lit("organization").alias("extractor"), F.lit(1.0).alias("confidence"))


def named(datasets: DataFrame, key: str, names: Column, kind: str, confidence: float) -> DataFrame:
    """One entity for each distinct name in an array column: groups (surest) and tags."""
    rows = datasets.select(F.col(key).alias("dataset"), F.explode(F.array_distinct(names)).alias("label")).where("label is not null")
    return rows.select("dataset", F.concat(F.lit(f"{kind}:"), "label").alias("entity"), F.lit(kind).alias("kind"), "label", F.lit(kind).alias("extractor"), F.lit(confidence).alias("confidence"))


def registered(extracted: Sequence[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Extractors' rows, in order of the extractors, to entities (id, kind, label) and attachments.

    The last extractor decides an entity's kind and label; an attachment is one of a
    dataset, an entity and an extractor, the surest.
    """
    rows = extracted[0].select(*COLUMNS, F.lit(0).alias("turn"))
    for i, more in enumerate(extracted[1:], 1):
        rows = rows.unionByName(more.select(*COLUMNS, F.lit(i).alias("turn")))
    entities = rows.groupBy(F.col("entity").alias("id")).agg(F.max(F.struct("turn", "kind", "label")).alias("x")).select("id", "x.kind", "x.label")
    attachments = rows.groupBy("dataset", "entity", "extractor").agg(F.max("confidence").alias("confidence"))
    return entities, attachments


def in_namespace(ids: Column, namespace: str) -> Column:
    return ids.startswith(f"{namespace}:")


def crosswalk(features: DataFrame, units: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """Boundary features (feature, name) to units (unit, name) by name, through an alias map: (feature, unit), unit null where none fits."""
    alias = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else F.create_map().cast("map<string,string>")
    own = features.select("feature", F.coalesce(F.try_element_at(alias, F.lower(F.trim("name"))), F.lower(F.trim("name"))).alias("name"))
    return own.join(units.select("unit", F.lower(F.trim("name")).alias("name")), "name", "left").select("feature", "unit")


def mentioned(answers: DataFrame, candidates: DataFrame, key: str, answer: str, name: str, place: str) -> DataFrame:
    """Candidates (key, name, place) that an answer mentions, else the first one: (key, name)."""
    rows = candidates.join(answers, key).withColumn("named", F.contains(F.lower(answer), F.lower(name)))
    at = Window.partitionBy(key)
    rows = rows.withColumn("any", F.max("named").over(at)).withColumn("turn", F.row_number().over(at.orderBy(place)))
    return rows.where("named or (not any and turn = 1)").select(key, name)


def scoped_search(hits: DataFrame, datasets: DataFrame, scope: Column, attachments: DataFrame, entity: str, key: str, limit: int, fetched: int = 200) -> DataFrame:
    """Ranked hits (key, rank) within a scope, filled up with an entity's datasets: (key, leg, place).

    As the feature has it, so many best hits are fetched before the scope is applied.
    """
    best = hits.orderBy("rank").limit(fetched).join(datasets, key).where(scope).select(key, F.col("rank").alias("place"))
    more = attachments.where(F.col("entity") == entity).select(F.col("dataset").alias(key)).distinct().join(datasets, key).where(scope).select(key, F.col(key).alias("place"))
    return fill_up(best.where("false"), best, more, key, limit)
