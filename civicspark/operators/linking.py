"""Enrichment: gazetteer and keyword matches, dates in text, shared-entity links, relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicspark.functions.text import MONTHS, date_value
from civicspark.operators.names import names_in_texts
from civicspark.session import kept

#: How datasets that share an entity are linked, by the entity's kind, and how surely.
LINK_KINDS = {
    "organization": ("shared_publisher", 0.95), "geographic_unit": ("shared_geo", 0.9), "time_period": ("shared_time", 0.7),
    "named_subject": ("shared_subject", 0.6), "tag": ("shared_tag", 0.5), "group": ("shared_group", 0.7),
}
#: Subjects by the words that stand for them.
SUBJECTS = [
    ("subject:budget", ["бюджет", "budget"], 0.7), ("subject:population", ["население", "population"], 0.7),
    ("subject:education", ["образование", "education"], 0.65), ("subject:health", ["здраве", "медицина", "health"], 0.65),
    ("subject:transport", ["транспорт", "transport"], 0.6), ("subject:environment", ["околна среда", "environment", "екология"], 0.6),
]
#: Entities of more datasets are hubs and link nothing: the feature's own limit.
FANOUT = 50
#: Datasets of at most so many entities meet the others that share several with them by pairs of entities.
PAIRED = 16


def linkable(attachments: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Distinct (dataset, entity, kind) with the entity's number of datasets as `degree` and whether it is a hub."""
    pairs = attachments.select("dataset", "entity", "kind").distinct()
    degree = pairs.groupBy("entity").agg(F.count("*").alias("degree"))
    return pairs.join(degree, "entity").withColumn("hub", F.col("degree") > fanout)


def how_linked(kind: Column) -> list[Column]:
    """heuristic and confidence of links by entities of a kind."""
    both = F.split(F.create_map(*[F.lit(x) for k, (name, c) in LINK_KINDS.items() for x in (k, f"{name}|{c}")])[kind], r"\|")
    return [both[0].alias("heuristic"), both[1].cast("double").alias("confidence")]


def links(attachments: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(a, b, via, heuristic, confidence) of datasets a < b that share an entity of at most `fanout` datasets."""
    pairs = linkable(attachments, fanout).where("not hub")
    both = pairs.alias("x").join(pairs.alias("y"), F.expr("x.entity = y.entity and x.dataset < y.dataset"))
    return both.select(F.col("x.dataset").alias("a"), F.col("y.dataset").alias("b"), F.col("x.entity").alias("via"), *how_linked(F.col("x.kind")))


def either_side(links_: DataFrame) -> DataFrame:
    """Links as (dataset, other, via, ...) from both ends."""
    rest = [c for c in links_.columns if c not in ("a", "b")]
    return links_.select(F.col("a").alias("dataset"), F.col("b").alias("other"), *rest).unionByName(links_.select(F.col("b").alias("dataset"), F.col("a").alias("other"), *rest))


def link_counts(attachments: DataFrame, fanout: int = FANOUT, paired: int = PAIRED) -> DataFrame:
    """(dataset, links, neighbours) of the datasets that have links: how many from either side, and to how many others.

    The links are those of `links` (an entity is of one kind, and rows without a
    dataset are none), but are not made: an entity gives each of its
    datasets a link to every other one, and of two datasets that share s entities
    s - 1 links are not to a new neighbour.  Such datasets meet at pairs of
    entities, s (s - 1) / 2 times; those of over `paired` entities, whose pairs would
    be too many, meet the others at each entity.
    """
    own = linkable(attachments.where("dataset is not null"), fanout).where("degree > 1 and not hub")
    sets = kept(own.groupBy("dataset").agg(F.sum(F.col("degree") - 1).alias("links"), F.array_sort(F.collect_list("entity")).alias("entities")))
    small, large = sets.where(F.size("entities") <= paired), sets.where(F.size("entities") > paired)
    pairs = F.expr("flatten(transform(entities, (e, i) -> transform(slice(entities, i + 2, size(entities)), f -> struct(e, f))))")
    keys = small.where(F.size("entities") > 1).select("dataset", F.explode(pairs).alias("at")).select("dataset", "at.e", "at.f")
    met = keys.alias("x").hint("merge").join(keys.alias("y"), F.expr("x.e = y.e and x.f = y.f and x.dataset < y.dataset")).groupBy(F.col("x.dataset").alias("a"), F.col("y.dataset").alias("b"))
    met = met.agg(F.round((F.sqrt(1 + 8 * F.count("*")) - 1) / 2).cast("long").alias("again"))
    again = met.select(F.explode(F.array("a", "b")).alias("dataset"), "again")
    if not large.isEmpty():
        each = sets.select("dataset", (F.size("entities") > paired).alias("large"), F.explode("entities").alias("entity"))
        one = each.where("large").alias("x").join(each.alias("y"), F.expr("x.entity = y.entity and x.dataset <> y.dataset"))
        one = one.groupBy(F.col("x.dataset").alias("a"), F.col("y.dataset").alias("b"), F.col("y.large").alias("both")).agg((F.count("*") - 1).alias("again"))
        sides = F.when(F.col("both"), F.array("a")).otherwise(F.array("a", "b"))  # of two large ones, each is once `a`
        again = again.unionByName(one.where("again > 0").select(F.explode(sides).alias("dataset"), "again"))
    again = again.groupBy("dataset").agg(F.sum("again").alias("again"))
    return sets.join(again, "dataset", "left").select("dataset", "links", (F.col("links") - F.coalesce("again", F.lit(0))).alias("neighbours"))


def gazetteer(docs: DataFrame, key: str, text: Column, names: DataFrame) -> DataFrame:
    """(key, entity, pattern, match_type): a name anywhere in a text, once per entity by its longest name.

    names: (entity, name, match_type), as many as there are: see `names`.
    """
    patterns = names.select("entity", F.lower("name").alias("pattern"), "match_type").where("pattern <> ''").distinct()
    out = names_in_texts(docs, key, text, patterns).join(patterns, "pattern")
    best = F.max_by(F.struct("pattern", "match_type"), F.struct(F.length("pattern"), F.col("match_type") == "canonical", F.col("pattern")))
    return out.groupBy(key, "entity").agg(best.alias("b")).select(key, "entity", "b.pattern", "b.match_type")


def subjects(docs: DataFrame, key: str, text: Column) -> DataFrame:
    low = F.lower(text)
    found = [F.when(low.rlike("|".join(words)), F.struct(F.lit(i).alias("entity"), F.lit(c).alias("confidence"))) for i, words, c in SUBJECTS]
    return docs.select(key, F.explode(F.array_compact(F.array(*found))).alias("s")).select(key, "s.*")


def iso_dates(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """Distinct ISO dates of each text with their first places: (key, entity, date, confidence)."""
    dates = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b"), F.lit(1)))
    return docs.select(key, F.explode(dates).alias("date")).select(key, F.concat(F.lit("time:"), "date").alias("entity"), "date", F.lit(0.95).alias("confidence"))


def named_dates(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """Dates with a Bulgarian month's name, as ISO dates."""
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"([0-9]{{1,2}}\s+(?:{'|'.join(MONTHS)})\s+[0-9]{{4}})"), F.lit(1))
    return docs.select(key, F.explode(F.array_distinct(F.transform(found, date_value))).alias("date")).select(key, F.concat(F.lit("time:"), "date").alias("entity"), "date", F.lit(0.85).alias("confidence"))


def relations(entities: DataFrame, parents: DataFrame) -> DataFrame:
    """part_of edges of units that are entities: (subject, predicate, object, confidence)."""
    own = parents.join(entities.select(F.col("id").alias("child")), "child", "left_semi")
    return own.select(F.col("child").alias("subject"), F.lit("part_of").alias("predicate"), F.col("parent").alias("object"), F.lit(1.0).alias("confidence"))


def with_parents(entities: DataFrame, relations_: DataFrame, parents: DataFrame) -> DataFrame:
    """Entities (id, kind, label) and those parents (id, label) of relations that are none yet, as units."""
    wanted = relations_.select(F.col("object").alias("id")).distinct()
    new = parents.select("id", F.lit("geographic_unit").alias("kind"), "label").join(wanted, "id", "left_semi").dropDuplicates(["id"]).join(entities, "id", "left_anti")
    return entities.select("id", "kind", "label").unionByName(new)


def attached(extracted: DataFrame) -> DataFrame:
    """One row for each (dataset, entity, extractor), the surest."""
    at = Window.partitionBy("dataset", "entity", "extractor").orderBy(F.desc("confidence"))
    return extracted.withColumn("_r", F.row_number().over(at)).where("_r = 1").drop("_r")
