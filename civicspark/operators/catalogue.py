"""Catalogue operators: projection, filters, facets, region roll-ups, entity graph, grids, pages."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicspark.functions.text import is_number, number_value, trimmed

#: Rows of a grid that are filtered and sorted at most: the feature's own limit.
GRID_SCAN = 100_000


def and_filter(df: DataFrame, dimensions: Mapping[str, Iterable], lifecycle: str | None = None) -> DataFrame:
    """Catalogue filter: all dimensions must match, in each any value; an empty dimension does not filter.

    Array columns match by overlap; a null never matches.  With a lifecycle
    column, withdrawn rows are hidden unless the dimension on it asks for them.
    """
    for name, values in dimensions.items():
        if values := list(values):
            array = dict(df.dtypes)[name].startswith("array")
            df = df.where(F.arrays_overlap(name, F.array(*map(F.lit, values))) if array else F.col(name).isin(values))
    if lifecycle and not list(dimensions.get(lifecycle, ())):
        df = df.where(F.col(lifecycle) != "withdrawn")
    return df


def in_scope(df: DataFrame, key: str, ids: Iterable, dimensions: Mapping[str, Iterable], lifecycle: str | None = None, withdrawn: bool = False) -> DataFrame:
    """A conversation's scope: the named datasets, if any are, and the catalogue filter; withdrawn ones only if asked for."""
    if ids := list(ids):
        df = df.where(F.col(key).isin(ids))
    return and_filter(df, dimensions, None if withdrawn else lifecycle)


def pointers(views: DataFrame) -> DataFrame:
    """What a list shows of datasets (views): names, publisher, tags, freshness, places, link and a score if there is one."""
    publisher = F.when(F.col("publisher").isNotNull(), F.struct(F.col("publisher.id").alias("id"), F.col("publisher.title").alias("title")))
    score = F.col("score") if "score" in views.columns else F.lit(None).cast("double")
    places = F.filter(F.col("entities.entity"), lambda e: e.startswith("geo:"))
    return views.select("dataset", "title", "title_en", publisher.alias("publisher"), "tags", "stale", places.alias("places"), score.alias("score"))


def details(views: DataFrame, attached: DataFrame, links: DataFrame, resources: DataFrame) -> DataFrame:
    """Datasets with their resources, entities (surest first) and links from either side, each as a list in a fixed order."""
    lists = {
        "entities": attached.groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("order"), "entity", "confidence"))).alias("entities")),
        "links": links.groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct("other", "via", "confidence"))).alias("links")),
        "resources": resources.groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct("resource", "kind"))).alias("resources")),
    }
    out = views.drop(*lists)
    for name, rows in lists.items():
        out = out.join(rows, "dataset", "left")
    return out.withColumn("entities", F.transform("entities", lambda e: F.struct(e.entity.alias("entity"), e.confidence.alias("confidence"))))


def entry_projection(hits: DataFrame, datasets: DataFrame, titles: DataFrame, publishers: DataFrame, key: str, limit: int) -> DataFrame:
    """The best `limit` hits (key, score, rank) with names, publisher and freshness; those whose dataset is gone are dropped after the limit.

    datasets: (key, title, publisher, synced); titles: (subject, id, text, translator),
    of which the first translator's stands for a dataset (dataset_title) and for a
    publisher (entity_label, its id after org:); publishers: (publisher, name).
    """
    best = hits.orderBy("rank", key).limit(limit)
    first = titles.groupBy("subject", "id").agg(F.min_by(F.struct("text", "translator"), "translator").alias("t")).select("subject", "id", "t.*")
    of = lambda kind, column: first.where(F.col("subject") == kind).select(F.col("id").alias(f"_{column}"), F.col("text").alias(column))
    rows = best.join(datasets, key).join(of("dataset_title", "title_en"), F.col(key).cast("string") == F.col("_title_en"), "left").join(publishers, "publisher", "left")
    rows = rows.join(of("entity_label", "publisher_en"), F.concat(F.lit("org:"), F.col("publisher").cast("string")) == F.col("_publisher_en"), "left")
    named = F.when(F.col("name").isNotNull(), F.col("publisher"))
    return rows.select(key, "score", "rank", "title", "title_en", named.alias("publisher"), "name", F.when(F.col("name").isNotNull(), F.col("publisher_en")).alias("publisher_en"), "synced")


def or_filter(df: DataFrame, dimensions: Mapping[str, Iterable]) -> DataFrame:
    """Crawl scope: any dimension may match; an empty scope keeps all."""
    tests = []
    for name, values in dimensions.items():
        if values := list(values):
            array = dict(df.dtypes)[name].startswith("array")
            tests.append(F.arrays_overlap(name, F.array(*map(F.lit, values))) if array else F.col(name).isin(values))
    if not tests:
        return df
    test = tests[0]
    for other in tests[1:]:
        test = test | other
    return df.where(F.coalesce(test, F.lit(False)))


def with_children(chosen: DataFrame, parts: DataFrame, child: str, parent: str) -> DataFrame:
    """Chosen units (`unit`) and the children of each, one level down."""
    below = parts.join(chosen, F.col(parent) == F.col("unit"), "left_semi").select(F.col(child).alias("unit"))
    return chosen.select("unit").union(below).distinct()


def first_per(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by an order, which should end in a unique column."""
    at = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(at)).where("_rank = 1").drop("_rank")


def facet(df: DataFrame, column: Column, name: str, label: Column | None = None) -> DataFrame:
    """Rows for each value of a column, null left out; label: the least label that goes with a value."""
    counts = [F.count("*").alias("n"), *([F.min("_label").alias("label")] if label is not None else [])]
    rows = df.select(column.alias(name), *([label.alias("_label")] if label is not None else []))
    return rows.where(F.col(name).isNotNull()).groupBy(name).agg(*counts)


def rollup_regions(links: DataFrame, parts: DataFrame, regions: DataFrame) -> DataFrame:
    """Distinct datasets and the best confidence of each region, regions without any included.

    links: (dataset, unit, confidence); parts: (unit, region) of child units; a
    unit that has no parent is a region itself.  regions: (region, name).
    """
    at = links.join(parts, "unit", "left").select("dataset", "confidence", F.coalesce("region", "unit").alias("region"))
    each = at.groupBy("region", "dataset").agg(F.max("confidence").alias("confidence"))
    counts = each.groupBy("region").agg(F.count("*").alias("datasets"), F.max("confidence").alias("best"))
    return regions.join(counts, "region", "left").select("region", "name", F.coalesce("datasets", F.lit(0)).alias("datasets"), F.coalesce("best", F.lit(0.0)).alias("best"))


def without_links(datasets: DataFrame, links: DataFrame, key: str) -> DataFrame:
    return datasets.join(links, key, "left_anti")


def breakpoints(counts: DataFrame, n: str = "datasets") -> DataFrame:
    """Each row's class 0 to 4 on a map: breaks at ceil(max * q), q = 0.1, 0.25, 0.5 and 0.75, rising and at least 1."""
    top = F.broadcast(counts.agg(F.max(n).alias("_top")))
    rows = counts.join(top, how="cross")
    breaks: list[Column] = []
    for q in (0.1, 0.25, 0.5, 0.75):
        at = F.greatest(F.ceil(F.col("_top") * q), F.lit(1))
        breaks.append(F.greatest(at, breaks[-1]) if breaks else at)
    place = sum((F.when(F.col(n) > b, 1).otherwise(0) for b in breaks[1:]), F.when(F.col(n) > breaks[0], 1).otherwise(0))
    return rows.withColumn("bucket", F.when(F.col(n) <= 0, 0).otherwise(place + 1)).drop("_top")


def entity_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends' kind and label; a missing node is of unknown kind and labelled by its id.

    nodes: (id, kind, label); edges: (subject, predicate, object).
    """
    end = lambda side: nodes.select(F.col("id").alias(side), F.col("kind").alias(f"{side}_kind"), F.col("label").alias(f"{side}_label"))
    out = edges.join(end("subject"), "subject", "left").join(end("object"), "object", "left")
    stub = lambda side: [F.coalesce(f"{side}_kind", F.lit("unknown")).alias(f"{side}_kind"), F.coalesce(f"{side}_label", F.col(side).cast("string")).alias(f"{side}_label")]
    return out.select("subject", "predicate", "object", *stub("subject"), *stub("object"))


def degrees(edges: DataFrame) -> DataFrame:
    """Outgoing and incoming edges of each node."""
    ends = edges.select(F.col("subject").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("object").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("id").agg(F.sum("out").alias("n_out"), F.sum("into").alias("n_in"))


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page, the total of all rows beside each; the order should end in a unique column."""
    limit, offset = max(1, limit), max(0, offset)
    total = F.broadcast(df.agg(F.count("*").alias("total")))
    return df.orderBy(*order).offset(offset).limit(limit).join(total, how="cross")


def grid(df: DataFrame, filters: Mapping[str, str], sort: str | None = None, descending: bool = False, row: str = "row_no", scan: int = GRID_SCAN) -> tuple[DataFrame, list[Column]]:
    """Filter rows of a table by parts of cells; (rows, order), for `page`.

    The first `scan` rows are seen.  A blank filter is none, a missing column is
    empty.  Order of a column: numbers by value, then text, blanks last; the
    whole order is turned for descending, so blanks come first.
    """
    df = df.where(F.col(row) < scan)
    for name, part in filters.items():
        if part.strip():
            cell = F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")
            df = df.where(F.lower(cell).contains(part.strip().lower()))
    if sort is None:
        return df, [F.col(row)]
    cell = F.coalesce(F.col(sort).cast("string"), F.lit("")) if sort in df.columns else F.lit("")
    kind = F.when(is_number(cell), 0).when(cell == "", 2).otherwise(1)
    value = F.when(kind == 0, number_value(cell))
    text = F.when(kind == 1, F.collate(cell, "bg"))
    keys = [kind, value, text]
    return df, [*(F.desc_nulls_first(k) if descending else F.asc_nulls_last(k) for k in keys), F.col(row)]


def ragged_columns(rows: DataFrame, cells: str, row: str, most: int = 12) -> DataFrame:
    """The first `most` column names of rows of (name -> cell) maps, in the order they are first seen."""
    keys = rows.select(F.col(row).alias("_row"), F.posexplode(F.map_keys(cells)).alias("_pos", "name"))
    first = keys.groupBy("name").agg(F.min(F.struct("_row", "_pos")).alias("_at"))
    return first.orderBy("_at", "name").limit(most).select("name", F.col("_at._row").alias("first_row"))


def running_budget(df: DataFrame, key: Sequence[str], order: Sequence[Column], size: Column, most: int) -> DataFrame:
    """Of each key the first rows whose sizes sum to at most `most`; the first row always stays."""
    at = Window.partitionBy(*key).orderBy(*order)
    rows = df.withColumn("used", F.sum(size).over(at.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_turn", F.row_number().over(at))
    return rows.where((F.col("used") <= most) | (F.col("_turn") == 1)).drop("_turn")


def best_of_array(items: str, most: int, by: str) -> Column:
    """At most `most` structs of an array, the highest `by` first; a shorter array stays as it is."""
    ordered = F.array_sort(items, lambda a, b: F.when(a[by] > b[by], -1).when(a[by] < b[by], 1).otherwise(0))
    return F.when(F.size(items) > most, F.slice(ordered, 1, most)).otherwise(F.col(items))


def blank(text: Column) -> Column:
    return F.coalesce(trimmed(text) == "", F.lit(True))


def first_n(df: DataFrame, key: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each key with their `rank`."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= n)
