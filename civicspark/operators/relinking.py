"""Links between datasets that share an entity, kept up under changes of what is attached.

    attachments/folder=N/bucket=K   (entity, dataset, kind, present, batch): what batch N changed
    links/folder=N/bucket=K         (via, dataset, kind, batch): the datasets of each entity that batch N touched, where it links them, else a row without a dataset

An entity links each two of its datasets, unless they are more than `fanout`; the
links table holds the datasets, as rows, and they are paired when they are read.  A
batch reads the buckets and entities that it changes, and writes their links anew,
none where the entity has become a hub, all where it is one no more.  Of an entity
the links of its newest batch hold; merging folders (see `levels`) drops the others.
A change that changes nothing touches nothing.

A batch is one shuffle, of its changes with what they may change, dealt and sorted
as both tables are written.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicspark.operators import levels, linking

BUCKETS = 64
#: Rows that a task sorts and writes at once, about.
PART = 2_000_000
#: Changes whose entities are sent to all tasks, so that others of their buckets are left out before the shuffle.
FEW = 100_000
#: Number of the layout, for folders that outlive a session.
LAYOUT = 2
_LINKS = "via string, dataset {0}, kind string, batch int, bucket int"
_ATTACHMENTS = "entity string, dataset {0}, kind string, present boolean, batch int, bucket int"
#: Columns by which rows are dealt to tasks, besides the entity.
_AT = ["bucket", "part"]


def _bucket(entity: str, buckets: int):
    return F.pmod(F.xxhash64(entity), F.lit(buckets)).cast("int").alias("bucket")


def _spread(rows: DataFrame, entity: str, buckets: int, count: int) -> DataFrame:
    """By buckets, each in parts of about PART rows: what a task sorts does not grow with the table."""
    parts = max(1, -(-count // (buckets * PART)))
    return rows.withColumn("part", F.pmod(F.xxhash64(F.col(entity), F.lit(1)), F.lit(parts))).repartition(buckets * parts, *_AT)


def _newest(rows: DataFrame, *key: str) -> DataFrame:
    """Of each key, whose rows are in one task, the rows of its newest batch."""
    last = F.max("batch").over(Window.partitionBy(*key))
    return rows.withColumn("_last", last).where("batch = _last").drop("_last")


def apply_changes(changes: DataFrame, path: str, batch: int, buckets: int = BUCKETS, fan: int = levels.FAN, fanout: int = linking.FANOUT) -> None:
    """Take in changes (dataset, entity, kind, present) as batch number `batch`; a committed batch is left alone.

    present: whether the dataset has the entity from now on; of several changes of one
    pair in a batch having it wins.  Rows without dataset or entity are left out.
    """
    spark = changes.sparkSession
    state = levels.manifest(spark, path)
    if state["own"] and state["own"].get("layout") != LAYOUT:
        raise ValueError(f"links in {path} have another layout")
    if state["own"] and batch <= state["own"]["batch"]:
        return
    own = state["own"] or {"dataset": dict(changes.dtypes)["dataset"], "buckets": buckets, "layout": LAYOUT}
    number, kind, buckets = state["next"], own["dataset"], own["buckets"]
    schemas = {"attachments": _ATTACHMENTS.format(kind), "links": _LINKS.format(kind)}
    state = levels.emptied(spark, state, lambda old: [levels.write(spark.createDataFrame([], s), path, part, old, "bucket") for part, s in schemas.items()])
    rows = changes.where("dataset is not null and entity is not null")
    rows.select("entity", "dataset", "kind", "present", F.lit(number).alias("batch"), _bucket("entity", buckets)).write.mode("overwrite").parquet(f"{path}/staged")
    rows = staged = spark.read.schema(schemas["attachments"]).parquet(f"{path}/staged")
    count = staged.count()
    if state["folders"]:
        touched = [b for (b,) in staged.select("bucket").distinct().collect()]  # at most as many as buckets
        before = levels.read(spark, path, "attachments", state, schemas["attachments"]).where(F.col("bucket").isin(touched))
        if count <= FEW:
            before = before.join(F.broadcast(staged.select("entity").distinct()), "entity", "left_semi")
        count += before.count()
        rows = staged.unionByName(before)
    now = _changed(_spread(rows, "entity", buckets, count), number, fanout).persist(StorageLevel.DISK_ONLY)
    levels.write(now.where("changed").select("entity", "dataset", "kind", "present", F.lit(number).alias("batch"), "bucket"), path, "attachments", number, "bucket")
    # a row for each dataset that is linked, and one for an entity that links nothing
    linked = F.when(F.col("linking"), F.col("dataset")).alias("dataset")
    links = now.where("(linking and present) or (not linking and first)")
    levels.write(links.select(F.col("entity").alias("via"), linked, F.when(F.col("linking"), F.col("kind")).alias("kind"), F.lit(number).alias("batch"), "bucket"), path, "links", number, "bucket")
    now.unpersist()
    spark.createDataFrame([], schemas["attachments"]).write.mode("overwrite").parquet(f"{path}/staged")
    state = levels.commit(spark, path, levels.added(state, number, {**own, "batch": batch}))
    while full := levels.full_level(state, fan):
        state = _merge(spark, path, state, schemas, *full)


def _changed(rows: DataFrame, number: int, fanout: int) -> DataFrame:
    """Of the entities that batch `number` changes: (entity, dataset, kind, present) as they are then, with whether the batch changed the row, whether the entity links its datasets, and whether the row is its first.

    rows: attachments of the batch and of those before, as dealt by `_spread`.  Of
    entities that link nothing the rows that are not changed are left out, but for the first.
    """
    new = F.col("batch") == number
    was = F.max(F.when(~new, F.struct("batch", "present", "kind"))).alias("was")
    pairs = rows.groupBy(*_AT, "entity", "dataset").agg(F.max(F.when(new, F.col("present"))).alias("to"), F.max(F.when(new, F.col("kind"))).alias("as"), was)
    # what is so already is no change
    changed = F.expr("coalesce(to <> coalesce(was.present, false) or (to and as is distinct from was.kind), false)")
    pairs = pairs.withColumn("changed", changed).selectExpr(*_AT, "entity", "dataset", "changed", "if(changed, as, was.kind) AS kind", "if(changed, to, coalesce(was.present, false)) AS present")
    of = Window.partitionBy(*_AT, "entity")
    pairs = pairs.withColumns({"n": F.count_if("present").over(of), "touched": F.max("changed").over(of), "first": F.row_number().over(of.orderBy("dataset")) == 1})
    pairs = pairs.where("touched").withColumn("linking", F.col("n").between(2, fanout))
    return pairs.where("changed or first or (linking and present)").select("entity", "dataset", "kind", "present", "changed", "linking", "first", "bucket")


def _merge(spark: SparkSession, path: str, state: dict, schemas: dict[str, str], level: int, numbers: list[int]) -> dict:
    number, oldest = state["next"], len(numbers) == len(state["folders"])
    changes, links = (levels.read(spark, path, part, state, schemas[part], numbers) for part in ("attachments", "links"))
    counts, buckets = (changes.count(), links.count()), state["own"]["buckets"]
    changes = _newest(_spread(changes, "entity", buckets, counts[0]), *_AT, "entity", "dataset")
    links = _newest(_spread(links, "via", buckets, counts[1]), *_AT, "via")
    if oldest:  # nothing older is left to be undone
        changes, links = changes.where("present"), links.where("dataset is not null")
    levels.write(changes.drop("part"), path, "attachments", number, "bucket")
    levels.write(links.drop("part"), path, "links", number, "bucket")
    return levels.commit(spark, path, levels.merged(state, numbers, level, number, state["own"]))


def current_links(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, via, heuristic, confidence) as they stand."""
    state = levels.manifest(spark, path)
    if state["own"] and state["own"].get("layout") != LAYOUT:
        raise ValueError(f"links in {path} have another layout")
    rows = levels.read(spark, path, "links", state, _LINKS.format(state["own"].get("dataset", "string")))
    sets = _newest(rows, "via").where("dataset is not null").groupBy("via").agg(F.array_sort(F.collect_list(F.struct("dataset", "kind"))).alias("own"))  # at most fanout
    each = sets.select("via", "own", F.posexplode("own").alias("i", "x"))
    both = each.select("via", "x", F.explode(F.expr("slice(own, i + 2, size(own))")).alias("y"))
    return both.select(F.col("x.dataset").alias("a"), F.col("y.dataset").alias("b"), "via", *linking.how_linked(F.col("x.kind")))
