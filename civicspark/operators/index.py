"""Index upkeep: differences of fingerprints, purges, revisions, merges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def incremental_diff(now: DataFrame, state: DataFrame, present: DataFrame, key: str, model: str) -> DataFrame:
    """What to do with each current document: insert, update, reembed or skip.

    now: (key, content_fp, embed_fp); state: the same and model_id; present: keys
    that the index really holds.  A document is skipped only when its
    fingerprints and model are as before and it is there; a change of both content
    and model counts as content.
    """
    old = state.select(key, F.col("content_fp").alias("_c"), F.col("embed_fp").alias("_e"), F.col("model_id").alias("_m"))
    rows = now.join(old, key, "left").join(present.select(key).distinct().withColumn("_here", F.lit(True)), key, "left")
    same_content = F.col("content_fp").eqNullSafe(F.col("_c")) & F.col("embed_fp").eqNullSafe(F.col("_e"))
    action = (
        F.when(F.col("_c").isNull(), "insert").when(~same_content | F.col("_here").isNull(), "update")
        .when(~F.col("_m").eqNullSafe(F.lit(model)), "reembed").otherwise("skip")
    )
    return rows.select(key, action.alias("action"))


def orphans(stores: Sequence[DataFrame], active: DataFrame, key: str) -> DataFrame:
    """Keys in any store of the index that no active dataset has."""
    held = stores[0].select(key)
    for store in stores[1:]:
        held = held.union(store.select(key))
    return held.distinct().join(active, key, "left_anti")


def revisions(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, old, new) of every field of rows in both that differs, nulls equal to nulls."""
    names = [f"`{f}`" for f in fields]
    long = lambda df: df.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(n).cast("string").alias("value")) for f, n in zip(fields, names, strict=True)])).alias("_f")).select(key, "_f.*")
    both = long(old).withColumnRenamed("value", "old").join(long(new).withColumnRenamed("value", "new"), [key, "field"])
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select(key, "field", "old", "new")


def merge(old: DataFrame, new: DataFrame, key: Sequence[str], keep: Mapping[str, str] | None = None) -> DataFrame:
    """Upsert new rows on a key.

    keep says of a column what a new row may not undo: `old` (the first value
    stays), `null` (a null does not replace), `empty` (nor does an empty text).
    """
    keep = keep or {}
    rest = [c for c in old.columns if c not in key]
    fresh = new.select(*key, *[F.col(c).alias(f"_new_{c}") for c in rest], F.lit(True).alias("_in_new"))
    both = old.withColumn("_in_old", F.lit(True)).join(fresh, list(key), "full")

    def column(c: str) -> Column:
        was, now = F.col(c), F.col(f"_new_{c}")
        value = {"old": was, "null": F.coalesce(now, was), "empty": F.coalesce(F.when(now != "", now), was)}.get(keep.get(c, ""), now)
        return F.when(F.col("_in_new").isNull(), was).when(F.col("_in_old").isNull(), now).otherwise(value).alias(c)

    return both.select(*[column(c) if c in rest else F.col(c) for c in old.columns])


def insert_absent(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(list(key)).join(old, list(key), "left_anti").select(*old.columns))
