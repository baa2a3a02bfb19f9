"""Tables kept as numbered folders that are merged by levels.

A writer adds a folder for each batch of changes and commits by writing one small
row, the manifest, into one of two places in turn: a writer that dies leaves the
other, older manifest whole.  FAN folders of a level become one of the next, so a
table of any number of batches is read from at most FAN - 1 folders a level.
Folders that no manifest names any more are emptied.  One writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

FAN = 8


def manifest(spark: SparkSession, path: str) -> dict[str, Any]:
    """The newest committed manifest: version, folders [(number, level)], retired [(number, version)] and what its writer keeps in `own`."""
    try:
        rows = spark.read.schema("version long, state string").parquet(f"{path}/manifest").collect()  # two rows at most
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        rows = []
    if not rows:
        return {"version": -1, "next": 0, "folders": [], "retired": [], "own": {}}
    return json.loads(max(rows).state)


def commit(spark: SparkSession, path: str, state: dict[str, Any]) -> dict[str, Any]:
    state = {**state, "version": state["version"] + 1}
    row = spark.createDataFrame([(state["version"], json.dumps(state))], "version long, state string").coalesce(1)
    row.write.mode("overwrite").parquet(f"{path}/manifest/slot={state['version'] % 2}")
    return state


def added(state: dict[str, Any], number: int, own: dict[str, Any]) -> dict[str, Any]:
    """A manifest with a new folder of level 0."""
    return {**state, "next": number + 1, "folders": [*state["folders"], [number, 0]], "own": own}


def full_level(state: dict[str, Any], fan: int = FAN) -> tuple[int, list[int]] | None:
    """The lowest level that has `fan` folders, and these."""
    for level in sorted({level for _, level in state["folders"]}):
        numbers = [n for n, own in state["folders"] if own == level]
        if len(numbers) >= fan:
            return level, numbers
    return None


def merged(state: dict[str, Any], numbers: Sequence[int], level: int, number: int, own: dict[str, Any]) -> dict[str, Any]:
    """A manifest with one folder of the next level in place of `numbers`, which are newer than all folders of higher levels."""
    rest = [f for f in state["folders"] if f[0] not in numbers]
    place = sum(1 for _, other in rest if other > level)
    folders = [*rest[:place], [number, level + 1], *rest[place:]]
    return {**state, "next": number + 1, "folders": folders, "retired": [*state["retired"], *([n, state["version"] + 1] for n in numbers)], "own": own}


def emptied(spark: SparkSession, state: dict[str, Any], empty: Callable[[int], None]) -> dict[str, Any]:
    """A manifest without the folders that neither of the two kept manifests names; empty(number) writes an empty table in their place."""
    gone = [n for n, at in state["retired"] if at < state["version"]]
    for number in gone:
        empty(number)
    return {**state, "retired": [x for x in state["retired"] if x[0] not in gone]}


def read(spark: SparkSession, path: str, part: str, state: dict[str, Any], schema: str, numbers: Sequence[int] | None = None) -> DataFrame:
    """Rows of the live folders of a part of a table."""
    numbers = [n for n, _ in state["folders"]] if numbers is None else numbers
    if not numbers:
        return spark.createDataFrame([], schema)
    return spark.read.option("basePath", f"{path}/{part}").schema(schema).parquet(*[f"{path}/{part}/folder={n}" for n in numbers]).drop("folder")


def write(rows: DataFrame, path: str, part: str, number: int, by: str | None = None, more: bool = False, codec: str | None = None) -> None:
    """A folder of a part of a table, or more of its rows; codec: another compression than the session's."""
    out = rows.write.mode("append" if more else "overwrite")
    out = out.option("compression", codec) if codec else out
    (out.partitionBy(by) if by else out).parquet(f"{path}/{part}/folder={number}")
