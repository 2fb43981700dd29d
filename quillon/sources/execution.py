"""Execution of confirmed plans: rows leave the tables in one commit, then files and folders go, with an intent that is written first.

The intent is what was confirmed, as a table under the plan's token. It is written before the first action, only if the plan made again from the present state has
the same token. Whoever runs a plan with an intent goes on where it was left, and ends with the same state and receipt; each action can be done twice.
A plan that is done does nothing more."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.custody import SCOPES
from quillon.sources import generations
from quillon.sources.generations import _path

INTENT = "order_no int, target string, object_id string, path string, existed boolean"


class Refused(ValueError):
    """The plan has changed, its token is wrong, or it would touch what lies outside."""


def _exists(spark: SparkSession, name: str) -> bool:
    path, files = _path(spark, name)
    return files.exists(path)


def _inside(path: str, roots: list[str]) -> bool:
    """A plain path below one of the roots, without steps upwards."""
    return any(path.startswith(root.rstrip("/") + "/") and len(path) > len(root.rstrip("/")) + 1 for root in roots) and not {"..", ".", ""} & set(path.split("://")[-1].lstrip("/").split("/"))


def _record(spark: SparkSession, log: str, actions: DataFrame, roots: list[str]) -> None:
    """The intent: actions in the order of their scopes. Paths are checked before anything is written; whether a path exists is noted one by one by the driver
    for those that have one."""
    if "path" not in actions.columns:
        actions = actions.withColumn("path", F.lit(None).cast("string"))
    place = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SCOPES]), F.col("target")), F.lit(0)).cast("int")
    rows = actions.select(place.alias("order_no"), "target", F.col("object_id").cast("string").alias("object_id"), "path").distinct()
    rows.write.mode("overwrite").parquet(f"{log}/draft")
    draft = spark.read.parquet(f"{log}/draft")
    for row in draft.filter("path IS NOT NULL").select("path").toLocalIterator():
        if not _inside(row["path"], roots):
            raise Refused(f"{row['path']} lies outside of what may be deleted")
    paths, there = draft.filter("path IS NOT NULL").select("path").distinct(), []
    for start in paths.toLocalIterator():
        there.append((start["path"], _exists(spark, start["path"])))
        if len(there) == 10_000:  # noted in pieces, so that the driver holds few
            spark.createDataFrame(there, "path string, existed boolean").write.mode("append").parquet(f"{log}/existed")
            there = []
    spark.createDataFrame(there, "path string, existed boolean").write.mode("append").parquet(f"{log}/existed")
    noted = spark.read.parquet(f"{log}/existed").groupBy("path").agg(F.max("existed").alias("existed"))
    draft.join(noted, "path", "left").select("order_no", "target", "object_id", "path", "existed").write.mode("overwrite").parquet(f"{log}/intent")


def receipt(spark: SparkSession, log_root: str, token: str) -> DataFrame | None:
    """What a finished plan has done: target, object_id, path, existed (null where there was no path). None if it is not finished."""
    log = f"{log_root}/{hashlib.sha256(token.encode()).hexdigest()[:32]}"
    return spark.read.schema(INTENT).parquet(f"{log}/intent") if _exists(spark, f"{log}/done") else None


def execute(
    spark: SparkSession, log_root: str, token: str, plan: Callable[[], tuple[DataFrame, str]], tables_root: str | None = None,
    tables: dict[str, list[tuple[str, str]]] | None = None, roots: list[str] | None = None,
) -> DataFrame:
    """Run the plan that ``token`` confirms and return its receipt.

    ``plan()`` makes it again from the present state: (target, object_id and, for files and folders, path) and its token; another token is :class:`Refused` and nothing is
    touched. ``tables``: for a target the tables of the state in ``tables_root`` and their key columns, from which rows with its object ids go. ``roots``: the folders below
    which paths may be deleted. An unfinished run of the same token is continued."""
    log = f"{log_root}/{hashlib.sha256(token.encode()).hexdigest()[:32]}"
    if (finished := receipt(spark, log_root, token)) is not None:
        return finished
    if not _exists(spark, f"{log}/intent/_SUCCESS"):
        actions, now = plan()
        if now != token:
            raise Refused("the plan has changed since it was confirmed, or the token is another's")
        _record(spark, log, actions, roots or [])
    intent = spark.read.schema(INTENT).parquet(f"{log}/intent")
    if tables and not _exists(spark, f"{log}/rows-gone"):
        generations.transact(spark, tables_root, lambda base: _without(spark, base, intent, tables))
        _mark(spark, f"{log}/rows-gone")
    for row in intent.filter("path IS NOT NULL").orderBy("order_no", "object_id", "path").toLocalIterator():
        path, files = _path(spark, row["path"])
        files.delete(path, True)
    _mark(spark, f"{log}/done")
    return intent


def _mark(spark: SparkSession, name: str) -> None:
    path, files = _path(spark, name)
    files.create(path, True).close()


def _without(spark: SparkSession, base: generations.Commit | None, intent: DataFrame, tables: dict[str, list[tuple[str, str]]]) -> dict:
    """The commit that takes the intent's rows out of each table that a target of it has."""
    if base is None:
        raise ValueError("there is no state to delete from")
    targets = {r[0] for r in intent.select("target").distinct().collect()}  # at most one for each scope
    per: dict[str, DataFrame] = {}
    for target in sorted(targets & set(tables)):
        gone = intent.filter(F.col("target") == target).select(F.col("object_id").alias("_gone")).distinct()
        for name, key in tables[target]:
            rows = per.get(name, base.read(spark, name))
            per[name] = rows.join(gone, F.col(key).cast("string") == F.col("_gone"), "left_anti")
    return {"watermark": base.watermark, "replace": per}
