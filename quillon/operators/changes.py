"""Writes of research state as tables: changes of versioned records, label sets, and lists of names that must not collide."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.functions import text as T
from quillon.sources import shared

CREATE, UPDATE, DELETE = "create", "update", "delete"
APPLIED, EXISTS, MISSING, CONFLICT, TAKEN, INVALID = "applied", "exists", "missing", "conflict", "name taken", "invalid"


def outcomes(state: DataFrame, changes: DataFrame, key: str, order: str = "sequence_id") -> DataFrame:
    """``changes`` (order, key, op, expected_version, other columns) with outcome and version, the record's version afterwards.

    Each key's changes are taken in order: a create needs a key that does not exist, an update or delete one that does, at the
    version it expects; two of one key and number are an error. ``state`` has key and version (1, 2, ...). A key's changes of one batch meet in one array."""
    if twice := changes.groupBy(key, order).count().filter("count > 1").first():
        raise ValueError(f"two changes of {twice[0]!r} have the number {twice[1]}")
    item = F.struct(order, "op", "expected_version")
    lists = changes.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("c")).join(state.select(key, F.col("version").cast("long").alias("_v")), key, "left")
    row = "struct<at:bigint,outcome:string,version:bigint>"
    start = F.struct(F.col("_v").alias("v"), F.array().cast(f"array<{row}>").alias("out"))

    def step(acc, x):
        there = acc["v"].isNotNull()
        said = (
            F.when(~x["op"].isin(CREATE, UPDATE, DELETE) | x["op"].isNull(), INVALID).when((x["op"] == CREATE) & there, EXISTS).when((x["op"] != CREATE) & ~there, MISSING)
            .when((x["op"] != CREATE) & ~x["expected_version"].cast("long").eqNullSafe(acc["v"]), CONFLICT).otherwise(APPLIED)
        )
        after = F.when(said != APPLIED, acc["v"]).when(x["op"] == CREATE, F.lit(1).cast("long")).when(x["op"] == UPDATE, acc["v"] + 1)
        return F.struct(after.alias("v"), F.concat(acc["out"], F.array(F.struct(x[order].cast("long").alias("at"), said.alias("outcome"), after.alias("version")))).alias("out"))

    folded = lists.select(key, F.explode(F.aggregate("c", start, step, lambda acc: acc["out"])).alias("o")).select(key, F.col("o.at").alias(order), "o.outcome", "o.version")
    return changes.join(folded, [key, order])


def apply_versioned(state: DataFrame, changes: DataFrame, key: str, order: str = "sequence_id", name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(the state afterwards, the changes with their outcome). ``state``: key, version, other columns; ``changes`` have those too.

    With ``name`` no two records have one name when folded, at any point of the batch: see :func:`named_outcomes`."""
    rest = [c for c in state.columns if c not in (key, "version")]
    done = named_outcomes(state, changes, key, name, order) if name else outcomes(state, changes, key, order)
    last = done.filter(F.col("outcome") == APPLIED).withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).filter("_n = 1")
    after = state.join(last.select(key), key, "left_anti").unionByName(last.filter(F.col("op") != DELETE).select(key, F.col("version").cast(state.schema["version"].dataType), *rest))
    return after, done


def connected(spark: SparkSession, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of an undirected graph of strings (a, b): the least node that is reachable. Each round takes the least label of the neighbours, then that label's own, and
    ends in a table of the shared folder."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    written = lambda df, name: (df.write.parquet(path := shared.folder(spark, name)), spark.read.parquet(path))[1]
    both = written(both, "edges")
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("_near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("_was"), F.least("label", "_near").alias("label"))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("_next"))
        found = written(step.join(jump, "label", "left").select("node", "_was", F.least("label", "_next").alias("label")), "labels")
        labels = found.select("node", "label")
        if found.filter("label <> _was").isEmpty():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _fold_names(rows: pd.DataFrame) -> pd.DataFrame:
    """The changes of one connected set, in order, on the records that hold its names."""
    held = rows[rows["_order"].isna()]
    versions, names = dict(zip(held["_key"], held["_version"].astype(int), strict=True)), dict(zip(held["_key"], held["_name"], strict=True))
    holder = {n: k for k, n in names.items() if n}
    out = []
    for x in rows[rows["_order"].notna()].sort_values("_order").itertuples(index=False):
        _, key, order, op, expected, _, name = x[:7]
        there = versions.get(key)
        if op not in (CREATE, UPDATE, DELETE):
            said = INVALID
        elif op == CREATE and there is not None:
            said = EXISTS
        elif op != CREATE and there is None:
            said = MISSING
        elif op != CREATE and (pd.isna(expected) or int(expected) != there):
            said = CONFLICT
        elif op != DELETE and not name:
            said = INVALID
        elif op != DELETE and holder.get(name, key) != key:
            said = TAKEN
        else:
            said = APPLIED
            if holder.get(names.get(key)) == key:
                del holder[names[key]]
            names.pop(key, None)
            versions.pop(key, None)
            if op != DELETE:
                versions[key], names[key], holder[name] = 1 if op == CREATE else there + 1, name, key
        out.append((key, int(order), said, versions.get(key)))
    return pd.DataFrame(out, columns=["_key", "_order", "outcome", "version"]).astype({"version": "Int64", "_order": "Int64"})


def named_outcomes(state: DataFrame, changes: DataFrame, key: str, name: str, order: str = "sequence_id") -> DataFrame:
    """As :func:`outcomes`, where no two records may have one folded name either. A create or update that asks for a name that another record has at that point is "name taken", one
    with a blank name "invalid"; a name is free again once its record was renamed or deleted by a change that was applied.

    Whether a name is free can hang on other records' outcomes, so changes are folded in order within each connected set of keys and names (a name links the record that holds it
    and all that ask for it), and sets side by side. A set is as large as the batch makes it. Two changes of one order number and key are an error."""
    spark, kind = changes.sparkSession, changes.schema[key].dataType.simpleString()
    if twice := changes.groupBy(key, order).count().filter("count > 1").first():
        raise ValueError(f"two changes of {twice[0]!r} have the number {twice[1]}")
    folded = T.squeeze(F.coalesce(F.col(name), F.lit("")))
    asked = changes.select(F.col(key).alias("_key"), F.col(order).cast("long").alias("_order"), F.col("op").alias("_op"), F.col("expected_version").cast("long").alias("_expected"), F.lit(None).cast("long").alias("_version"), folded.alias("_name"))
    records = state.select(F.col(key).alias("_key"), F.lit(None).cast("long").alias("_order"), F.lit(None).cast("string").alias("_op"), F.lit(None).cast("long").alias("_expected"), F.col("version").cast("long").alias("_version"), folded.alias("_name"))
    wanted = asked.filter("_name <> ''").select("_name").distinct()
    near = records.join(asked.select("_key").distinct(), "_key", "left_semi").unionByName(records.join(wanted, "_name", "left_semi").select(*records.columns)).distinct()
    rows = asked.unionByName(near)
    node = F.concat(F.lit("k"), F.col("_key").cast("string"))
    edges = rows.select(node.alias("a"), F.when(F.col("_name") == "", node).otherwise(F.concat(F.lit("n"), "_name")).alias("b"))
    sets = connected(spark, edges).select(F.col("node").alias("_node"), "component")
    placed = rows.withColumn("_node", node).join(sets, "_node").select(F.col("component").alias("_set"), *rows.columns)
    said = placed.groupBy("_set").applyInPandas(_fold_names, f"_key {kind}, _order long, outcome string, version long")
    return changes.join(said.select(F.col("_key").alias(key), F.col("_order").alias(order), "outcome", "version"), [key, order])


def replace_relations(relations: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``relations`` in which the keys of ``wanted`` have exactly its members; a wanted row with a null member clears its key."""
    members = [c for c in relations.columns if c != key]
    fresh = wanted.filter(" AND ".join(f"{c} IS NOT NULL" for c in members)).select(*relations.columns).distinct()
    return relations.join(wanted.select(key).distinct(), key, "left_anti").unionByName(fresh)


def set_labels(labels: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels afterwards, refused requests). Labels are of a speaker in one generation of a document (document_id,
    canonical_sha256, speaker_ref, label); the last request (sequence_id) of each counts, a null label removes it, an invalid one
    is refused."""
    keys = ["document_id", "canonical_sha256", "speaker_ref"]
    valid = F.col("label").isNull() | T.label_is_valid(F.col("label"))
    rows = requests.withColumn("label", T.strip(F.col("label")))
    last = rows.filter(valid).withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("sequence_id")))).filter("_n = 1")
    after = labels.join(last.select(*keys), keys, "left_anti").unionByName(last.filter("label IS NOT NULL").select(*labels.columns))
    return after, rows.filter(~valid)


#: The last number that a name may get when others are taken (fixed value).
LAST_SUFFIX = 1000


def _occupied(keys: DataFrame) -> DataFrame:
    """_s, _x, _held: how many of the names ``keys`` (_key) are numbered ones of that stem and ending. A name is read in each way it can be cut at a hyphen."""
    parts = F.split("_key", "-")
    cuts = keys.select(parts.alias("p")).filter("size(p) > 1").select("p", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("i"))
    cut = cuts.select(F.array_join(F.slice("p", F.lit(1), F.col("i")), "-").alias("_s"), F.array_join(F.slice("p", F.col("i") + 1, F.size("p")), "-").alias("rest"))
    number = F.regexp_extract("rest", "^[1-9][0-9]*", 0)
    return cut.withColumn("k", number).filter("k <> ''").groupBy("_s", F.expr("substring(rest, length(k) + 1)").alias("_x")).agg(F.count(F.lit(1)).alias("_held"))


def free_names(wanted: DataFrame, taken: DataFrame, order: str = "file_id", last: int | None = LAST_SUFFIX) -> DataFrame:
    """``wanted`` (order, stem, extension) with file_name: stem.extension, else stem-2, stem-3, ... to stem-``last`` (none: as far as needed), the first that is
    neither in ``taken`` (file_name) nor given to a file before; null if none is left. Names are compared folded and as a whole, so that ("x", "tar.gz") and
    ("x.tar", "gz") ask for one name. Without an extension a name is its stem.

    Numbers are given within a stem and extension: the n-th file gets the n-th free number, so these and their taken names meet in one task,
    at most ``last`` of which matter."""
    tail = F.when(F.coalesce("extension", F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit("."), "extension"))
    rows = wanted.withColumns({"_s": T.fold(F.col("stem")), "_x": T.fold(tail), "_t": tail}).withColumn("_base", F.concat("_s", "_x"))
    rows = rows.withColumn("_first", F.row_number().over(W.partitionBy("_base").orderBy(order)) == 1)
    # The first file of a whole name may get it as it is; of the others, each stem and extension has its own numbers.
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy("_s", "_x").orderBy(F.desc("_first"), order)))
    whole = rows.groupBy("_s", "_x", "_base").agg(F.max("_first").alias("_own"), F.count(F.lit(1)).alias("_files"))
    names = taken.select(T.fold(F.col("file_name")).alias("_key")).distinct()
    highest = F.lit(last)
    if last is None:  # each file takes one number; others lack a number only where a name has it already
        whole = whole.join(_occupied(names.unionByName(rows.select(F.col("_base").alias("_key"))).distinct()), ["_s", "_x"], "left").fillna(0, ["_held"])
        highest = (F.col("_files") + F.col("_held") + 1).cast("int")
    numbers = whole.select("_s", "_x", "_base", "_own", F.explode(F.sequence(F.lit(1), highest)).alias("_k")).filter("_k > 1 OR _own")
    key = F.when(F.col("_k") == 1, F.col("_base")).otherwise(F.concat("_s", F.lit("-"), F.col("_k").cast("string"), "_x"))
    numbers = numbers.withColumn("_key", key)
    bases = rows.select(F.col("_base").alias("_key")).distinct()  # another stem may look like a numbered one
    numbers = numbers.filter("_k = 1").unionByName(numbers.filter("_k > 1").join(bases, "_key", "left_anti"))
    free = numbers.join(names, "_key", "left_anti")
    free = free.withColumn("_n", F.row_number().over(W.partitionBy("_s", "_x").orderBy("_k"))).select("_s", "_x", "_n", "_k", "_key")
    named = F.when(F.col("_k") == 1, F.concat("stem", "_t")).otherwise(F.concat("stem", F.lit("-"), F.col("_k").cast("string"), "_t"))
    met = rows.join(free, ["_s", "_x", "_n"], "left")
    again = F.row_number().over(W.partitionBy(F.coalesce("_key", F.concat(F.lit("/"), F.col(order).cast("string")))).orderBy(order)) > 1  # numbered alike by two ways to cut a name
    return met.withColumn("file_name", F.when(F.col("_k").isNotNull() & ~again, named)).drop("_s", "_x", "_t", "_base", "_first", "_n", "_k", "_key")
