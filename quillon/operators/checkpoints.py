"""Checkpoints of a recording's windows, sealed to the contract they were made under and to one another.

An envelope holds its contract's digest, its payload's digest and a chain digest over both, its place and the chain before it. So a restart can tell how many windows stand from the first on,
and why it stops there: another contract, a changed payload, a lost or repeated window, or an envelope of another chain. A recording's envelopes (a window is ten minutes) meet in one array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTRACT, PAYLOAD, CHAIN, GAP, REPEATED, UNKNOWN = "contract", "payload", "chain", "gap", "repeated", "unknown window"


def contract_digest(*fields: str) -> Column:
    """A digest of what a job was asked for: its fields as compact JSON in the order of their names, nulls included."""
    return F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256)


def link(contract: Column, index: Column, payload_sha: Column, before: Column) -> Column:
    return F.sha2(F.concat_ws("\0", contract, index.cast("string"), payload_sha, before), 256)


def sealed(results: DataFrame) -> DataFrame:
    """``results`` (document_id, window_index, contract_sha256, payload; one contract and one row per window) with payload_sha256 and chain_sha256."""
    rows = results.withColumn("payload_sha256", F.sha2(F.coalesce("payload", F.lit("")), 256))
    item = F.struct(F.col("window_index").cast("int").alias("i"), F.col("contract_sha256").alias("c"), F.col("payload_sha256").alias("p"))
    start = F.struct(F.lit("").alias("h"), F.array().cast("array<struct<i:int,h:string>>").alias("out"))

    def step(acc, x):
        h = link(x["c"], x["i"], x["p"], acc["h"])
        return F.struct(h.alias("h"), F.concat(acc["out"], F.array(F.struct(x["i"].alias("i"), h.alias("h")))).alias("out"))

    chains = rows.groupBy("document_id").agg(F.aggregate(F.array_sort(F.collect_list(item)), start, step, lambda acc: acc["out"]).alias("o"))
    chains = chains.select("document_id", F.explode("o").alias("o")).select("document_id", F.col("o.i").alias("window_index"), F.col("o.h").alias("chain_sha256"))
    return rows.join(chains, ["document_id", "window_index"])


def restored(stored: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per job: complete, the number of windows from the first on that stand, and problem, why not more of those stored do (null if all do).

    ``stored``: sealed envelopes as they were found; ``jobs``: document_id, contract_sha256 (the present one) and windows (how many are planned). Envelopes of no job are left out."""
    item = F.struct(
        F.col("window_index").cast("int").alias("i"), F.col("contract_sha256").alias("c"), F.sha2(F.coalesce("payload", F.lit("")), 256).eqNullSafe(F.col("payload_sha256")).alias("same"),
        F.col("payload_sha256").alias("p"), F.col("chain_sha256").alias("h"),
    )
    found = stored.groupBy("document_id").agg(F.array_sort(F.collect_list(item)).alias("x"))
    met = jobs.select("document_id", F.col("contract_sha256").alias("now"), F.col("windows").cast("int").alias("planned")).join(found, "document_id", "left")
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("h"), F.lit(None).cast("string").alias("problem"))

    def step(acc, x):
        n = acc["n"]
        wrong = (
            F.when(x["i"].isNull() | (x["i"] < 0) | (x["i"] >= F.col("planned")), UNKNOWN).when(x["i"] < n, REPEATED).when(x["i"] > n, GAP).when(~x["c"].eqNullSafe(F.col("now")), CONTRACT)
            .when(~x["same"], PAYLOAD).when(~x["h"].eqNullSafe(link(x["c"], x["i"], x["p"], acc["h"])), CHAIN)
        )
        problem = F.coalesce(acc["problem"], wrong)
        sound = problem.isNull()
        return F.struct(F.when(sound, n + 1).otherwise(n).alias("n"), F.when(sound, x["h"]).otherwise(acc["h"]).alias("h"), problem.alias("problem"))

    end = F.aggregate(F.coalesce("x", F.array().cast(found.schema["x"].dataType)), start, step)
    return met.select("document_id", end.alias("e")).select("document_id", F.col("e.n").cast("long").alias("complete"), F.col("e.problem").alias("problem"))
