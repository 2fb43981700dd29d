"""Deletion and retention plans: what would go, bound to a token that changes with the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scopes in their order, and what the transcript scope takes with it (fixed values).
SCOPES = ["library-view", "derived-artifacts", "execution-state", "canonical-transcript", "research-notes", "saved-searches", "source-recording"]
IMPLIED = {"canonical-transcript": ["library-view", "derived-artifacts", "execution-state"]}
COMPLETED, RUNNING = "completed", "running"
#: First lines of what tokens are made from (fixed values).
DELETE_HEAD, RETENTION_HEAD = "delete-v1", "retention-v1"


def effective_scopes(requested: list[str]) -> list[str]:
    if not requested or set(requested) - set(SCOPES):
        raise ValueError("scopes must be known, and at least one")
    whole = set(requested).union(*(IMPLIED.get(s, []) for s in requested))
    return [s for s in SCOPES if s in whole]


def token(parts: Column, prefix: str, size: int) -> Column:
    """``prefix:`` and the first digits of the digest of lines."""
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha2(F.array_join(parts, "\n"), 256), 1, size))


def retention_candidates(jobs: DataFrame, cutoff: Column, include_incomplete: bool) -> DataFrame:
    """``jobs`` (job_id, status, updated_at) that may be discarded: never running ones, unfinished ones only if asked, none
    updated after the cutoff. resume_lost: an unfinished job could not go on."""
    rows = jobs.filter((F.col("status") != RUNNING) & (F.col("updated_at") <= cutoff))
    if not include_incomplete:
        rows = rows.filter(F.col("status") == COMPLETED)
    return rows.withColumn("resume_lost", F.col("status") != COMPLETED)


def retention_token(candidates: DataFrame, days: int, include_incomplete: bool) -> DataFrame:
    """One row: candidates, confirmation_token, bound to every candidate's id, status, time and workspace_path.

    Lines are digested in 4096 groups by job id, so that no task reads them all."""
    line = F.concat_ws(":", F.col("job_id").cast("string"), "status", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.coalesce("workspace_path", F.lit("")))
    group = F.substring(F.sha2(F.col("job_id").cast("string"), 256), 1, 3)
    parts = candidates.select(group.alias("g"), line.alias("l")).groupBy("g").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("l")), "\n"), 256).alias("h"), F.count(F.lit(1)).alias("n"))
    head = F.array(F.lit(RETENTION_HEAD), F.lit(str(days)), F.lit(str(include_incomplete)))
    whole = parts.agg(F.array_sort(F.collect_list(F.concat("g", "h"))).alias("s"), F.coalesce(F.sum("n"), F.lit(0)).alias("candidates"))
    return whole.select("candidates", token(F.concat(head, F.col("s")), "retention", 24).alias("confirmation_token"))


#: What becomes of a line of a deletion plan.
ACTION, PRESERVED, AFFECTED = "action", "preserved", "affected"


def deletion_actions(documents: DataFrame, notes: DataFrame, saved: DataFrame, scopes: list[str]) -> DataFrame:
    """(document_id, target, object_id, fate): what goes with each document ("action"), the notes that stay although it goes
    ("preserved"), and the saved searches that name it and stay ("affected").

    ``notes``: note_id, document_id; ``saved``: saved_search_id, document_id (a row per document that it names)."""
    effective = effective_scopes(scopes)
    own = [s for s in effective if s not in ("research-notes", "saved-searches")]
    rows = documents.select("document_id", F.explode(F.array(*[F.lit(s) for s in own]).cast("array<string>")).alias("target"), F.col("document_id").cast("string").alias("object_id"), F.lit(ACTION).alias("fate"))
    for table, name, target, scope, otherwise in ((notes, "note_id", "research-note", "research-notes", PRESERVED), (saved, "saved_search_id", "saved-search", "saved-searches", AFFECTED)):
        named = table.join(documents.select("document_id"), "document_id", "left_semi")
        rows = rows.unionByName(named.select("document_id", F.lit(target).alias("target"), F.col(name).cast("string").alias("object_id"), F.lit(ACTION if scope in effective else otherwise).alias("fate")))
    return rows


def deletion_plans(actions: DataFrame, documents: DataFrame, scopes: list[str]) -> DataFrame:
    """Per document: n_actions, n_preserved, n_affected, confirmation_token, bound to its generation, to the scopes as asked and
    as they take effect, and to every line of the plan.

    Lines are digested in 256 groups of each document first: a document may have a third of all notes."""
    line = F.concat_ws(":", "fate", "target", "object_id")
    counts = {name: (F.col("fate") == fate).cast("long").alias(name) for name, fate in (("n_actions", ACTION), ("n_preserved", PRESERVED), ("n_affected", AFFECTED))}
    rows = actions.select("document_id", F.substring(F.sha2(line, 256), 1, 2).alias("g"), line.alias("l"), *counts.values())
    sums = [F.sum(n).alias(n) for n in counts]
    groups = rows.groupBy("document_id", "g").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("l")), "\n"), 256).alias("h"), *sums)
    per = groups.groupBy("document_id").agg(F.array_sort(F.collect_list(F.concat("g", "h"))).alias("l"), *sums)
    asked = [F.lit(f"requested:{s}") for s in SCOPES if s in scopes]
    head = [F.lit(DELETE_HEAD), F.col("document_id").cast("string"), F.col("canonical_sha256"), *asked, *[F.lit(f"effective:{s}") for s in effective_scopes(scopes)]]
    digest = F.substring(F.sha2(F.array_join(F.concat(F.array(*head), F.col("l")), "\n"), 256), 1, 16)
    out = documents.select("document_id", "canonical_sha256").join(per, "document_id")
    return out.select("document_id", *counts, F.concat_ws(":", F.lit("delete"), F.col("document_id").cast("string"), F.substring("canonical_sha256", 1, 12), digest).alias("confirmation_token"))


def volume_admission(needs: DataFrame) -> DataFrame:
    """``needs`` (volume, required, free): what each volume must hold, its least free space, and whether that is enough."""
    per = needs.groupBy("volume").agg(F.sum("required").alias("required"), F.min("free").alias("free"))
    return per.withColumn("admitted", F.col("required") <= F.col("free"))


def batch_token(plans: DataFrame) -> DataFrame:
    """One row: documents, confirmation_token, bound to the tokens of many documents' plans (document_id, confirmation_token).

    They are digested in 4096 groups by document first, so that no task reads them all."""
    group = F.substring(F.sha2(F.col("document_id").cast("string"), 256), 1, 3)
    parts = plans.select(group.alias("g"), "confirmation_token").groupBy("g").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("confirmation_token")), "\n"), 256).alias("h"), F.count(F.lit(1)).alias("n"))
    whole = parts.agg(F.array_sort(F.collect_list(F.concat("g", "h"))).alias("s"), F.coalesce(F.sum("n"), F.lit(0)).alias("documents"))
    return whole.select("documents", token(F.concat(F.array(F.lit(DELETE_HEAD)), F.col("s")), "delete-batch", 24).alias("confirmation_token"))
