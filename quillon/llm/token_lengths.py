"""Exact histogram of token counts, and what every context limit costs.

Every text is encoded whole, its length alone is kept, and documents are summed by length. The histogram answers for each limit
L: documents over it, tokens that fit (sum of min(length, L)), tokens cut off and the quantile it stands at. Suffix
sums run in two levels, over groups of 1024 lengths and inside each group, so that no task reads the whole histogram.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import table

#: Where the public vocabulary lies, and the pattern that cuts text before merging (both parameters below).
RANKS_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public pattern of this vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lengths in one group of the second level.
GROUP = 1024
#: Rows that are encoded at once.
ROWS = 200


def load_ranks(path: str = RANKS_PATH) -> dict[bytes, int]:
    """Read a vocabulary on the driver; what is sent to tasks is as large as the file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_encodings: dict[int, object] = {}


def _encoding(sent):
    import tiktoken

    found = _encodings.get(id(sent.value))
    if found is None:
        ranks, pattern = sent.value
        _encodings.clear()
        found = _encodings[id(sent.value)] = tiktoken.Encoding("lengths", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return found


def _length_batches(sent):
    def run(batches):
        encoding = _encoding(sent)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                n = [len(encoding.encode_ordinary(t)) if t else 0 for t in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(np.array(n, dtype=np.int64))], names=[*part.schema.names[:-1], "n_tokens"])

    return run


def lengths(docs: DataFrame, text_col: str = "text", keep: list[str] = ["doc_id"], path: str = RANKS_PATH, pattern: str = PATTERN) -> DataFrame:  # noqa: B006
    """The ``keep`` columns of every row and n_tokens, the encoded length of its whole text (0 for null and empty texts).

    Repeated rows are each counted; an empty table gives no rows; a kept column called n_tokens is replaced."""
    keep = [c for c in keep if c.lower() != "n_tokens"]
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    sent = docs.sparkSession.sparkContext.broadcast((load_ranks(path), pattern))
    return rows.mapInArrow(_length_batches(sent), kept + "n_tokens long")


def histogram(counted: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """(n_tokens, n_docs): how many rows have each length. Null lengths are left out."""
    return counted.select(F.col(length_col).cast("long").alias("n_tokens")).filter("n_tokens IS NOT NULL").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def limits(hist: DataFrame, group: int = GROUP) -> DataFrame:
    """One row for each length that occurs, read as a context limit:

    n_docs (of that length), docs_over and tokens_over (of documents that are longer), docs_within, kept_tokens (the sum of
    min(length, limit)), cut_tokens, quantile (share of documents within), total_docs, total_tokens. Between two lengths the
    figures follow from the row before (see :func:`at_limits`). An empty histogram gives no rows."""
    rows = table(hist.withColumn("g", F.floor(F.col("n_tokens") / group)).withColumn("t", F.col("n_tokens") * F.col("n_docs")), "length-histogram")
    groups = rows.groupBy("g").agg(F.sum("n_docs").alias("gd"), F.sum("t").alias("gt"))
    after = W.orderBy(F.desc("g")).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(1))
    groups = groups.select(
        "g", F.coalesce(F.sum("gd").over(after), F.lit(0)).alias("docs_after"), F.coalesce(F.sum("gt").over(after), F.lit(0)).alias("tokens_after"),
        F.sum("gd").over(every).alias("total_docs"), F.sum("gt").over(every).alias("total_tokens"),
    )
    longer = W.partitionBy("g").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, -1)
    out = rows.join(groups, "g").withColumns(
        {
            "docs_over": F.coalesce(F.sum("n_docs").over(longer), F.lit(0)) + F.col("docs_after"),
            "tokens_over": F.coalesce(F.sum("t").over(longer), F.lit(0)) + F.col("tokens_after"),
        }
    )
    cut = F.col("tokens_over") - F.col("docs_over") * F.col("n_tokens")
    return out.select(
        "n_tokens", "n_docs", "docs_over", "tokens_over", (F.col("total_docs") - F.col("docs_over")).alias("docs_within"), (F.col("total_tokens") - cut).alias("kept_tokens"),
        cut.alias("cut_tokens"), ((F.col("total_docs") - F.col("docs_over")) / F.col("total_docs")).alias("quantile"), "total_docs", "total_tokens",
    )


def at_limits(answers: DataFrame, wanted: DataFrame, limit_col: str = "context_limit", group: int = GROUP) -> DataFrame:
    """For each limit in ``wanted``, however many: docs_over, kept_tokens and cut_tokens, from the rows of :func:`limits`.

    Documents over a limit are those of the later groups of lengths, by suffix sums over groups, and the longer ones of its own
    group. Null limits are left out, repeated ones answered once; without lengths all figures are 0."""
    asked = wanted.select(F.col(limit_col).cast("long").alias(limit_col)).filter(F.col(limit_col).isNotNull()).distinct().withColumn("g", F.floor(F.col(limit_col) / group))
    rows = answers.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("t"), F.floor(F.col("n_tokens") / group).alias("g"))
    sums = rows.groupBy("g").agg(F.sum("n_docs").alias("d"), F.sum("t").alias("t")).unionByName(asked.select("g", F.lit(0).alias("d"), F.lit(0).alias("t")).distinct())
    sums = sums.groupBy("g").agg(F.sum("d").alias("d"), F.sum("t").alias("t"))  # a row per group of lengths
    after = W.orderBy(F.desc("g")).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("g", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("docs_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("tokens_after"), F.sum("t").over(W.partitionBy(F.lit(1))).alias("total_tokens"))
    own = asked.join(rows, "g").filter(F.col("n_tokens") > F.col(limit_col)).groupBy(limit_col).agg(F.sum("n_docs").alias("d"), F.sum("t").alias("t"))
    met = asked.join(sums, "g").join(own, limit_col, "left")
    met = met.select(limit_col, (F.col("docs_after") + F.coalesce("d", F.lit(0))).alias("docs_over"), (F.col("tokens_after") + F.coalesce("t", F.lit(0))).alias("over"), "total_tokens")
    cut = F.col("over") - F.col("docs_over") * F.col(limit_col)
    return met.select(limit_col, "docs_over", (F.col("total_tokens") - cut).alias("kept_tokens"), cut.alias("cut_tokens"))


def quantiles(answers: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least this share of the documents does not exceed."""
    asked = [F.min(F.when(F.col("quantile") >= s, F.col("n_tokens"))).alias(f"q{k}") for k, s in enumerate(shares)]
    pairs = ", ".join(f"{s}D, q{k}" for k, s in enumerate(shares))
    return answers.agg(*asked).selectExpr(f"stack({len(shares)}, {pairs}) AS (share, n_tokens)")
