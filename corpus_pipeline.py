"""A corpus pipeline: each stage takes (spark, docs, sf_dir) and returns a DataFrame.

Every stage works on all rows that the one before kept, and its result is written to the shared folder and read again, so
a lost executor never costs more than one stage. All but the last return the columns of ``docs``, whatever else these are
called; ties are settled as each operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import entropy_mix, exact_dedup, golay_simhash, mil_quality, pieces
from quillon.llm.common import table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go.

    Null and empty texts are scored as one empty passage, repeated rows get one decision, and an empty table stays empty. Without
    labels, or with none outside the held-out part, nothing is rejected."""
    model = mil_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mil_quality.keep_accepted(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: one document of each class of equal texts stays, the longest original, then the smallest id.

    Null and empty texts are one class, null ids come last, of repeated rows one stays, and an empty table stays empty."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one document of each group stays, the one with the smallest id.

    Null and empty texts share fingerprint zero; null ids stay only where a group has no other; of repeated rows one stays; an
    empty table stays empty."""
    return golay_simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to target weights: a document is repeated as often as the mix takes it.

    A null source is a source of its own; documents without words come once; repeated rows count each by itself; an empty
    table stays empty."""
    return entropy_mix.repeated(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding and decoding: the ids of each text, and the hash of the text that they decode to.

    Null and empty texts have no ids; repeated rows get equal ids; an empty table stays empty."""
    return pieces.round_trip(docs, ids_as="piece_ids", text_as="decoded_sha256").withColumn("decoded_sha256", F.sha2("decoded_sha256", 256))


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = table(docs, name.replace(" ", "-"))
    return docs
