"""Registered queries of this subpackage, with their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ctw, divergence, entropy_mix, exact_dedup, golay_simhash, html_extract, language_id, mil_quality, pieces, substring_dedup, tiff, token_lengths
from .common import crc_mod


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").withColumn("n_bytes", F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))
    stored = tiff.media_column(docs, "text", ["doc_id", "n_bytes"]).withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    pages = tiff.pages(stored, "media", ["doc_id", "n_bytes", "media_bytes", "media_sha256"])
    return pages.select(
        "doc_id",
        "n_bytes",
        F.octet_length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -16, 16)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        "feature",
        "error",
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(_read(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return language_id.identify(docs, _read(spark, sf_dir, "pages"), docs)


def op4_ctw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(_read(spark, sf_dir, "documents"))


def op5_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = mil_quality.train(docs, _read(spark, sf_dir, "labels"))
    scored = mil_quality.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        (crc_mod("doc_id", 4) == 2).alias("held_out"),
        F.col("__score").alias("score"),
        (F.col("__score") >= mil_quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = pieces.round_trip(docs)
    same = F.col("__text") == F.translate("text", pieces.MARK, " ")
    return both.select("doc_id", F.size("__ids").cast("long").alias("n_ids"), F.col("__ids").alias("ids"), F.sha2("__text", 256).alias("decoded_sha256"), same.alias("round_trip"))


def op7_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_lengths.limits(token_lengths.histogram(token_lengths.lengths(_read(spark, sf_dir, "documents"))))


def op8_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = entropy_mix.mix(_read(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__source_size").cast("long").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__copies") * F.col("__size")).cast("long").alias("taken"),
        F.col("__copies").alias("copies"),
    )


def op9_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = golay_simhash.group(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", golay_simhash.hex_of("fp").alias("fingerprint"), "component_id")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_read(spark, sf_dir, "pages"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(_read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), "spans")


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.Alignment(_read(spark, sf_dir, "documents")).by_document()


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_tiff_media": op1_tiff_media,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_language_id": op3_language_id,
    "op4_ctw_score": op4_ctw_score,
    "op5_mil_quality": op5_mil_quality,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_token_lengths": op7_token_lengths,
    "op8_entropy_mix": op8_entropy_mix,
    "op9_golay_simhash": op9_golay_simhash,
    "op10_html_extract": op10_html_extract,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_source_divergence": op13_source_divergence,
}

ORACLES = {
    "op2_exact_dedup": r"""
        WITH d AS (
          SELECT doc_id, length(coalesce(text, '')) AS chars,
                 regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
          FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               first_value(doc_id) OVER w = doc_id AS kept,
               sha256(norm) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id)
    """,
    "op13_source_divergence": r"""
        WITH d AS (
          SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                 translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
          FROM documents),
        w AS (
          SELECT k, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        per AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT k) AS docs FROM w GROUP BY ALL),
        kept AS (SELECT lang, term, sum(n) AS n FROM per GROUP BY ALL HAVING sum(docs) >= 3),
        langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY ALL),
        own AS (SELECT lang, source, term, per.n FROM per JOIN kept USING (lang, term)),
        sums AS (SELECT lang, source, sum(n) AS total FROM own GROUP BY ALL),
        g AS (
          SELECT x.lang, x.source, coalesce(s.total, 0) AS total, coalesce(l.v, 0) AS v, l.total AS lang_total
          FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN sums s USING (lang, source) LEFT JOIN langs l USING (lang)),
        shares AS (
          SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS c,
                 1 + (1000000000::HUGEINT * (coalesce(o.n, 0) + 1)) // (g.total + g.v) AS p,
                 1 + (1000000000::HUGEINT * (k.n + 1)) // (g.lang_total + g.v) AS q
          FROM g JOIN kept k USING (lang) LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
        far AS (
          SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
          FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pairs AS (
          SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
        terms AS (
          SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM shares WHERE c > 0 AND p > q),
        ranked AS (
          SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r
          FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
        SELECT lang, source, part, item, value::BIGINT AS value, r::INTEGER AS rank FROM ranked WHERE part = 'pair' OR r <= 200
    """,
}
