"""Language identification by Bayesian fusion of evidence.

Evidence of one row, each a likelihood over the languages L that occur in the training labels:

* its text: naive Bayes over hashed words and letter trigrams, counted over all labelled texts;
* the language its markup declares: P(declared | language);
* its address suffix (top-level domain): P(language | suffix) as the middle level of the prior;
* its host: P(language | host), smoothed towards its suffix, which is smoothed towards the whole corpus.

The tables P(declared | language) and the priors are grouped sums of the posteriors that text alone gives; a
row's own share is taken out of its host's sums, so that it does not confirm itself.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table
from .html_extract import main_text

#: Hash buckets of the text model: with L languages the model is 4 * L * BUCKETS bytes, which bounds what is sent to tasks.
BITS = 16
BUCKETS = 1 << BITS
#: Text evidence counts as at most this many independent features, since the words of one text are not independent.
EVIDENCE = 60.0
#: Pseudo-counts: of the corpus prior in a suffix, of the suffix prior in a host, of each declared value.
SUFFIX_WEIGHT, HOST_WEIGHT, DECLARED_WEIGHT = 20.0, 5.0, 1.0
#: Parts that a host's rows are dealt to, whatever they hold.
SALTS = 64
#: Languages that a text model may have: 256 KB each in what is sent to tasks.
MAX_LANGUAGES = 400
#: Characters whose features are made at once.
PIECE = 1 << 20
#: Code points from here on are no letters.
_POINTS = 0x33480
#: Odd multipliers of the hashes.
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter, or a mark inside words of some scripts."""
    return np.fromiter(((c := chr(k)).isalpha() or unicodedata.category(c)[0] == "M" for k in range(_POINTS)), dtype=bool, count=_POINTS)


#: Signs that end a word in any script; a long text is cut after one of them only.
_BREAK = re.compile(r"[\s.,;:!?/+=|\"()\[\]{}<>。，、！？；：]")


def _pieces(text: str):
    """Stretches of about ``PIECE`` characters; none is cut inside a word, so features do not depend on a text's length."""
    start = 0
    while len(text) - start > PIECE:
        found = _BREAK.search(text, start + PIECE)
        if found is None:
            break
        yield text[start : found.end()]
        start = found.end()
    yield text[start:]


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, number of its text) for every letter, with its neighbours, and every word of the texts in lower case."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer(" ".join(["", *lowered, ""]).encode("utf-32-le", "replace"), dtype=np.uint32)
    row_of = np.repeat(np.arange(len(texts), dtype=np.int32), np.fromiter(map(len, lowered), dtype=np.int64, count=len(texts)) + 1)
    inside = _letters()[np.minimum(points, _POINTS - 1)]
    value = np.where(inside, points, 32).astype(np.uint64)
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
    three = (value[at - 1] * _A ^ value[at] * _B ^ value[at + 1] * _C) * _D
    first = np.flatnonzero(~inside[at - 1])
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    whole = np.add.reduceat(value[at] * np.random.PCG64(5).random_raw(int(place.max()) + 1)[place], first) * _D
    buckets = np.concatenate((three, whole)) >> np.uint64(64 - BITS)
    rows = row_of[at - 1]
    return buckets.astype(np.int64), np.concatenate((rows, rows[first]))


def _grouped(texts: list[str | None]):
    """Lists of (number, piece) of about ``PIECE`` characters."""
    held, size = [], 0
    for k, text in enumerate(texts):
        for piece in _pieces(text or ""):
            if held and size + len(piece) > PIECE:
                yield held
                held, size = [], 0
            held.append((k, piece))
            size += len(piece)
    if held:
        yield held


def _count_batches(batches):
    """(lang, bucket, n) per task, each pair once."""
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        by_lang: dict[str, list] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            total = held.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
            for group in _grouped(texts):
                total += np.bincount(features([t for _, t in group])[0], minlength=BUCKETS)
    for lang, total in held.items():
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])], names=["lang", "bucket", "n"])


def text_model(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages in order, and log P(feature | language) as BUCKETS x L, from all rows with a label; at most ``MAX_LANGUAGES`` labels.

    Null labels are left out; repeated rows count as often as they occur; an empty table gives the language "und"."""
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang IS NOT NULL")
    many = rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if many > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels: map them to languages first")
    counts = rows.mapInArrow(_count_batches, "lang string, bucket int, n long").groupBy("bucket", "lang").agg(F.sum("n").alias("n"))
    found = counts.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("cells")).orderBy("lang").toArrow()
    langs = found.column("lang").to_pylist()
    model = np.full((BUCKETS, max(1, len(langs))), 0.5, dtype=np.float64)
    for k in range(len(langs)):
        cells = found.column("cells")[k].values
        model[cells.field("bucket").to_numpy(), k] += cells.field("n").to_numpy()
    return langs or ["und"], (np.log(model) - np.log(model.sum(0))).astype(np.float32)


def _scorer(model, is_html: bool):
    def run(batches):
        weights = model.value.astype(np.float64)
        size = weights.shape[1]
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = part.column(part.num_columns - 1).to_pylist()
                if is_html:
                    texts = [main_text(t) or re.sub(r"<[^>]*>", " ", t or "") for t in texts]
                sums, counts = np.zeros((len(texts), size)), np.zeros(len(texts))
                for group in _grouped(texts):
                    bucket, row = features([t for _, t in group])
                    own = np.array([k for k, _ in group])
                    np.add.at(counts, own, np.bincount(row, minlength=len(group)))
                    for j in range(size):
                        np.add.at(sums[:, j], own, np.bincount(row, weights=weights[bucket, j], minlength=len(group)))
                out = sums * np.minimum(1.0, EVIDENCE / np.maximum(counts, 1.0))[:, None]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(list(out), pa.list_(pa.float64()))], names=[*part.schema.names[:-1], "loglik"])

    return run


def text_evidence(rows: DataFrame, model: np.ndarray, text_col: str, is_html: bool) -> DataFrame:
    """All other columns of ``rows`` and loglik, one number per language (all 0 without words)."""
    rest = [c for c in rows.columns if c != text_col]
    sent = rows.sparkSession.sparkContext.broadcast(model)
    ordered = rows.select(*rest, text_col)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields[:-1])
    return ordered.mapInArrow(_scorer(sent, is_html), f"{kept}, loglik array<double>")


def declared_language(page: Column) -> Column:
    """The primary language that the page's <html lang> or content-language declares; null if none."""
    tag = F.regexp_extract(page, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})\b", 1)
    meta = F.regexp_extract(page, r"(?i)<meta\b[^>]*?content-language[^>]*?content\s*=\s*[\"']?([a-zA-Z]{2,3})\b", 1)
    return F.lower(F.coalesce(F.nullif(tag, F.lit("")), F.nullif(meta, F.lit(""))))


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def suffix_of(host: Column) -> Column:
    return F.nullif(F.regexp_extract(host, r"\.([^.]+)$", 1), F.lit(""))


def _softmax(values: Column) -> Column:
    powers = F.transform(values, lambda x: F.exp(x - F.array_max(values)))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def _sums(by: list[str], rows: DataFrame, size: int) -> DataFrame:
    """Element-wise sums of ``soft``."""
    cells = [F.sum(F.col("soft")[k]).alias(f"s{k}") for k in range(size)]
    return rows.groupBy(*by).agg(*cells).select(*by, F.array(*[f"s{k}" for k in range(size)]).alias("sums"))


def fuse(evidence: DataFrame, langs: list[str]) -> DataFrame:
    """``evidence``: loglik, declared, suffix, host (each of the last three may be null), other columns at will.

    Adds text_lang (null without words), lang, confidence and posterior. Ties go to the first language by name.
    Rows without any evidence get the corpus prior. ``declared`` has at most three letters (see
    :func:`declared_language`), so its table has at most 26^2 + 26^3 rows and is sent to all tasks."""
    size = len(langs)
    one_row = lambda df: [x or 0.0 for x in df.first()["sums"]]  # noqa: E731  one number per language

    def literal(values: list[float], normalise: bool = False) -> Column:
        whole = sum(values) if normalise else 1.0
        return F.array(*[F.lit(x / whole) for x in values])

    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    worded = F.exists("loglik", lambda x: x != 0)
    rows = evidence.withColumn("worded", worded).withColumn("soft", F.when(F.col("worded"), _softmax(F.col("loglik"))))
    rows = rows.withColumns({"host_key": F.coalesce("host", F.lit("")), "suffix_key": F.coalesce("suffix", F.lit("")), "declared_key": F.coalesce("declared", F.lit("")), "salt": F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")})
    rows = table(rows, "language-evidence")  # which also keeps each row's salt
    hosts = table(_sums(["suffix_key", "host_key", "salt"], rows.filter("worded"), size), "language-hosts").withColumnRenamed("sums", "soft")
    by_host = _sums(["suffix_key", "host_key"], hosts, size).withColumnRenamed("sums", "host_sums")
    by_suffix = _sums(["suffix_key"], hosts, size).withColumnRenamed("sums", "suffix_sums")
    root = literal([x + 1.0 for x in one_row(_sums([], hosts, size))], normalise=True)
    smooth = lambda sums, parent, weight: F.zip_with(sums, parent, lambda s, p: (s + weight * p) / (total(sums) + weight))
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("host_salt")
    suffixes = by_suffix.select("suffix_key", smooth(F.col("suffix_sums"), root, SUFFIX_WEIGHT).alias("suffix_prior"), every_salt)
    salts = rows.select("suffix_key", "host_key", "salt").distinct().withColumn("host_salt", F.pmod(F.hash("host_key", "salt"), F.lit(SALTS)))
    priors = (
        salts.join(by_host, ["suffix_key", "host_key"], "left").join(suffixes, ["suffix_key", "host_salt"], "left")
        .select("suffix_key", "host_key", "salt", "host_sums", F.coalesce("suffix_prior", root).alias("parent"))
    )
    said = rows.filter("worded AND declared IS NOT NULL")
    declared = table(_sums(["declared_key"], said, size).withColumnRenamed("sums", "declared_sums"), "language-declared")
    spoken = literal(one_row(declared.groupBy().agg(*[F.sum(F.col("declared_sums")[k]).alias(f"s{k}") for k in range(size)]).select(F.array(*[f"s{k}" for k in range(size)]).alias("sums"))))
    values = declared.count() + 1
    chances = declared.select("declared_key", F.zip_with("declared_sums", spoken, lambda d, s: F.log((d + DECLARED_WEIGHT) / (s + DECLARED_WEIGHT * values))).alias("declared_log"))
    none = F.array(*[F.lit(0.0)] * size)
    joined = rows.join(priors, ["suffix_key", "host_key", "salt"]).join(F.broadcast(chances), "declared_key", "left")
    own = F.coalesce("soft", none)
    others = F.zip_with(F.coalesce("host_sums", none), own, lambda s, o: F.greatest(F.lit(0.0), s - o))
    joined = joined.withColumn("others", F.when(F.col("host_key") == "", none).otherwise(others))
    prior = smooth(F.col("others"), F.col("parent"), HOST_WEIGHT)
    joined = joined.withColumn("evidence", F.zip_with(F.zip_with("loglik", F.coalesce("declared_log", none), lambda a, b: a + b), prior, lambda a, p: a + F.log(p)))
    names = F.array(*[F.lit(x) for x in langs])
    best = lambda x: F.element_at(names, F.array_position(x, F.array_max(x)).cast("int"))
    return (
        joined.withColumn("posterior", _softmax(F.col("evidence")))
        .withColumns({"text_lang": F.when(F.col("worded"), best(F.col("loglik"))), "lang": best(F.col("posterior")), "confidence": F.array_max("posterior")})
        .select(*[c for c in evidence.columns if c != "loglik"], "text_lang", "lang", "confidence", "posterior")
    )


def identify(labelled: DataFrame, pages: DataFrame | None = None, documents: DataFrame | None = None) -> DataFrame:
    """Languages of ``pages`` (page_id, url, html) and ``documents`` (doc_id, text, source), one row per input row.

    ``labelled`` (text, lang) trains the text model; its labels are used for nothing else. A document has no markup and
    no address; its source stands for the host. Null texts, pages and addresses are missing evidence. Repeated rows
    are kept, ties go to the first language by name, empty tables give no rows. Other columns are ignored. Returns kind, page_id, doc_id, host, suffix, declared, text_lang, lang,
    confidence."""
    langs, model = text_model(labelled)
    parts = []
    if pages is not None:
        host = host_of(F.col("url"))
        rows = pages.select(
            F.lit("page").alias("kind"), F.col("page_id").cast("long").alias("page_id"), F.lit(None).cast("long").alias("doc_id"),
            host.alias("host"), suffix_of(host).alias("suffix"), declared_language(F.col("html")).alias("declared"), F.col("html").alias("text"),
        )
        parts.append(text_evidence(rows, model, "text", True))
    if documents is not None:
        rows = documents.select(
            F.lit("document").alias("kind"), F.lit(None).cast("long").alias("page_id"), F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("host"), F.lit(None).cast("string").alias("suffix"), F.lit(None).cast("string").alias("declared"), F.col("text"),
        )
        parts.append(text_evidence(rows, model, "text", False))
    evidence = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return fuse(evidence, langs).drop("posterior")
