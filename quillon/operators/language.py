"""Language attribution: text units with offsets, and document spans projected onto segments."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.functions import text as T
from quillon.operators.intervals import overlap_join

#: A unit ends with one of these marks (fixed value).
UNIT = r"[^.!?;:,\n]*[.!?;:,\n]|[^.!?;:,\n]+"


def text_units(rows: DataFrame, key: str = "document_id", text_col: str = "text") -> DataFrame:
    """(key, start_char, end_char, unit): trimmed units of each text in its own offsets; blank ones are left out."""
    parts = rows.select(key, F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(UNIT), F.lit(0))).alias("k", "raw"))
    before = W.partitionBy(key).orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    # Lengths are taken before the window, so that texts pass it only where they are asked for.
    parts = parts.withColumn("unit", T.strip(F.col("raw"))).withColumns({"n": F.length("raw"), "lead": F.length("raw") - F.length(T.lstrip(F.col("raw"))), "size": F.length("unit")}).drop("raw")
    start = F.coalesce(F.sum("n").over(before), F.lit(0)) + F.col("lead")
    rows = parts.withColumn("start_char", start).filter("size > 0")
    return rows.select(key, "start_char", (F.col("start_char") + F.col("size")).alias("end_char"), "unit")


class Attributor(Protocol):
    """A language model for short units of text."""

    def attribute(self, units: list[str]) -> list[tuple[str, float] | None]:
        """For each unit its language and a confidence from 0 to 1, or None where the unit tells too little."""


class CommonWords:
    """Attribution by words that each language uses often: the language with most of them, None if there is none or several have as many. The confidence is
    its part of all such words of the unit. Words are runs of the letters a to z in either case."""

    def __init__(self, words: dict[str, tuple[str, ...]]) -> None:
        self.of: dict[str, list[str]] = {}
        for name, own in words.items():
            for w in own:
                self.of.setdefault(w, []).append(name)

    def attribute(self, units: list[str]) -> list[tuple[str, float] | None]:
        out: list[tuple[str, float] | None] = []
        for unit in units:
            counts: dict[str, int] = {}
            for w in re.findall("[A-Za-z]+", unit):
                for name in self.of.get(w.lower(), ()):
                    counts[name] = counts.get(name, 0) + 1
            most = max(counts.values(), default=0)
            best = [name for name, n in counts.items() if n == most]
            out.append((best[0], most / sum(counts.values())) if len(best) == 1 else None)
        return out


@functools.cache
def loaded(model: Callable[..., Attributor], *arguments) -> Attributor:
    """The model of a worker process, made when it is first asked for."""
    return model(*arguments)


def attributed(units: DataFrame, model: Callable[..., Attributor], *arguments, key: str = "document_id") -> DataFrame:
    """(key, start_char, end_char, language, confidence): the spans of ``units`` (as :func:`text_units` makes them) whose language the model tells.

    A table function over Arrow batches calls ``model(*arguments)``, an importable class or function with hashable arguments, once in each worker process. The rows
    stay where they are. Codes are lower-cased; a blank one, or a confidence that is not a number from 0 to 1, is an error."""
    kind = units.schema[key].dataType.simpleString()

    @F.arrow_udtf(returnType=f"{key} {kind}, start_char long, end_char long, language string, confidence double")
    class Spans:
        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            told = loaded(model, *arguments).attribute(batch.column("unit").to_pylist())
            if len(told) != batch.num_rows:
                raise ValueError(f"the model told {len(told)} languages of {batch.num_rows} units")
            place = [i for i, t in enumerate(told) if t is not None]
            names, chances = [told[i][0].strip().lower() for i in place], [float(told[i][1]) for i in place]
            if not all(names) or not all(math.isfinite(c) and 0 <= c <= 1 for c in chances):
                raise ValueError("a language without a code, or a confidence outside of 0 to 1")
            kept = [batch.column(c).take(pa.array(place, pa.int64())) for c in (key, "start_char", "end_char")]
            yield pa.table([kept[0], kept[1].cast(pa.int64()), kept[2].cast(pa.int64()), pa.array(names, pa.string()), pa.array(chances, pa.float64())], [key, "start_char", "end_char", "language", "confidence"])

    return Spans(units.select(key, "start_char", "end_char", "unit").asTable())


def bounds(segments: DataFrame) -> DataFrame:
    """``segments`` with doc_start and doc_end: their place in the document, segments joined by one line end."""
    before = W.partitionBy("document_id").orderBy("segment_index").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))
    return segments.withColumn("doc_start", start).withColumn("doc_end", F.col("doc_start") + F.length("text"))


def project_spans(segments: DataFrame, spans: DataFrame, width: int = 2000) -> DataFrame:
    """``spans`` (document_id, start_char, end_char, language, confidence) in the offsets of each segment, trimmed: document_id,
    segment_id, start_char, end_char, language, confidence."""
    own = bounds(segments).select("document_id", "segment_id", "text", "doc_start", "doc_end")
    other = spans.select("document_id", F.col("start_char").alias("span_start"), F.col("end_char").alias("span_end"), "language", "confidence")
    lengths = segments.select(F.lit(0).alias("doc_start"), F.length("text").alias("doc_end"))  # known without the running sums
    met = overlap_join(own, other, ["document_id"], ("doc_start", "doc_end"), ("span_start", "span_end"), width, lengths)
    start, end = F.greatest("doc_start", "span_start") - F.col("doc_start"), F.least("doc_end", "span_end") - F.col("doc_start")
    met = met.withColumn("a", start).withColumn("part", F.substring("text", (start + 1).cast("int"), (end - start).cast("int")))
    lead = F.length("part") - F.length(T.lstrip(F.col("part")))
    clean = T.strip(F.col("part"))
    return met.filter(clean != "").select("document_id", "segment_id", (F.col("a") + lead).alias("start_char"), (F.col("a") + lead + F.length(clean)).alias("end_char"), "language", "confidence")


def segment_languages(projected: DataFrame) -> DataFrame:
    """Per segment: its language if all its spans have the same one."""
    per = projected.groupBy("document_id", "segment_id").agg(F.collect_set("language").alias("s"))
    return per.select("document_id", "segment_id", F.when(F.size("s") == 1, F.col("s")[0]).alias("language"))


def detected_languages(projected: DataFrame, order: list[str]) -> DataFrame:
    """Per document: languages in order of first appearance, and the one language if there is no other."""
    first = projected.groupBy("document_id", "language").agg(F.min(F.struct(*order)).alias("f"))
    per = first.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "language"))), lambda x: x["language"]).alias("detected_languages"))
    return per.withColumn("detected_language", F.when(F.size("detected_languages") == 1, F.col("detected_languages")[0]))
