"""Canonical transcripts: nested JSON files, one per recording, scanned into documents, segments, words and turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources import guarded

#: Largest file that is read (fixed value).
MAX_BYTES = 256 << 20
SCHEMA_VERSION = 1
MEDIA = "aac aiff avi flac m4a m4v mkv mov mp3 mp4 mpeg mpg ogg opus wav webm wma".split()
SCHEMA = """
schema_version int, job_id string, profile string, provisional boolean, text string, detected_language string, language_probability double,
source struct<sha256:string,size_bytes:bigint,modified_ns:bigint,container_format:string,duration_seconds:double>,
segments array<struct<segment_id:string,index:int,start_seconds:double,end_seconds:double,text:string,detected_language:string,language:string,speaker_ref:string,
  language_spans:array<struct<start_char:int,end_char:int,language:string,confidence:double>>,
  words:array<struct<start_seconds:double,end_seconds:double,text:string,probability:double,speaker_ref:string>>>>,
speaker_turns array<struct<start_seconds:double,end_seconds:double,speaker_ref:string>>
"""


def files(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """Files of one folder, not below it: path, size, modified_ns, content. Columns that are not asked for are not read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "false").load(path)
    return rows.select("path", F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("modified_ns"), "content")


def _problem(doc: Column, size: Column) -> Column:
    return (
        F.when(size > MAX_BYTES, "too large").when(doc.isNull() | doc["job_id"].isNull(), "malformed").when(doc["schema_version"] != SCHEMA_VERSION, "schema version")
        .when(doc["source"]["sha256"].isNull() | ~doc["source"]["sha256"].rlike("^[0-9a-f]{64}$"), "source digest")
    )


def scan(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path, size, modified_ns, canonical_sha256, doc (the parsed struct) and problem (null if sound). Each file is read under guard: one that
    changes meanwhile has the problem "changed while reading"."""
    rows = guarded.read(spark, path, ".json", keep=MAX_BYTES)
    rows = rows.select("path", "size", "modified_ns", F.col("sha256").alias("canonical_sha256"), F.from_json(F.col("content").cast("string"), SCHEMA, {"mode": "PERMISSIVE"}).alias("doc"), "problem")
    return rows.withColumn("problem", F.coalesce("problem", _problem(F.col("doc"), F.col("size"))))


def load(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Sound documents of a folder. Strict: any other file is an error; else it is left out. Two files of one id are always an error."""
    rows = scan(spark, path)
    if strict:
        bad = rows.filter("problem IS NOT NULL").select("path", "problem").first()
        if bad:
            raise ValueError(f"{bad['path']}: {bad['problem']}")
    good = rows.filter("problem IS NULL")
    twice = good.groupBy("doc.job_id").count().filter("count > 1").first()
    if twice:
        raise ValueError(f"two transcripts with the id {twice['job_id']}")
    return good


def documents(loaded: DataFrame) -> DataFrame:
    return loaded.select(
        F.col("doc.job_id").alias("document_id"), F.col("doc.source.sha256").alias("source_sha256"), "canonical_sha256", F.col("size").alias("canonical_size_bytes"),
        F.col("modified_ns").alias("canonical_modified_ns"), F.col("doc.detected_language").alias("detected_language"), F.col("path").alias("canonical_path"), "doc.source.duration_seconds",
    )


def segments(loaded: DataFrame) -> DataFrame:
    """Language of a segment: its own, else what was detected in it, else the document's."""
    rows = loaded.select(F.col("doc.job_id").alias("document_id"), "canonical_sha256", F.col("doc.detected_language").alias("_l"), F.explode("doc.segments").alias("s"))
    return rows.select(
        "document_id", F.col("s.index").alias("segment_index"), "s.segment_id", "s.text", F.coalesce("s.language", "s.detected_language", "_l").alias("language"),
        "s.speaker_ref", "s.start_seconds", "s.end_seconds", "canonical_sha256", "s.words", "s.language_spans",
    )


def words(segment_rows: DataFrame) -> DataFrame:
    rows = segment_rows.select("document_id", "segment_index", "segment_id", F.posexplode("words").alias("word_index", "w"))
    return rows.select("document_id", "segment_index", "segment_id", "word_index", F.col("w.text").alias("word"), "w.speaker_ref", "w.start_seconds", "w.end_seconds")


def turns(loaded: DataFrame) -> DataFrame:
    return loaded.select(F.col("doc.job_id").alias("document_id"), F.explode("doc.speaker_turns").alias("t")).select("document_id", "t.speaker_ref", "t.start_seconds", "t.end_seconds")


def verified(loaded: DataFrame, index: DataFrame) -> DataFrame:
    """Index rows (document_id, canonical_path, canonical_sha256, source_sha256) with intact: the file at that path still has this content and source."""
    now = loaded.select(F.col("path").alias("canonical_path"), F.col("canonical_sha256").alias("_c"), F.col("doc.job_id").alias("_d"), F.col("doc.source.sha256").alias("_s"))
    same = (F.col("canonical_sha256") == F.col("_c")) & (F.col("document_id") == F.col("_d")) & (F.col("source_sha256") == F.col("_s"))
    return index.join(now, "canonical_path", "left").withColumn("intact", F.coalesce(same, F.lit(False))).drop("_c", "_d", "_s")


def source_integrity(index: DataFrame, listing: DataFrame) -> DataFrame:
    """Index rows (document_id, source_path, source_sha256) with integrity: "matches", "changed", "missing" (no file at the path) or
    "unreadable" (a file that could not be read whole). ``listing``: path, sha256 (null if unreadable), and size and modified_ns
    before and after reading, where it was read."""
    found = listing.select(F.col("path").alias("source_path"), F.col("sha256").alias("_h"), F.lit(True).alias("_there"), *[F.col(c).alias(f"_{c}") for c in ("size_before", "size_after", "modified_before", "modified_after")])
    steady = F.col("_size_before").eqNullSafe(F.col("_size_after")) & F.col("_modified_before").eqNullSafe(F.col("_modified_after"))
    state = F.when(F.col("_there").isNull(), "missing").when(F.col("_h").isNull() | ~steady, "unreadable").when(F.col("_h") == F.col("source_sha256"), "matches").otherwise("changed")
    return index.join(found, "source_path", "left").withColumn("integrity", state).drop("_h", "_there", "_size_before", "_size_after", "_modified_before", "_modified_after")


def details(segment_rows: DataFrame, index: DataFrame) -> DataFrame:
    """A snapshot per document of the index (document_id, canonical_sha256, segment_count): segments, words, speakers and seconds as
    they are in the transcript, and sound: generation and number of segments are those of the index."""
    refs = F.array_distinct(F.filter(F.concat(F.array("speaker_ref"), F.coalesce(F.transform("words", lambda w: w["speaker_ref"]), F.array().cast("array<string>"))), lambda r: r.isNotNull()))
    now = segment_rows.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("segments"), F.sum(F.coalesce(F.size("words"), F.lit(0))).alias("n_words"), F.max("end_seconds").alias("seconds"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(refs)))).alias("speakers"), F.min("canonical_sha256").alias("_c"),
    )
    met = index.join(now, "document_id", "left")
    same = (F.col("segments") == F.col("segment_count")) & (F.col("_c") == F.col("canonical_sha256"))
    return met.select("document_id", "segments", "n_words", "speakers", "seconds", F.coalesce(same, F.lit(False)).alias("sound"))


#: Fields of a label file; any other is an error (fixed values).
LABEL_FIELDS = "document_id string, canonical_sha256 string, speaker_ref string, label string"


def label_states(spark: SparkSession, path: str) -> DataFrame:
    """Speaker labels from JSON lines. Unknown or missing fields, and two labels of one speaker in one generation, are errors."""
    raw = spark.read.text(path).filter(F.trim("value") != "")
    names = sorted(f.split()[0] for f in LABEL_FIELDS.split(", "))
    rows = raw.withColumns({"keys": F.array_sort(F.json_object_keys("value")), "doc": F.from_json("value", LABEL_FIELDS)})
    if bad := rows.filter(~F.col("keys").eqNullSafe(F.array(*[F.lit(n) for n in names]))).select("value").first():
        raise ValueError(f"not a label: {bad[0][:200]}")
    found = rows.select("doc.*")
    if twice := found.groupBy("document_id", "canonical_sha256", "speaker_ref").count().filter("count > 1").first():
        raise ValueError(f"two labels of {twice['speaker_ref']} in {twice['document_id']}")
    return found


def recordings(listing: DataFrame, limit: int = 10_000) -> DataFrame:
    """``listing`` (path, size, location_id, automatic) per media file: size, locations, automatic if any root is; hidden and empty files are left out."""
    name = F.element_at(F.split("path", "/"), -1)
    kept = listing.filter((F.col("size") > 0) & ~name.startswith(".") & F.lower(F.element_at(F.split(name, r"\."), -1)).isin(MEDIA))
    per = kept.groupBy("path").agg(F.first("size").alias("size"), F.array_sort(F.collect_set("location_id")).alias("locations"), F.bool_or("automatic").alias("automatic"))
    return per.orderBy("path").limit(limit)


def jobs(spark: SparkSession, path: str) -> DataFrame:
    """Job records, one JSON file each; malformed ones are left out; the latest first."""
    schema = "job_id string, input_path string, output_dir string, status string, started_at string, updated_at string, artifact_path string, _corrupt_record string"
    rows = spark.read.schema(schema).option("multiLine", "true").option("pathGlobFilter", "*.json").json(path)
    return rows.filter("job_id IS NOT NULL AND status IS NOT NULL").drop("_corrupt_record").orderBy(F.desc("updated_at"), "job_id")


def to_json(documents_rows: DataFrame) -> DataFrame:
    """(document_id, content): each row as compact JSON with its keys in order, ready for ``write.text``."""
    ordered = [F.col(c) for c in sorted(documents_rows.columns)]
    return documents_rows.select("document_id", F.to_json(F.struct(*ordered)).alias("content"))
