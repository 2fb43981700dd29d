"""Retrieval chunks and exact vector search."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_
from pyspark.sql import Window as W

from quillon.functions import text as T
from quillon.functions import vectors as V
from quillon.operators.lexical import SCOPE_KEYS, SearchQuery

#: Words at which a chunk is closed, and that it never passes unless one segment alone does.
TARGET_WORDS, MAX_WORDS = 220, 300
CHUNKING_PROFILE = "chunks-v1"


def _chunk_starts(sizes: Column, target: int, most: int) -> Column:
    """Places (from 1) where chunks begin in an array of word counts, by a fold that carries (places, words and parts of the open
    chunk, place). The places grow at a chunk's begin only, so the fold costs what it reads."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("words"), F.lit(0).alias("parts"), F.lit(1).alias("at"))

    def step(acc: Column, size: Column) -> Column:
        begin = (acc["parts"] == 0) | (acc["words"] >= target) | (acc["words"] + size > most)
        words = F.when(begin, size).otherwise(acc["words"] + size)
        full = words >= most
        return F.struct(
            F.when(begin, F.concat(acc["out"], F.array(acc["at"]))).otherwise(acc["out"]).alias("out"), F.when(full, 0).otherwise(words).alias("words"),
            F.when(full, 0).when(begin, 1).otherwise(acc["parts"] + 1).alias("parts"), (acc["at"] + 1).alias("at"),
        )

    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def _packed(segments: DataFrame, columns: list[str], target: int, most: int) -> DataFrame:
    """(document_id, chunk_no, p): the segments of each chunk in order, as structs of segment_index, words (w) and ``columns``.

    A document's segments meet in one array; a document is bounded by its source file."""
    item = F.struct("segment_index", T.word_count(F.col("text")).cast("int").alias("w"), *columns)
    whole = segments.groupBy("document_id").agg(F.array_sort(F.collect_list(item)).alias("s"))
    whole = whole.withColumn("b", _chunk_starts(F.transform("s", lambda x: x["w"]), target, most))
    ends = F.concat(F.slice("b", F.lit(2), F.size("b")), F.array(F.size("s") + 1))
    parts = F.zip_with("b", ends, lambda b, e: F.slice("s", b, e - b))
    return whole.select("document_id", F.posexplode(parts).alias("chunk_no", "p"))


def chunk_assignment(segments: DataFrame, target: int = TARGET_WORDS, most: int = MAX_WORDS) -> DataFrame:
    """(document_id, segment_index, words, chunk_no): segments are packed greedily in order and never split."""
    rows = _packed(segments, [], target, most).select("document_id", "chunk_no", F.explode("p").alias("x"))
    return rows.select("document_id", "x.segment_index", F.col("x.w").cast("long").alias("words"), "chunk_no")


def chunks(segments: DataFrame, target: int = TARGET_WORDS, most: int = MAX_WORDS, profile: str = CHUNKING_PROFILE) -> DataFrame:
    """chunk_id, document_id, chunk_no, segment_ids, first/last_segment_id, start/end_seconds, text, content_sha256, languages, speaker_refs."""
    whole = _packed(segments, ["segment_id", "start_seconds", "end_seconds", "text", "language", "speaker_ref"], target, most)
    distinct = lambda c: F.array_sort(F.array_distinct(F.array_compact(F.transform("p", lambda x: x[c]))))
    rows = whole.select(
        "document_id", "chunk_no", F.transform("p", lambda x: x["segment_id"]).alias("segment_ids"), F.element_at("p", 1)["segment_id"].alias("first_segment_id"),
        F.element_at("p", -1)["segment_id"].alias("last_segment_id"), F.element_at("p", 1)["start_seconds"].alias("start_seconds"), F.element_at("p", -1)["end_seconds"].alias("end_seconds"),
        F.array_join(F.transform("p", lambda x: T.strip(x["text"])), " ").alias("text"), distinct("language").alias("languages"), distinct("speaker_ref").alias("speaker_refs"),
    ).withColumn("content_sha256", F.sha2("text", 256))
    material = F.concat_ws("\u0000", F.lit(profile), F.col("document_id").cast("string"), "first_segment_id", "last_segment_id", "content_sha256")
    return rows.withColumn("chunk_id", F.concat(F.lit("chunk-"), F.sha2(material, 256)))


def bridge(chunked: DataFrame) -> DataFrame:
    """(chunk_id, document_id, segment_id), a row per segment of each chunk."""
    return chunked.select("chunk_id", "document_id", F.explode("segment_ids").alias("segment_id"))


def placed_bridge(chunked: DataFrame, *columns: str) -> DataFrame:
    """The same with the segment's place in its chunk and other columns of the chunk."""
    return chunked.select("chunk_id", "document_id", F.posexplode("segment_ids").alias("place", "segment_id"), *columns)


def missing_bridge(chunked: DataFrame, known: DataFrame) -> DataFrame:
    """Bridge rows of the chunks that ``known`` has none of."""
    return bridge(chunked.join(known.select("chunk_id").distinct(), "chunk_id", "left_anti"))


def segment_to_chunk(requested: DataFrame, links: DataFrame) -> DataFrame:
    """``requested`` (document_id, segment_id) with chunk_id and what else the links have; of several chunks the greatest id; without one, dropped."""
    rest = [c for c in links.columns if c not in ("document_id", "segment_id", "chunk_id")]
    met = requested.join(links, ["document_id", "segment_id"]).groupBy(*requested.columns).agg(F.max(F.struct("chunk_id", *rest)).alias("_c"))
    return met.select(*requested.columns, *[F.col(f"_c.{c}").alias(c) for c in ("chunk_id", *rest)])


def matches(rows: DataFrame, query: SearchQuery | None, scope: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """Chunks that pass a query's filters: documents, common languages and speakers, the phrase, and all terms if asked.
    ``scope`` (with ``links``): at least one of a chunk's segments must be in it. All before any score."""
    if query is not None:
        if query.document_ids:
            rows = rows.filter(F.col("document_id").isin(list(query.document_ids)))
        for name, values in (("languages", query.languages), ("speaker_refs", query.speaker_refs)):
            if values:
                rows = rows.filter(F.arrays_overlap(name, F.array(*[F.lit(v) for v in values])))
        if query.phrase is not None:
            rows = rows.filter(F.contains(T.fold(F.col("text")), F.lit(query.phrase.strip().casefold())))
        if query.all_terms:
            rows = rows.filter(F.size(F.array_except(F.array(*[F.lit(t) for t in query.terms]), T.tokens(F.col("text")))) == 0)
    if scope is not None:
        keys = [k for k in SCOPE_KEYS if k in links.columns]
        rows = rows.join(links.join(scope.select(*keys), keys, "left_semi").select("chunk_id"), "chunk_id", "left_semi")
    return rows


def vector_topk(rows: DataFrame, query_vector: list[float], limit: int, vector_col: str = "vector", ties: tuple[str, ...] = ("document_id", "start_seconds", "chunk_id")) -> DataFrame:
    """The ``limit`` rows of the largest dot product with the query, by a scan of all that are left after filters."""
    scores = rows.withColumn("score", V.dot(F.col(vector_col), V.literal(query_vector)))
    return scores.orderBy(F.desc("score"), *ties).limit(limit)


#: Vectors of one block, its bytes, and bytes of query blocks that may be broadcast (beyond, Spark meets blocks by partitions).
BLOCK, BLOCK_BYTES, BROADCAST_BYTES = 1024, 1 << 20, 64 << 20
#: Partial answers that a task holds before it passes them on.
HELD = 1 << 20


def _blocks(rows: DataFrame, id_col: str, vector_col: str, names: tuple[str, str, str]) -> DataFrame:
    """Vectors in blocks of one width, of at most ``BLOCK`` and ``BLOCK_BYTES``: (width, ids, matrix). Rows whose id, vector or a number of it is null or not finite are left out."""
    ids, width, matrix = names
    schema = T_.StructType([T_.StructField(width, T_.IntegerType()), T_.StructField(ids, T_.ArrayType(rows.schema[id_col].dataType)), T_.StructField(matrix, T_.BinaryType())])

    def pack(batches):
        for batch in batches:
            found = batch.column(1).filter(pc.is_valid(batch.column(1)))
            lengths = pc.list_value_length(found).to_numpy(zero_copy_only=False)
            numbers = found.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
            keys, ends = batch.column(0).filter(pc.is_valid(batch.column(1))), np.cumsum(lengths)
            for size in np.unique(lengths):
                place = np.flatnonzero(lengths == size)
                block = numbers[(ends[place] - size)[:, None] + np.arange(size)]
                place, block = place[sound := np.isfinite(block).all(axis=1)], block[sound]
                step = max(1, min(BLOCK, BLOCK_BYTES // (8 * max(1, int(size)))))
                for k in range(0, len(place), step):
                    own = keys.take(pa.array(place[k : k + step]))
                    lists = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
                    yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), lists, pa.array([block[k : k + step].tobytes()], pa.binary())], names=[width, ids, matrix])

    return rows.select(id_col, vector_col).filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).mapInArrow(pack, schema)


def _best(table: pa.Table, limit: int) -> pa.Table:
    """The first ``limit`` of each query by falling score, then id."""
    table = table.take(pc.sort_indices(table, [("query_id", "ascending"), ("score", "descending"), ("chunk_id", "ascending")]))
    codes = table["query_id"].combine_chunks().dictionary_encode().indices.to_numpy()
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, int)
    rank = np.arange(len(codes)) - np.repeat(first, np.diff(np.r_[first, len(codes)]))
    return table.filter(pa.array(rank < limit))


def vector_topk_many(rows: DataFrame, asked: DataFrame, limit: int, places: int = 12) -> DataFrame:
    """(query_id, chunk_id, score): for each of many query vectors (query_id, query_vector) the ``limit`` best of all rows
    (chunk_id, vector) by dot product, rounded to ``places``; ties to the smaller id. ``query_id`` names one vector.

    Both sides are packed into blocks, and each block of rows meets each block of queries as a product of two matrices: one pass over the
    rows, no exchange of them, nothing on the driver. A task keeps its best per query, at most ``HELD`` rows at a time, and the tasks' answers
    are ranked by query. Vectors of other lengths have no product; a null vector, or one with null or not finite numbers, is never found
    and finds nothing."""
    if limit < 1:
        raise ValueError("limit must be 1 or more")
    own, other = _blocks(rows, "chunk_id", "vector", ("_ids", "_width", "_matrix")), _blocks(asked, "query_id", "query_vector", ("_query_ids", "_query_width", "_query_matrix"))
    size = asked.agg(F.coalesce(F.sum(F.size("query_vector").cast("long") * 8 + 32), F.lit(0))).first()[0]  # one number
    met = own.crossJoin(F.broadcast(other) if size <= BROADCAST_BYTES else other).filter("_width = _query_width")
    schema = T_.StructType([T_.StructField("query_id", asked.schema["query_id"].dataType), T_.StructField("chunk_id", rows.schema["chunk_id"].dataType), T_.StructField("score", T_.DoubleType())])

    def multiply(batches):
        held, count = [], 0
        for batch in batches:
            for r in range(batch.num_rows):
                ids, asked_ids = batch.column("_ids")[r].values, batch.column("_query_ids")[r].values
                if not batch.column("_width")[r].as_py():
                    continue
                a, b = (np.frombuffer(batch.column(c)[r].as_buffer()).reshape(n, -1) for c, n in (("_query_matrix", len(asked_ids)), ("_matrix", len(ids))))
                scores = np.round(a @ b.T, places) + 0.0  # no negative zero
                if scores.shape[1] > limit:  # all that reach the limit's score of their query, ties included
                    least = np.partition(scores, -limit, axis=1)[:, -limit]
                    q, c = np.nonzero(scores >= least[:, None])
                else:
                    q, c = (x.ravel() for x in np.indices(scores.shape))
                found = pa.table({"query_id": asked_ids.take(pa.array(q)), "chunk_id": ids.take(pa.array(c)), "score": pa.array(scores[q, c])})
                held.append(_best(found, limit))
                count += held[-1].num_rows
                if count >= HELD:
                    held = [_best(pa.concat_tables(held), limit)]
                    if (count := held[0].num_rows) >= HELD // 2:
                        yield from held[0].to_batches()
                        held, count = [], 0
        if held:
            yield from _best(pa.concat_tables(held), limit).to_batches()

    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    wanted = ["_ids", "_width", "_matrix", "_query_ids", "_query_matrix"]
    return met.select(*wanted).mapInArrow(multiply, schema).withColumn("_n", place).filter(F.col("_n") <= limit).drop("_n")


def ranked(hits: DataFrame, ties: tuple[str, ...] = ("document_id", "start_seconds", "chunk_id")) -> DataFrame:
    """Hits (at most ``limit`` rows) with semantic_rank."""
    return hits.withColumn("semantic_rank", F.row_number().over(W.orderBy(F.desc("score"), *ties)))


#: Bytes of lines that travel as one row to the task that digests them in order.
LINES_BYTES = 8192


def _line_blocks(batches):
    """Sorted lines joined to blocks, each with its first line's id and its number within the range."""
    held, size, first, number = [], 0, None, 0

    def block():
        return pa.RecordBatch.from_arrays([pa.array([first], pa.string()), pa.array([number], pa.int64()), pa.array(["".join(held)], pa.string())], names=["d", "n", "l"])

    for batch in batches:
        for d, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            first = d if not held else first
            held.append(line)
            size += len(line)
            if size >= LINES_BYTES:
                yield block()
                held, size, number = [], 0, number + 1
    if held:
        yield block()


def _digest_blocks(batches):
    digest = hashlib.sha256()
    for batch in batches:
        for text in batch.column(2).to_pylist():
            digest.update(text.encode("utf-8"))
    yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()], pa.string())], names=["fingerprint"])


def fingerprint(documents: DataFrame) -> DataFrame:
    """One row: digest of all (document_id, canonical_sha256) in order, for a library of any size.

    Lines are sorted and joined in ranges; as a digest of one text is made in order, one task then reads the blocks as a
    stream, in a sort that spills, and holds none of them."""
    line = F.concat(F.col("document_id").cast("string"), F.lit("\u0000"), F.col("canonical_sha256"), F.lit("\u0000"))
    lines = documents.select(F.col("document_id").cast("string").alias("d"), line.alias("l")).filter("l IS NOT NULL")
    blocks = lines.repartitionByRange("d", "l").sortWithinPartitions("d", "l").mapInArrow(_line_blocks, "d string, n long, l string")
    whole = blocks.repartition(1).sortWithinPartitions("d", "n").mapInArrow(_digest_blocks, "fingerprint string")
    count = documents.agg(F.count(F.lit(1)).alias("documents"))
    return count.join(whole, F.lit(True), "left").select(F.coalesce("fingerprint", F.sha2(F.lit(""), 256)).alias("fingerprint"), "documents")


def fingerprint_tree(documents: DataFrame) -> DataFrame:
    """The same purpose for any size: documents are digested in 65,536 groups by the hash of their id, then the groups."""
    line = F.concat(F.col("document_id").cast("string"), F.lit("\u0000"), F.col("canonical_sha256"), F.lit("\u0000"))
    rows = documents.select(F.substring(F.sha2(F.col("document_id").cast("string"), 256), 1, 4).alias("g"), line.alias("l"))
    groups = rows.groupBy("g").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("l")), ""), 256).alias("h"), F.count(F.lit(1)).alias("n"))
    whole = groups.agg(F.array_sort(F.collect_list(F.concat("g", "h"))).alias("s"), F.coalesce(F.sum("n"), F.lit(0)).alias("documents"))
    return whole.select(F.sha2(F.array_join("s", ""), 256).alias("fingerprint"), "documents")
