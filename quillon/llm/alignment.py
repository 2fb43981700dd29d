"""Alignment of two tokenizers' tokens, in relational steps.

Both tokenizers end a token before a single space that stands between two other characters, whatever lies around it. So a text is a row
of *stretches* between such places, and a stretch has the same tokens wherever it stands. Each distinct stretch is encoded and aligned once:

1. ``posexplode`` of its tokens of either side, a windowed running sum of their byte lengths gives each token's end;
2. a full equi-join on (stretch, end): an end that both sides have is a cut;
3. the running count of cuts before a token is its group's number;
4. the tokens of a group meet in one row, and those whose byte ranges overlap are links; a link counts as often as its stretch occurs.

Stretches stay in buckets of their text, so that steps 1 and 2, the sums over links and the way back to blocks are free of shuffles. The joined ends are dealt
by stretch once (a full join keeps no partitioning), and the counts of pairs of ids travel.
Documents are kept in blocks, as numbers of the block's stretches; a block is a bounded number of characters, and never a hot key: what a
frequent stretch adds is one row of each block. Python tasks on blocks are streams: they hold the distinct stretches of one block, no documents.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from contextlib import contextmanager
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import forget, in_batches, release_memory, shared_dir, table

#: Where the public vocabularies lie (parameters below).
BYTE_PATH, PIECE_PATH = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Characters of text in a block.
BLOCK = 32 << 20
#: Characters of text that are cut at once.
PART = 2 << 20
#: Whole texts that are sent to Python at once.
TEXTS = 500
#: Stretches of documents that are put together at once.
NUMBERS = 1 << 18
#: Distinct pairs of ids up to which their counts are sent to all tasks; more are joined by a shuffle.
PAIRS = 4_000_000
_CUT = re.compile(r"(?<=\S) (?=\S)")
_RARE = re.compile(r"[^\S \n]")
_CELLS = "kind int, block long, no int, n int, id long, text string, body binary"


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers by planes of bytes, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpack(body: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(body, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def stretches_of(text: str | None) -> list[str]:
    """The text cut at the single spaces between two other characters, which are left out."""
    if not text:
        return []
    return text.split(" ") if _is_plain(text) else _CUT.split(text)


def _is_plain(text: str) -> bool:
    """Whether every space of a text is a cut and there is no other white space but line ends."""
    return not ("  " in text or "\n " in text or " \n" in text or text[0] == " " or text[-1] == " " or _RARE.search(text))


def _numbered(texts: pa.Array, known: dict[str, int]) -> list[np.ndarray]:
    """For each text the numbers of its stretches in ``known``, which gets those that are new. Python looks at each distinct stretch once.

    Pieces give U+2581 back as a space, so a text that has it has no tokens; nothing else is rewritten (see _encode_batches)."""
    found = texts.to_pylist()
    kinds = np.array([0 if not t or MARK in t else 1 if _is_plain(t) else 2 for t in found], np.int8)
    plain, other = np.flatnonzero(kinds == 1), np.flatnonzero(kinds == 2)
    lists = pa.concat_arrays([pc.split_pattern(texts.take(pa.array(plain)), " "), pa.array([_CUT.split(found[k]) for k in other], pa.list_(pa.string()))])
    coded = lists.flatten().dictionary_encode()
    numbers = np.array([known.setdefault(s, len(known)) for s in coded.dictionary.to_pylist()], np.uint32)[coded.indices.to_numpy()]
    ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))))
    out = [np.zeros(0, np.uint32)] * len(found)
    for k, start, stop in zip(np.concatenate((plain, other)).tolist(), ends, ends[1:], strict=False):
        out[k] = numbers[start:stop]
    return out


def _placed(names: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``names`` with those of ``texts`` that are not among them, and the places of ``texts`` there. Held by Arrow, a name is its bytes and an offset."""
    found = pc.index_in(texts, names)
    new = found.is_null().to_numpy(zero_copy_only=False)
    places = found.fill_null(0).to_numpy().astype(np.uint32)
    places[new] = np.arange(len(names), len(names) + new.sum(), dtype=np.uint32)
    return pa.concat_arrays([names, texts.filter(pa.array(new))]), places


def _gathered(batches):
    """Batches of short texts put together up to PART characters, since the block's stretches are looked up anew for each part."""
    held, size = [], 0
    for batch in batches:
        n = pc.sum(pc.utf8_length(batch.column(1))).as_py() or 0
        if held and size + n > PART:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += n
    if held:
        yield pa.concat_batches(held)


def _cut_batches(batches):
    """Documents as numbers of stretches (kind 1), and the stretches of a block with how often they occur there (kind 0).

    Documents go out as soon as they are numbered; of a block only its distinct stretches are held."""
    task, blocks = TaskContext.get().partitionId(), 0
    names, counts, held = pa.array([], pa.string()), np.zeros(0, np.int64), 0

    def rows(kind, **columns):
        n = len(next(iter(columns.values())))
        make = {"kind": pa.int32(), "block": pa.int64(), "no": pa.int32(), "n": pa.int32(), "id": pa.int64(), "text": pa.string(), "body": pa.binary()}
        fixed = {"kind": [kind] * n, "block": [task << 32 | blocks] * n}
        return pa.RecordBatch.from_arrays([pa.array((columns | fixed).get(c, [None] * n), t) for c, t in make.items()], names=list(make))

    def stretches():
        for start in range(0, len(names), 20_000):
            texts = names.slice(start, 20_000)
            yield rows(0, no=range(start, start + len(texts)), n=counts[start : start + len(texts)], text=texts)

    for batch in _gathered(batches):
        sizes, start, size = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist(), 0, 0
        for k, n in enumerate(sizes, 1):
            size, held = size + n, held + n + 100
            if k < batch.num_rows and size < PART and held <= BLOCK:
                continue
            known: dict[str, int] = {}
            part = _numbered(batch.column(1).slice(start, k - start), known)
            names, places = _placed(names, pa.array(list(known), pa.string()))
            part = [places[x] for x in part]
            found = np.bincount(np.concatenate(part), minlength=len(names))
            found[: len(counts)] += counts
            counts = found
            yield rows(1, id=batch.column(0).slice(start, k - start), n=[len(x) for x in part], body=[_pack(x) if len(x) else b"" for x in part])
            start, size = k, 0
            if held > BLOCK:
                yield from stretches()
                names, counts, held = names.slice(0, 0), np.zeros(0, np.int64), 0
                blocks += 1
    yield from stretches()
    batch = part = known = names = places = found = counts = None  # else they are still there when memory is given back
    release_memory()


_loaded: dict[int, tuple] = {}


def _tokenizers(sent):
    """Both tokenizers and the byte lengths of their ids; one of each in a worker."""
    found = _loaded.get(id(sent.value))
    if found is None:
        import sentencepiece
        from tokenizers import Tokenizer

        raw, model = sent.value
        a = Tokenizer.from_str(raw)
        a.encode_special_tokens = True
        b = sentencepiece.SentencePieceProcessor(model_proto=model)
        size_a = np.zeros(a.get_vocab_size(), np.int32)
        for token, k in a.get_vocab().items():
            size_a[k] = len(token)  # a character of a byte-level entry stands for a byte
        size_b = np.array([1 if b.is_byte(k) else len(b.id_to_piece(k).replace(MARK, " ").encode()) for k in range(b.get_piece_size())], np.int32)
        _loaded.clear()
        found = _loaded[id(sent.value)] = (a, b, size_a, size_b)
    return found


def _tokens(ids: list[list[int]], sizes: np.ndarray) -> pa.Array:
    flat = np.fromiter(chain.from_iterable(ids), np.int32)
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(flat, pa.int32()), pa.array(sizes[flat], pa.int32())], names=["id", "size"]))


def _encode_batches(sent):
    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        a, b, size_a, size_b = _tokenizers(sent)
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                texts = part.column(0).to_pylist()
                ids_a = [x.ids for x in a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
                ids_b = b.encode(texts, num_threads=1)
                both = [_tokens(ids_a, size_a), _tokens(ids_b, size_b)]
                wanted = pc.binary_length(part.column(0)).to_numpy() + 1
                for made in both:
                    ends = np.concatenate(([0], np.cumsum(made.flatten().field("size").to_numpy())))[made.offsets.to_numpy()]
                    if (wrong := np.flatnonzero(np.diff(ends) != wanted)).size:
                        raise ValueError(f"a tokenizer rewrites {texts[wrong[0]][:50]!r}; only vocabularies that keep all bytes but U+2581 are supported")
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *both], names=["text", "n", "a", "b"])
        release_memory()

    return run


@contextmanager
def _setting(spark: SparkSession, name: str, value: str):
    """The session's setting ``name`` is ``value`` meanwhile."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _small_batches(spark: SparkSession):
    """Python gets few whole texts at a time: a batch lies in the executor and in its worker at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    return _setting(spark, name, str(min(before, TEXTS) if before > 0 else TEXTS))


def _co_located(spark: SparkSession):
    """Rows that lie together by stretch also count as together for a join on stretch and end."""
    return _setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false")


def _bucketed(df: DataFrame, name: str) -> DataFrame:
    """``df``, whose rows lie together by text already, in the shared folder in buckets of the text."""
    spark = df.sparkSession
    n, made = int(spark.conf.get("spark.sql.shuffle.partitions")), f"quillon_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(n, "text").option("path", f"{shared_dir(spark).rstrip('/')}/{made}").option("compression", "zstd").format("parquet").saveAsTable(made)
    return spark.table(made)


def _ended(stretches: DataFrame, side: str) -> DataFrame:
    """A row for each token of one side: text, n, end (in bytes) and the token."""
    rows = stretches.select("text", "n", F.posexplode(side).alias("pos", "t"))
    end = F.sum("t.size").over(W.partitionBy("text").orderBy("pos")).cast("int")
    return rows.select("text", "n", end.alias("end"), F.struct((end - F.col("t.size")).alias("start"), end.alias("stop"), F.col("t.id").alias("id")).alias(side))


def grouped(stretches: DataFrame) -> DataFrame:
    """text, n (occurrences), g (number of the group), as and bs: the group's tokens of both sides in order. ``stretches``: text, n, a, b."""
    met = _ended(stretches, "a").join(_ended(stretches, "b"), ["text", "n", "end"], "full")
    cut = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)
    before = W.partitionBy("text").orderBy("end").rowsBetween(W.unboundedPreceding, -1)
    numbered = met.withColumn("g", F.count(cut).over(before).cast("int"))
    return numbered.groupBy("text", "n", "g").agg(*[F.array_sort(F.collect_list(s)).alias(f"{s}s") for s in ("a", "b")])


def links(groups: DataFrame, *keep: str) -> DataFrame:
    """The kept columns, a and b (ids) for each pair of tokens of a group whose byte ranges overlap."""
    pairs = groups.select(*keep, "bs", F.explode("as").alias("x")).select(*keep, "x", F.explode("bs").alias("y"))
    return pairs.filter("x.start < y.stop AND y.start < x.stop").select(*keep, F.col("x.id").alias("a"), F.col("y.id").alias("b"))


class Alignment:
    """Both tokenizers' tokens of all texts, aligned.

    ``groups``: the groups of each distinct stretch (see :func:`grouped`). ``pairs``: a, b, n (links of the corpus that hold the pair), best (n is the highest of its b, ties
    included). Null, empty and texts with U+2581 have no tokens. Repeated rows count each by itself; other columns are not looked at; an empty table has none."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_path: str = BYTE_PATH, piece_path: str = PIECE_PATH) -> None:
        spark = self.spark = docs.sparkSession
        self.id_col = id_col
        with open(byte_path, encoding="utf-8") as f, open(piece_path, "rb") as g:  # on the driver; as large as the files
            sent = spark.sparkContext.broadcast((f.read(), g.read()))
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_cut_batches, _CELLS)
        with _small_batches(spark):
            cut = table(rows, "align-blocks", by="kind")
        self.documents = cut.filter("kind = 1").select("block", "id", "n", "body")
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        found = cut.filter("kind = 0").select("block", "no", "n", "text")
        self.places = _bucketed(found.repartition(n, "text"), "places")
        forget(cut, "/kind=0")
        distinct = self.places.groupBy("text").agg(F.sum("n").alias("n"))
        stretches = _bucketed(distinct.mapInArrow(_encode_batches(sent), "text string, n long, a array<struct<id:int,size:int>>, b array<struct<id:int,size:int>>"), "stretches")
        with _co_located(spark):
            self.groups = _bucketed(grouped(stretches), "groups")
        forget(stretches)
        counts = links(self.groups, "n").groupBy("a", "b").agg(F.sum("n").alias("n"))
        self.pairs = table(counts.withColumn("best", F.col("n") == F.max("n").over(W.partitionBy("b"))), "align-pairs")

    def by_stretch(self) -> DataFrame:
        """text, n_a, n_b, n_groups, n_links, n_best, count_sum and groups (the ids of its groups as text)."""
        pair = F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")
        pairs = self.pairs.select(pair.alias("pair"), F.col("n").alias("count"), "best")
        if pairs.count() <= PAIRS:
            pairs = F.broadcast(pairs)
        met = links(self.groups, "text").select("text", pair.alias("pair")).join(pairs, "pair")
        sums = met.groupBy("text").agg(F.count(F.lit(1)).alias("n_links"), F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("count").alias("count_sum"))
        spelled = F.concat_ws("|", *[F.array_join(F.transform(s, lambda x: x["id"].cast("string")), ",") for s in ("as", "bs")])
        rows = self.groups.select("text", F.size("as").alias("na"), F.size("bs").alias("nb"), F.struct("g", spelled.alias("s")).alias("x"))
        whole = rows.groupBy("text").agg(F.sum("na").alias("n_a"), F.sum("nb").alias("n_b"), F.count(F.lit(1)).alias("n_groups"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), ";").alias("groups"))
        return whole.join(sums, "text")

    def by_document(self) -> DataFrame:
        """id_col, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for every row ('' without tokens)."""
        back = self.places.select("text", "block", "no").join(self.by_stretch(), "text").select("block", "no", *_SUMS, "groups")
        both = back.unionByName(self.documents, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", F.asc_nulls_last("no"))
        out = both.mapInArrow(_document_batches, "id long, " + ", ".join(f"{c} long" for c in _SUMS) + ", groups_sha256 string")
        return out.select(F.col("id").alias(self.id_col), *_SUMS, "groups_sha256")


_SUMS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
_NO_TEXT = pa.array([], pa.large_string())


def _document_batches(batches):
    """Documents from what is known of their block's stretches. Rows of a block come together: its stretches in the order of their
    numbers, then its documents (``no`` is null). Documents go out as they come; of a block only its stretches are held."""
    block, sums, spelled, whole = None, [], [], None
    for batch in batches:
        blocks, last = batch.column("block").to_numpy(), batch.column("no").is_null().to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((blocks[1:] != blocks[:-1]) | (last[1:] != last[:-1])) + 1
        for start, stop in pairwise([0, *edges.tolist(), batch.num_rows]):
            part = batch.slice(start, stop - start)
            if not len(part):
                continue
            if block != blocks[start]:
                block, sums, spelled, whole = blocks[start], [[np.zeros(0, np.int64)] for _ in _SUMS], [_NO_TEXT], None
            if not last[start]:
                for held, c in zip(sums, _SUMS, strict=True):
                    held.append(part.column(c).to_numpy().copy())
                spelled.append(pa.concat_arrays([part.column("groups").cast(pa.large_string()), _NO_TEXT]))  # a copy, so that the batch can go
                continue
            if whole is None:
                for k, held in enumerate(sums):
                    sums[k] = np.concatenate(held)
                whole, spelled = pa.concat_arrays(spelled), []
            yield from _documents(part, sums, whole)
    batch = part = sums = held = spelled = whole = None  # else they are still there when memory is given back
    release_memory()


def _documents(docs: pa.RecordBatch, sums: list[np.ndarray], spelled: pa.LargeStringArray):
    """Documents of a block, by some :data:`NUMBERS` stretches at a time."""
    sizes = docs.column("n").to_pylist()
    for rows in in_batches(range(docs.num_rows), sizes, NUMBERS):
        part = docs.slice(rows[0], len(rows))
        lengths = sizes[rows[0] : rows[-1] + 1]
        numbers = np.concatenate([_unpack(body, n) if n else np.zeros(0, np.uint32) for n, body in zip(lengths, part.column("body").to_pylist(), strict=True)])
        ends = np.concatenate(([0], np.cumsum(lengths)))
        made = [np.diff(np.concatenate(([0], np.cumsum(c[numbers])))[ends]) for c in sums]
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), spelled.take(pa.array(numbers))), pa.scalar(";", pa.large_string()))
        digests = [hashlib.sha256(s.as_buffer()).hexdigest() if n else "" for n, s in zip(lengths, joined, strict=True)]
        yield pa.RecordBatch.from_arrays([part.column("id"), *map(pa.array, made), pa.array(digests, pa.string())], names=["id", *_SUMS, "groups_sha256"])
