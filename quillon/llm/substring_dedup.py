"""Substring deduplication by level-wise doubling.

A window of ``window`` words is repeated only if a window of half its length inside it is. So windows are first looked at where they are
short, those repeated at one length alone are extended to twice that length, and so on up to ``window``; when no candidate
survives, the work ends. (A still longer window removes no word that its halves don't.)

* *Which short windows.* At length L each candidate of full length stands for the one of its L-windows with the smallest hash (the leftmost of
  equals), its anchor. Equal windows have equal anchors at the same place, so a candidate whose anchor occurs once in the corpus is done.
  An anchor serves about (window - L) / 2 candidates, so that few rows travel, and none of the candidates is left out.
* *Full length.* The candidates around one anchor first go together, as one row, by what they all say (a stretch of up to
  2 * window - L words). A stretch that occurred before is removed as it is. First stretches are taken apart into their windows only where their anchor
  also occurs in other stretches.
* *What comes back to a document* is never a list of partners, only the places of its own rows that were the first or only ones; all its other
  candidates are repeats. So every level is one grouping with map-side combining, whatever the number of copies.

Keys at full length are two independent 64-bit hashes. Texts are written once, bucketed by document, and all passes and lists meet there without
another shuffle. Places are numbered by document order, so that the smallest number is the earliest occurrence.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD_PATTERN, forget, in_batches, release_memory, shared_dir, table

WINDOW, START = 20, 5
#: Bytes of text that a task hashes at once, and of one word that is hashed as an array.
_BYTES, _LONG_WORD = 2 << 20, 1 << 16
_U = np.uint64


def _splitmix(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random odd 64-bit numbers."""
    x = (np.arange(1, n + 1, dtype=np.uint64) + _U(seed * 1_000_003)) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return (x ^ (x >> _U(31))) | _U(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xA0761D6478BD642F)
    return x ^ (x >> _U(32))


_BYTE = _splitmix(256, 1)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        _powers.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            made = np.full(n, base, dtype=np.uint64)
            made[0] = 1
            _powers.append(np.multiply.accumulate(made))
    return _powers[0], _powers[1]


def _hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word from running sums over the bytes, a part of whole words at a time."""
    out = np.empty(len(starts), dtype=np.uint64)
    longer = np.flatnonzero(ends - starts > _LONG_WORD)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + _BYTES, side="right")))
        if ends[first] - starts[first] > _LONG_WORD:
            first += 1  # hashed below
            continue
        if (k := np.searchsorted(longer, first)) < len(longer):
            last = min(last, int(longer[k]))
        low, high = int(starts[first]), int(ends[last - 1])
        up, down = _power_tables(_BYTES + _LONG_WORD + 1)
        sums = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum(_BYTE[raw[low:high]] * up[: high - low], out=sums[1:])
        a, b = starts[first:last] - low, ends[first:last] - low
        out[first:last] = _mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        first = last
    for k in longer.tolist():
        out[k] = int.from_bytes(hashlib.blake2b(raw[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def _lengths(start: int, window: int) -> list[int]:
    out = [window]
    while out[0] > start and out[0] % 2 == 0:
        out.insert(0, out[0] // 2)
    if out[0] != start or start == window:
        raise ValueError("window must be start doubled at least once")
    return out


class _Block:
    """The words of some documents side by side."""

    def __init__(self, texts: list[bytes], start: int, window: int) -> None:
        raw = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
        space = np.concatenate(([True], _SPACE[raw], [True]))
        edges = np.flatnonzero(space[1:] != space[:-1])
        begins, ends = edges[::2], edges[1::2]
        self.hashes = _hash_words(raw, begins, ends)
        stops = np.cumsum([len(t) + 1 for t in texts])
        upto = np.searchsorted(begins, stops, side="left")
        self.first = np.concatenate(([0], upto[:-1]))
        self.counts = upto - self.first
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self.window, self.start = window, start
        self.levels: dict[tuple[int, int], np.ndarray] = {}
        n = len(self.hashes)
        self.candidates = np.flatnonzero(self.doc[: n - window + 1] == self.doc[window - 1 :]) if n >= window else np.zeros(0, dtype=np.int64)

    def level(self, length: int, seed: int = 0) -> np.ndarray:
        """Hashes of all windows of this length, each from its two halves."""
        found = self.levels.get((length, seed))
        if found is None:
            if length == self.start:
                keys, n = _splitmix(length, 11 + seed), max(0, len(self.hashes) - length + 1)
                found = np.full(n, length, dtype=np.uint64)
                for j in range(length):
                    found += self.hashes[j : j + n] * keys[j]
            else:
                half, keys = self.level(length // 2, seed), _splitmix(2, 11 + seed + length)
                n = max(0, len(half) - length // 2)
                found = half[:n] * keys[0] + (half[length // 2 : length // 2 + n] ^ _U(0x5851F42D4C957F2D)) * keys[1]
            found = self.levels[length, seed] = _mix(found)
        return found

    def anchors(self, at: np.ndarray, length: int) -> np.ndarray:
        """Where the smallest window of this length begins in each of the candidates."""
        if not len(at):
            return at
        view, out = sliding_window_view(self.level(length), self.window - length + 1), np.empty(len(at), dtype=np.int64)
        for k in range(0, len(at), 1 << 16):
            part = at[k : k + (1 << 16)]
            out[k : k + len(part)] = part + view[part].argmin(axis=1)
        return out

    def marked(self, lists) -> np.ndarray:
        """A flag for each word whose place is on its document's list."""
        out = np.zeros(len(self.hashes) + 1, dtype=bool)
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        out[np.repeat(self.first, sizes) + lists.flatten().to_numpy(zero_copy_only=False)] = True
        return out

    def places(self, at: np.ndarray, numbers: np.ndarray, bits: int) -> np.ndarray:
        """Corpus-wide places of words of the block."""
        doc = self.doc[at]
        return (numbers[doc] << bits) | (at - self.first[doc])

    def alive(self, lengths: list[int], once: list) -> np.ndarray:
        """Candidates with a repeated anchor at each of the lengths that are done."""
        at = self.candidates
        for length, lists in zip(lengths, once, strict=False):
            at = at[~self.marked(lists)[self.anchors(at, length)]]
        return at

    def stretches(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Candidates in a row around one anchor: where each run begins and ends in ``at``, and its anchor."""
        anchor = self.anchors(at, length)
        if not len(at):
            return at, at, at
        new = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (np.diff(anchor) != 0))))
        last = np.concatenate((new[1:], [len(at)])) - 1
        return new, last, anchor[new]


def _blocks(batches, start: int, window: int):
    """(block, rows): the text is the first column."""
    for batch in batches:
        for b in range(0, batch.num_rows, 1000):
            rows = batch.slice(b, 1000)
            texts = [t.encode() for t in rows.column(0).to_pylist()]
            done = 0
            for part in in_batches(texts, map(len, texts), _BYTES):
                yield _Block(part, start, window), rows.slice(done, len(part)), part
                done += len(part)
    release_memory()


def _keyed(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c, pa.int64()) for c in columns], names=["at", "a", "b", "c"][: len(columns)])


def _anchor_task(lengths: list[int], level: int, bits: int):
    """Anchors of the candidates that the levels before have left."""

    def run(batches):
        for block, rows, _ in _blocks(batches, lengths[0], lengths[-1]):
            at = block.alive(lengths[:level], rows.columns[2:])
            anchors = np.unique(block.anchors(at, lengths[level]))
            yield _keyed(block.places(anchors, rows.column(1).to_numpy(), bits), block.level(lengths[level])[anchors])

    return run


def _stretch_keys(block: _Block, at: np.ndarray, new: np.ndarray, last: np.ndarray, anchor: np.ndarray, seed: int) -> np.ndarray:
    whole, keys = block.level(block.window, seed), _splitmix(3, 23 + seed)
    shape = ((last - new) * 4096 + anchor - at[new]).astype(np.uint64)
    return _mix(whole[at[new]] * keys[0] + (whole[at[last]] ^ _U(0x5851F42D4C957F2D)) * keys[1] + shape * keys[2])


def _stretch_task(lengths: list[int], bits: int):
    def run(batches):
        for block, rows, _ in _blocks(batches, lengths[0], lengths[-1]):
            at = block.alive(lengths[:-1], rows.columns[2:])
            new, last, anchor = block.stretches(at, lengths[-2])
            if len(new):
                yield _keyed(block.places(at[new], rows.column(1).to_numpy(), bits), *(_stretch_keys(block, at, new, last, anchor, s) for s in (0, 1)), block.level(lengths[-2])[anchor])

    return run


def _window_task(lengths: list[int], bits: int):
    """The windows of first stretches that are not the only one around their anchor."""

    def run(batches):
        for block, rows, _ in _blocks(batches, lengths[0], lengths[-1]):
            at = block.alive(lengths[:-1], rows.columns[2:-1])
            new, last, _ = block.stretches(at, lengths[-2])
            at = at[np.repeat(block.marked(rows.column(rows.num_columns - 1))[at[new]], last - new + 1)]
            if len(at):
                yield _keyed(block.places(at, rows.column(1).to_numpy(), bits), *(block.level(block.window, s)[at] for s in (0, 1)))

    return run


_MADE = "n_words long, n_removed long, kept string, spans array<struct<start:int,end:int>>"


def _final_task(lengths: list[int], survivors: bool):
    """The words that stay, and the spans (first word, word after the last) that go. Columns: text, number, lists of anchors that occur once, whole
    and open first stretches, first windows, id, copies."""

    def run(batches):
        for block, rows, texts in _blocks(batches, lengths[0], lengths[-1]):
            gone = np.zeros(len(block.hashes) + 1, dtype=np.int64)
            if survivors:
                at = block.alive(lengths[:-1], rows.columns[2 : len(lengths) + 1])
                new, last, _ = block.stretches(at, lengths[-2])
                whole, parted, firsts = (block.marked(rows.column(len(lengths) + 1 + k)) for k in range(3))
                size = last - new + 1
                repeat = ~np.repeat(whole[at[new]], size) & ~(np.repeat(parted[at[new]], size) & firsts[at])
                np.add.at(gone, at[repeat], 1)
                np.add.at(gone, at[repeat] + block.window, -1)
            removed = np.cumsum(gone)[:-1] > 0
            n_removed, kept, spans = [], [], []
            for k, (first, n) in enumerate(zip(block.first.tolist(), block.counts.tolist(), strict=True)):
                words, out = texts[k].split(), removed[first : first + n]
                edges = np.flatnonzero(np.diff(np.concatenate(([False], out, [False])).astype(np.int8))).tolist()
                spans.append([{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)])
                n_removed.append(int(out.sum()))
                kept.append(b" ".join(words if not edges else [w for w, x in zip(words, out.tolist(), strict=True) if not x]).decode())
            columns = [pa.array(block.counts, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
            yield pa.RecordBatch.from_arrays([*rows.columns[-2:], *columns], names=["id", "copies", "n_words", "n_removed", "kept", "spans"])

    return run


def _bucketed(df: DataFrame, name: str, dealt: bool = False) -> DataFrame:
    """``df`` in the shared folder, in buckets of its document key. ``dealt``: it is dealt out by this key already."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = f"quillon_{name}_{uuid.uuid4().hex}"
    rows = df if dealt else df.repartition(n, "key", "hash")
    rows.write.bucketBy(n, "key", "hash").option("path", f"{shared_dir(spark).rstrip('/')}/{made}").option("compression", "zstd").format("parquet").saveAsTable(made)
    return spark.table(made)


def _numbered(keys: DataFrame) -> DataFrame:
    """``keys`` with number: its place by (none, key, hash), dealt out by range, so that no task sees all rows."""
    order = ["none", "key", "hash"]
    sorted_ = keys.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = table(sorted_.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "dedup-order")
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each task
    before = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return placed.join(before, "part").select("key", "hash", (F.col("before") + F.col("row")).alias("number"))


class _Passes:
    """The texts and what the levels have found, by document."""

    def __init__(self, spark: SparkSession, texts: DataFrame, lengths: list[int]) -> None:
        self.spark, self.texts, self.lengths = spark, texts, lengths
        most, rows = texts.agg(F.max("n_words"), F.count(F.lit(1))).first()
        self.most = int(most or 0)
        self.bits = max(1, self.most.bit_length())
        if self.bits + int(rows).bit_length() > 62:
            raise ValueError("too many documents for the longest of them to number their words in 63 bits")
        self.numbers = _bucketed(_numbered(texts), "numbers")
        self.lists: list[DataFrame] = []

    def rows(self) -> DataFrame:
        """text, number and the lists so far, by document; all sides lie in the same buckets."""
        out = self.texts.join(self.numbers, ["key", "hash"])
        for one in self.lists:
            out = out.join(one, ["key", "hash"], "left")
        return out

    def run(self, task, keys: list[str], *more: str) -> DataFrame:
        names = [c for one in self.lists for c in one.columns if c not in ("key", "hash", *more)]
        found = self.rows().select("text", "number", *names).mapInArrow(task, ", ".join(f"{c} long" for c in ["at", *keys]))
        return found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))

    def send_back(self, places: DataFrame, name: str, **lists) -> None:
        """Gather the column ``at`` of ``places`` in lists of their documents."""
        number, place = F.shiftright("at", self.bits), F.col("at").bitwiseAND((1 << self.bits) - 1).cast("int")
        by_doc = places.repartition(number).groupBy(number.alias("number")).agg(*[F.collect_list(F.when(which, place)).alias(f"{name}_{k}") for k, which in lists.items()])
        self.lists.append(_bucketed(by_doc.join(self.numbers, "number").drop("number"), name))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, start: int = START) -> DataFrame:
    """One row for each row of ``docs``: id_col, n_words, n_removed, kept (the words that stay, joined by one space) and spans (first word, word after the
    last) that were removed.

    A word goes if it is covered by ``window`` words in a row that also begin earlier: in a document of smaller id, or earlier in the same one. Windows are
    judged on the input, not on what is left. A word is a maximal run of characters other than the six spaces; null and empty texts
    have none. Null ids come after all others. Rows of one id and one text are one document and all get its answer; rows of one id with different texts are different
    documents, in the order of a hash of the text. An empty table gives no rows; other columns are not looked at. Ids are whole numbers."""
    lengths, spark = _lengths(start, window), docs.sparkSession
    doc_id, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(doc_id.isNull().alias("none"), F.coalesce(doc_id, F.lit(0)).alias("key"), text.alias("text"))
    keyed = keyed.withColumn("hash", F.xxhash64("none", "text"))
    once = keyed.groupBy("key", "hash").agg(F.first("none").alias("none"), F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    counted = once.withColumn("n_words", F.regexp_count("text", F.lit(WORD_PATTERN)))
    passes = _Passes(spark, _bucketed(counted, "texts", dealt=True), lengths)
    survivors = passes.most >= window
    if survivors:
        for level, length in enumerate(lengths[:-1]):
            found = passes.run(_anchor_task(lengths, level, passes.bits), ["a"])
            passes.send_back(found.filter("n = 1"), f"once{length}", at=F.lit(True))
        stretches = table(passes.run(_stretch_task(lengths, passes.bits), ["a", "b", "c"]).select("at", "c"), "dedup-stretches")
        survivors = not stretches.isEmpty()
    if survivors:
        shared = stretches.groupBy("c").agg((F.count(F.lit(1)) > 1).alias("parted"), F.min("at").alias("alone"))
        firsts = stretches.join(shared.filter("parted").select("c"), "c", "left_semi").select("at", F.lit(True).alias("parted")).unionByName(shared.filter("NOT parted").select(F.col("alone").alias("at"), "parted"))
        passes.send_back(firsts, "stretch", whole=~F.col("parted"), parted=F.col("parted"))
        forget(stretches)
        passes.send_back(passes.run(_window_task(lengths, passes.bits), ["a", "b"], "stretch_whole"), "window", first=F.lit(True))
    names = [c for one in passes.lists for c in one.columns if c not in ("key", "hash")] if survivors else []
    rows = passes.rows().withColumn("id", F.when(~F.col("none"), F.col("key")))
    out = rows.select("text", "number", *names, "id", "copies").mapInArrow(_final_task(lengths, survivors), "id long, copies long, " + _MADE)
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept", "spans", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("__copy")).drop("__copy")
