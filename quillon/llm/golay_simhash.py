"""SimHash fingerprints and near-duplicate groups found by Golay-code keys.

A fingerprint of 64 bits is cut into segments A (23 bits), B (23 bits) and C (18 bits). The binary Golay
code is perfect: every 23-bit word has one codeword within 3 bits, and the words 3 bits away have five
more within 4. Decoding a segment to these indices gives keys that survive bit errors:

* words one bit apart: the nearest codeword of one is within 4 bits of the other;
* words two bits apart: the sets of codewords within 4 bits meet (the tests verify both for all words).

With at most 4 differing bits, (a, b, c) in the segments, the pigeonhole leaves these cases, each a family of keys of 30
to 35 bits (so that even ten billion fingerprints leave a key of chance at most some hundred rows):

    a == 0, b <= 2                  A itself, one codeword within 4 bits of B          (and likewise b == 0, a <= 2)
    a == 0, c <= 1                  A itself, one of two 9-bit parts of C              (and likewise b == 0, c <= 1)
    a <= 2, b <= 2, c <= 1          a codeword of A, a codeword of B, one of two 9-bit parts of C
    a == b == 1, c <= 2             a codeword of A, a codeword of B (nearest for one row), one of three 6-bit parts of C
    a == 1, b == 3, c == 0          a codeword of A (nearest for one row), C itself    (and likewise a == 3, b == 1)

Rows that share a key are compared in full; a task reads its keys in order and holds one stretch of them at a time. Keys that
a sample of the fingerprints shows to be large are spread over tasks from the start, others that turn out to be large pass
through; both are compared block against block. Distinct fingerprints only are dealt to keys, so a group of
exact copies counts once however large it is.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import quoted, table, with_sums
from .components import components

#: Generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 (fixed value).
GENERATOR = 0b110001110101
MAX_BITS = 4
SALTS = 32
#: Rows of one key that one task compares; keys with more are compared in pairs of blocks of this size.
BLOCK = 4096
#: One fingerprint in SAMPLE, by hash, is counted to find large keys beforehand, and the SPREAD largest of those are spread (the others pass through).
SAMPLE, SPREAD = 64, 100_000
#: Rows that a task compares at once.
STRETCH = 1_000_000


def fingerprints_of(texts: list[str | None], shingle: int = 4) -> np.ndarray:
    """The fingerprint of each text: a bit is 1 if set in over half the shingles' XXH64 (seed 42)."""
    out = np.zeros(len(texts), dtype=np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for k, text in enumerate(texts):
        words = (text or "").encode("utf-8", "replace").lower().split()
        n = len(words)
        if not n:
            continue
        line = b" ".join(words)
        if n < shingle:
            hashes = [xxhash.xxh64_intdigest(line, 42)]
        else:
            ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1)
            starts = np.concatenate(([0], ends[: n - shingle])).tolist()
            hashes = [xxhash.xxh64_intdigest(line[i:j], 42) for i, j in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = weights[bits * 2 > len(hashes)].sum(dtype=np.uint64)
    return out


def _fingerprint_batches(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            prints = fingerprints_of(part.column(part.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(prints.view(np.int64))], names=[*part.schema.names[:-1], "fp"])


def text_marks(text_col: str) -> list[Column]:
    """Two hashes that tell texts apart, null from the empty one too (128 bits)."""
    return [F.xxhash64(F.col(text_col)).alias("__hash"), F.xxhash64(F.lit(1), F.col(text_col)).alias("__hash2")]


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", marked: bool = False) -> DataFrame:
    """(id, fp) per row, with the text's marks between them if asked; fp holds the 64 bits as a long. Null and empty texts have fingerprint zero."""
    marks = text_marks(text_col) if marked else []
    rows = docs.select(F.col(id_col).cast("long").alias("id"), *marks, F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprint_batches, "id long, __hash long, __hash2 long, fp long" if marked else "id long, fp long")


@lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(syndromes of the 4096 high parts, error patterns by syndrome as 2048 x 6, number of patterns by syndrome).

    A word's syndrome is its remainder by the generator. Patterns are those of up to 4 bits, the lightest first."""
    def remainder(word: int) -> int:
        for i in range(22, 10, -1):
            if word >> i & 1:
                word ^= GENERATOR << (i - 11)
        return word

    high = np.array([remainder(x << 11) for x in range(4096)], dtype=np.uint32)
    patterns, count = np.zeros((2048, 6), dtype=np.uint32), np.zeros(2048, dtype=np.int64)
    for weight in range(5):
        for places in combinations(range(23), weight):
            word = sum(1 << p for p in places)
            s = int(high[word >> 11]) ^ (word & 2047)
            patterns[s, count[s]] = word
            count[s] += 1
    return high, patterns, count


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (12 bits) of the codewords within 4 bits of each 23-bit word, as n x 6, nearest first, and how many there are."""
    high, patterns, count = golay_tables()
    syndrome = high[words >> np.uint32(11)] ^ (words & np.uint32(2047))
    return (words[:, None] ^ patterns[syndrome]) >> np.uint32(11), count[syndrome]


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for all keys of all fingerprints. A key's lowest bit is 0 where at least one of two rows that
    should meet has it (its nearest codeword, or parts taken as they are), so that a pair of 1s need not be compared."""
    a = (prints & np.uint64(0x7FFFFF)).astype(np.uint32)
    b = (prints >> np.uint64(23) & np.uint64(0x7FFFFF)).astype(np.uint32)
    c = (prints >> np.uint64(46)).astype(np.uint64)
    (ga, na), (gb, nb) = golay_keys(a), golay_keys(b)
    rows, keys = [], []
    everyone = np.arange(len(prints))

    def add(family: int, which: np.ndarray, value: np.ndarray, probe: bool) -> None:
        rows.append(which)
        keys.append((np.uint64(family) << np.uint64(58)) | (value.astype(np.uint64) << np.uint64(1)) | np.uint64(probe))

    six, nine = [c >> np.uint64(6 * p) & np.uint64(63) for p in range(3)], [c >> np.uint64(9 * p) & np.uint64(511) for p in range(2)]
    for f, whole, near, n, other, m in ((1, a, ga, na, gb, nb), (5, b, gb, nb, ga, na)):
        whole = whole.astype(np.uint64)
        for i in range(6):
            there = everyone[m > i]
            add(f, there, whole[there] << np.uint64(12) | other[there, i], False)
            there = everyone[n > i]
            add(f + 3, there, near[there, i].astype(np.uint64) << np.uint64(18) | c[there], bool(i))
        for p in range(2):
            add(f + 1 + p, everyone, whole << np.uint64(9) | nine[p], False)
    for i in range(6):
        for j in range(6):
            there = everyone[(na > i) & (nb > j)]
            both = ga[there, i].astype(np.uint64) << np.uint64(12) | gb[there, j]
            for p in range(2):
                add(9 + p, there, both << np.uint64(9) | nine[p][there], False)
            for p in range(3):
                add(11 + p, there, both << np.uint64(6) | six[p][there], bool(i or j))
    return np.concatenate(rows), np.concatenate(keys)


def _key_batches(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, 20_000):
            prints = batch.column(0).slice(start, 20_000).to_numpy(zero_copy_only=False)
            rows, keys = keys_of(prints.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(prints[rows])], names=["key", "fp"])


class _Roots:
    """Union-find over the positions of one block."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def join(self, i: int, others: np.ndarray) -> np.ndarray:
        """Link i with the others; returns those that were apart from i until now, one per part."""
        parts, first = np.unique(self.label[others], return_index=True)
        new = parts != self.label[i]
        if new.any():
            self.label[np.isin(self.label, parts[new])] = self.label[i]
        return others[first[new]]


def block_links(prints: np.ndarray, bits: int = MAX_BITS, split: int | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``prints``; with ``split``, only links from before that place to after are sought.
    Fingerprints already joined are not compared again, so a dense group costs a few rows of comparisons."""
    n, found = len(prints), []
    roots = _Roots(n)
    for i in range(n if split is None else split):
        rest = np.nonzero(roots.label != roots.label[i])[0]
        rest = rest[rest >= split] if split is not None else rest
        if not len(rest):
            if split is None:
                break
            continue
        near = rest[np.bitwise_count(prints[rest] ^ prints[i]) <= bits]
        if len(near):
            found += [(i, int(j)) for j in roots.join(i, near)]
    return found


def links_in_keys(keys: np.ndarray, prints: np.ndarray, block: int = BLOCK, bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Links between fingerprints that share a key, and the keys with over ``block`` rows, left for later."""
    order = np.argsort(keys, kind="stable")
    keys, prints = keys[order], prints[order]
    shared, probe = keys >> np.uint64(1), keys & np.uint64(1)
    starts = np.concatenate(([0], np.nonzero(shared[1:] != shared[:-1])[0] + 1, [len(keys)])) if len(keys) else np.array([0])
    sizes = np.diff(starts)
    left, right, later = [], [], []
    for k in np.nonzero(sizes > 24)[0]:
        own = prints[starts[k] : starts[k + 1]]
        if len(own) > block:
            later.append((int(shared[starts[k]]), np.unique(own)))
            continue
        own = np.unique(own)
        if pairs := block_links(own, bits):
            i, j = np.array(pairs).T
            left.append(own[i])
            right.append(own[j])
    ends = np.repeat(starts[1:], sizes) if len(keys) else np.array([], dtype=np.int64)
    at = np.nonzero((probe == 0) & (np.repeat(sizes, sizes) <= 24))[0]
    for step in range(1, 24):
        at = at[at + step < ends[at]]
        if not len(at):
            break
        near = at[np.bitwise_count(prints[at] ^ prints[at + step]) <= bits]
        left.append(prints[near])
        right.append(prints[near + step])
    empty = np.array([], dtype=np.uint64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right]), later


def _out(key, a, b):
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["key", "a", "b"])


def _later(key: int, prints: np.ndarray):
    for start in range(0, len(prints), 50_000):
        part = prints[start : start + 50_000]
        yield _out([key] * len(part), part, part)


def _link_batches(block: int):
    """Links among rows (key, fp, spread) that come in the order of their keys; rows of large keys go on, to be compared block by block."""

    def compare(keys: np.ndarray, prints: np.ndarray):
        a, b, large = links_in_keys(keys, prints, block)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), dtype=np.uint64)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        for start in range(0, len(pairs), 50_000):
            part = np.ascontiguousarray(pairs[start : start + 50_000].T)
            yield _out([None] * part.shape[1], part[0], part[1])
        for key, own in large:
            yield from _later(key, own)

    def run(batches):
        held, size, passing = [], 0, None
        for batch in batches:
            keys, prints = (batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in (0, 1))
            spread = batch.column(2).to_numpy(zero_copy_only=False)
            if spread.any():
                for key in np.unique(keys[spread] >> np.uint64(1)).tolist():
                    yield from _later(key, prints[spread & (keys >> np.uint64(1) == key)])
                keys, prints = keys[~spread], prints[~spread]
            if passing is not None and len(keys):
                more = keys >> np.uint64(1) == passing
                yield from _later(int(passing), prints[more])
                keys, prints = keys[~more], prints[~more]
                passing = passing if not len(keys) else None
            held.append((keys, prints))
            size += len(keys)
            if size >= STRETCH:
                keys, prints = (np.concatenate(x) for x in zip(*held, strict=True))
                shared = keys >> np.uint64(1)
                cut = int(np.argmax(shared == shared[-1]))  # where the last key begins, which may go on
                yield from compare(keys[:cut], prints[:cut])
                held, size = [(keys[cut:], prints[cut:])], len(keys) - cut
                if size >= STRETCH:
                    passing = shared[-1]
                    yield from _later(int(passing), prints[cut:])
                    held, size = [], 0
        if held:
            yield from compare(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _block_pair_batches(rows: pa.Table) -> pa.Table:
    i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
    prints = rows.column("fp").to_numpy().view(np.uint64)
    side = rows.column("side").to_numpy(zero_copy_only=False)
    first, second = prints[side == 0], prints[side == 1]
    own = first if i == j else np.concatenate((first, second))
    pairs = block_links(own, split=None if i == j else len(first))
    a, b = (np.array([own[p[k]] for p in pairs], dtype=np.uint64) for k in (0, 1))
    return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})


def links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """``prints``: one column of distinct fingerprints. Links (a, b) whose components are those of all pairs within 4 bits.

    A key with over ``block`` fingerprints (many soft bits in one family of copies) is cut into blocks of about
    that size, and every pair of its blocks is compared in a task of its own."""
    sampled = prints.filter(F.pmod(F.xxhash64("fp"), F.lit(SAMPLE)) == 0).mapInArrow(_key_batches, "key long, fp long").groupBy(F.shiftrightunsigned("key", 1).alias("shared")).agg(F.count(F.lit(1)).alias("n"))
    sampled = sampled.filter(F.col("n") * SAMPLE >= 2 * block).orderBy(F.desc("n"), "shared").limit(SPREAD).select("shared", F.ceil(F.col("n") * SAMPLE / block).cast("int").alias("parts"))
    dealt = prints.mapInArrow(_key_batches, "key long, fp long").withColumn("shared", F.shiftrightunsigned("key", 1)).join(F.broadcast(sampled), "shared", "left")
    salt = F.coalesce(F.pmod(F.xxhash64("fp"), F.col("parts")), F.lit(0))
    dealt = dealt.select("shared", salt.alias("salt"), "key", "fp", F.col("parts").isNotNull().alias("spread")).repartition("shared", "salt").sortWithinPartitions("key").select("key", "fp", "spread")
    found = table(dealt.mapInArrow(_link_batches(block), "key long, a long, b long"), "golay-links")
    plain = found.filter("key IS NULL").select("a", "b").distinct()
    large = found.filter("key IS NOT NULL").select("key", "a").distinct()
    if large.isEmpty():
        return plain
    dealt = with_sums(large, ["key"], F.col("a"), {"rows": (F.count(F.lit(1)), F.sum)}).withColumn("n", F.ceil(F.col("rows") / block).cast("int"))
    dealt = dealt.withColumn("x", F.pmod(F.xxhash64("a"), F.col("n")).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select("key", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), (F.col("x") > F.col("y")).cast("int").alias("side"), F.col("a").alias("fp"))
    more = dealt.groupBy("key", "i", "j").applyInArrow(_block_pair_batches, "a long, b long")
    return plain.unionByName(more).distinct()


def _rooted(nodes: DataFrame) -> DataFrame:
    """``nodes``, a row per distinct fp, with root, the smallest fp of its component."""
    roots = components(links(nodes.select("fp")))
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select(*[nodes[c] for c in nodes.columns], F.coalesce("root", "fp").alias("root"))


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: id_col, fp (the 64 bits as a long), component_id.

    component_id is the smallest id reachable over links of at most 4 differing bits, the row's own included.
    Null, empty and white-space texts share fingerprint zero; repeated rows share a component; null ids never
    become a component_id unless all ids of a component are null. Other columns are ignored."""
    place = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")  # of the row, whatever its id is; the table keeps it
    rows = table(fingerprint(docs, id_col, text_col).withColumn("salt", place), "fingerprints")
    salted = rows.groupBy("fp", "salt").agg(F.min("id").alias("least"))
    nodes = table(salted.groupBy("fp").agg(F.min("least").alias("least"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts")), "fingerprint-nodes")
    rooted = with_sums(_rooted(nodes), ["root"], F.col("fp"), {"component_id": (F.min("least"), F.min)})
    known = rooted.selectExpr("fp", "component_id", f"explode(filter(sequence(0, {salts - 1}), s -> getbit(salts, s) = 1)) AS salt")
    return rows.join(known, ["fp", "salt"]).select(F.col("id").alias(id_col), "fp", "component_id")


def hex_of(fp: str = "fp"):
    """Sixteen lower-case hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, of which one stays per component: the one with the smallest id.

    Of rows that share that id in a component, the one with the smallest text hash stays, and of repeated rows any one; null
    ids come last, so they stay only where a component has no other. One id or null may stay in many components."""
    rows = fingerprint(docs, id_col, text_col, marked=True)
    best = F.struct(F.col("id").isNull().alias("none"), "id", "__hash", "__hash2").alias("best")
    salted = rows.select("fp", F.pmod(F.xxhash64("id", "__hash"), F.lit(SALTS)).alias("salt"), best).groupBy("fp", "salt").agg(F.min("best").alias("best"))
    nodes = table(salted.groupBy("fp").agg(F.min("best").alias("best")), "fingerprint-nodes")
    stay = _rooted(nodes).groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.id").alias("__keep"), F.col("best.__hash").alias("__keep_hash"), F.col("best.__hash2").alias("__keep_hash2"))
    rows = docs.select(F.struct(*quoted(docs.columns)).alias("__row"), F.col(id_col).cast("long").alias("__id"), *text_marks(text_col))
    met = rows.join(stay, F.col("__id").eqNullSafe(F.col("__keep")) & (F.col("__hash") == F.col("__keep_hash")) & (F.col("__hash2") == F.col("__keep_hash2")))
    one = F.row_number().over(W.partitionBy("__id", "__hash", "__hash2").orderBy("__hash"))
    return met.withColumn("__first", one).filter("__first = 1").select("__row.*")
