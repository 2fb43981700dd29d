"""Language-model scoring by context-tree weighting over bytes.

A text is the sequence of its words in lower case, each followed by a space, the last by a line end. Every byte is
decomposed into 8 binary decisions; each decision has a context tree over the preceding bytes, up to ``DEPTH``. A node
counts zeros and ones of the training texts, has their Krichevsky-Trofimov probability, and mixes it half and half with
its children's: weighted = (own + product of children) / 2. A bit is predicted along its path by the posterior shares of
all depths; a context that the training texts do not have is mixed in with its estimate of no counts, 1/2.

What is gathered is the count of every distinct (DEPTH + 1)-gram of bytes, however many there are:

1. each task cuts its input into blocks and writes, per block, the block's distinct grams and words with their training counts, dealt to buckets by a hash of the ``TOP`` nearest context bytes (words: of the word);
2. a bucket's lists are merged in salted groups first, as many as its measured size asks for, then as one: what is left
   is bounded by the distinct grams of the bucket, however often they occur. A bucket has whole subtrees from depth ``TOP`` down;
3. the levels above are sums of the buckets' rows: by nearest byte (at most 256^(TOP - 1) contexts each), then for the root.
   They come back to a bucket as three numbers a node: the part of each bit's probability from above, and the weight below;
4. every salted group gets its bucket's log probabilities and answers each of its blocks, in the order asked;
5. the input is read again, cut into the same blocks; a block meets its answers and scores its texts.

So no task holds more than a block, a salted group or the distinct grams of a bucket; broadcast are the root's 255 nodes
and one row per bucket.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, release_memory, table

DEPTH = 7
#: A bucket has whole subtrees of nodes of this depth (one less than the depth of the tree, if that is smaller).
TOP = 3
#: Bytes of text in one block and in one of its parts, which also has at most 256 rows.
BLOCK_BYTES, PART_BYTES, PART_ROWS = 16 << 20, 1 << 20, 256
#: Bytes of packed lists in one salted group of a bucket.
GROUP_BYTES = 8 << 20
_TEXTS, _GRAMS, _WORDS = 0, 1, 2
_PACKED = "kind int, block string, bucket int, part int, keys binary, counts binary"
_MODEL = "kind int, bucket int, keys binary, counts binary"
_MERGED = "kind int, bucket int, salts int, keys binary, counts binary, n long, v long"
_LOG_HALF = math.log(0.5)
#: Log probabilities travel as whole numbers of this part of one.
UNIT = 2.0**34


def line(text: str | None) -> bytes:
    """The words of a text in lower case (A-Z only), single spaces between, a line end after."""
    return b" ".join((text or "").encode("utf-8", "replace").lower().split()) + b"\n"


def words_of(lines: bytes) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of every word in these lines: the number of its line, and its place among the distinct words, which come third."""
    raw = np.frombuffer(lines, dtype=np.uint8)
    ends = np.flatnonzero((raw == 32) | (raw == 10))
    last = raw[ends] == 10
    offsets = np.concatenate(([0], ends + 1))
    raw = raw.copy()
    raw[ends] = 32  # a word's bytes are taken with the space after it
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)]).dictionary_encode()
    full = np.diff(offsets) > 1
    return (np.cumsum(last) - last)[full], found.indices.to_numpy()[full], found.dictionary


#: The end of a text among the words, which have no line end in them.
END = pa.array([b"\n"], pa.large_binary())


def sums_of(words: list[pa.Array], counts: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """Distinct words, and the sums of their counts."""
    found = pa.concat_arrays(words).dictionary_encode()
    return found.dictionary, np.bincount(found.indices.to_numpy(), weights=np.concatenate(counts), minlength=len(found.dictionary)).astype(np.int64)


def in_order(words: pa.Array, counts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    order = pc.sort_indices(words)
    return words.take(order), counts[order.to_numpy()]


def places_of(words: pa.Array, known: pa.Array) -> np.ndarray:
    """Where each word stands among the known ones, which have them all."""
    return pc.index_in(words, value_set=known).to_numpy()


def word_hash(words: pa.Array) -> np.ndarray:
    """A number of 32 bits of every word, always the same; it only deals words to buckets."""
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(words.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if len(words) else np.zeros(0, dtype=np.uint8)
    size = np.diff(offsets)
    place = np.arange(len(raw)) - np.repeat(offsets[:-1] - offsets[0], size)
    weights = np.random.PCG64(1).random_raw(int(size.max(initial=0)))
    return np.add.reduceat(raw * weights[place], offsets[:-1] - offsets[0]) >> np.uint64(32) if len(words) else np.zeros(0, dtype=np.uint64)


def keys_of(lines: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A key per byte, nearest context byte first, then the others, the byte itself last; and the row of each."""
    pad = b"\n" * depth
    raw = np.frombuffer(b"".join([x for y in lines for x in (pad, y)]), dtype=np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    key = raw[depth:].copy()
    for k in range(1, depth + 1):
        key |= raw[depth - k : len(raw) - k] << np.uint64(8 * (depth + 1 - k))
    own = np.ones(len(raw), dtype=bool)
    starts = np.cumsum(sizes + depth) - sizes - depth
    own[(starts[:, None] + np.arange(depth)).ravel()] = False
    return key[own[depth:]], np.repeat(np.arange(len(lines)), sizes)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.array([], dtype=np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def counted(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often they occur."""
    keys = np.concatenate([np.zeros(0, dtype=np.uint64), *keys])
    keys.sort()
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.array([], dtype=np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


class Counter:
    """Counts keys as they come: ``HELD`` of them are sorted at a time."""

    HELD = 4_000_000

    def __init__(self) -> None:
        self.raw: list[np.ndarray] = []
        self.size = 0
        self.done: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray) -> None:
        self.raw.append(keys)
        self.size += len(keys)
        if self.size > self.HELD:
            self.sort()

    def sort(self) -> None:
        raw, self.raw, self.size = self.raw, [], 0
        self.done.append(counted(raw))
        if len(self.done) > 4:
            self.done = [self.result()]

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        if self.raw or not self.done:
            self.sort()
        return self.done[0] if len(self.done) == 1 else summed(*(np.concatenate(x) for x in zip(*self.done, strict=True)))


def pack(values: np.ndarray) -> bytes:
    """Numbers, compressed by byte planes."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def unpack(raw: bytes, n: int, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, dtype=kind)
    return np.ascontiguousarray(np.frombuffer(pa.decompress(raw, n * width, codec="zstd", asbytes=True), dtype=np.uint8).reshape(width, n).T).view(kind).ravel()


def _frame(parts: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _parts(raw: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(raw):
        size = int.from_bytes(raw[at : at + 8], "little")
        out.append(raw[at + 8 : at + 8 + size])
        at += 8 + size
    return out


def pack_columns(*columns: np.ndarray) -> bytes:
    return _frame([(len(columns[0]) if columns else 0).to_bytes(8, "little"), *map(pack, columns)])


def unpack_columns(raw: bytes, *kinds) -> tuple[np.ndarray, ...]:
    n, *columns = _parts(raw)
    return tuple(unpack(c, int.from_bytes(n, "little"), kind) for c, kind in zip(columns, kinds, strict=True))


def pack_grams(keys: np.ndarray) -> bytes:
    """Grams in order: for each the number of leading bytes that it shares with the one before, and, by place, the bytes after those."""
    rows = keys.astype(">u8").view(np.uint8).reshape(-1, 8)
    new = np.ones(rows.shape, dtype=bool)
    np.logical_or.accumulate(rows[1:] != rows[:-1], axis=1, out=new[1:])
    shared = (8 - new.sum(1)).astype(np.uint8)
    return _frame([len(keys).to_bytes(8, "little"), *[pa.compress(x.tobytes(), codec="zstd", asbytes=True) if len(x) else b"" for x in (shared, *[rows[new[:, k], k] for k in range(8)])]])


def unpack_grams(raw: bytes) -> np.ndarray:
    n, shared, *places = _parts(raw)
    n = int.from_bytes(n, "little")
    shared = unpack(shared, n, np.uint8)
    keys = np.zeros(n, dtype=np.uint64)
    for k, x in enumerate(places):
        new = shared <= k
        at = np.cumsum(new) - 1
        keys |= unpack(x, int(at[-1]) + 1 if n else 0, np.uint8)[at].astype(np.uint64) << np.uint64(56 - 8 * k)
    return keys


def pack_words(words: pa.Array) -> bytes:
    words = pa.concat_arrays([words])  # from offset 0 on
    sizes = pc.binary_length(words).to_numpy().astype(np.int64)
    raw = words.buffers()[2]
    raw = raw.to_pybytes()[: int(sizes.sum())] if raw is not None else b""
    return _frame([len(words).to_bytes(8, "little"), pack(sizes), pa.compress(raw, codec="zstd", asbytes=True)])


def unpack_words(raw: bytes) -> pa.Array:
    n, sizes, text = _parts(raw)
    n = int.from_bytes(n, "little")
    offsets = np.concatenate(([0], np.cumsum(unpack(sizes, n, np.int64)))).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(pa.decompress(text, int(offsets[-1]), codec="zstd", asbytes=True))])


def pack_fixed(fixed: np.ndarray) -> bytes:
    """Whole numbers, compressed by those byte planes that any of them needs."""
    planes = max(1, (int(fixed.max(initial=0)).bit_length() + 7) // 8)
    rows = np.ascontiguousarray(fixed.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes].T)
    return _frame([len(fixed).to_bytes(8, "little"), planes.to_bytes(1, "little"), pa.compress(rows.tobytes(), codec="zstd", asbytes=True) if len(fixed) else b""])


def unpack_fixed(raw: bytes) -> np.ndarray:
    n, planes, packed = _parts(raw)
    n, planes = int.from_bytes(n, "little"), planes[0]
    out = np.zeros((n, 8), dtype=np.uint8)
    if n:
        out[:, :planes] = np.frombuffer(pa.decompress(packed, n * planes, codec="zstd", asbytes=True), dtype=np.uint8).reshape(planes, n).T
    return out.view("<u8").ravel()


def to_fixed(logs: np.ndarray) -> np.ndarray:
    """Log probabilities (none over 0) in units of 2^-34, which is an error of at most 3e-11 each."""
    return np.rint(np.maximum(-logs, 0.0) * UNIT).astype(np.uint64)


def from_fixed(fixed: np.ndarray) -> np.ndarray:
    return fixed.astype(np.float64) / -UNIT


def gram_bucket(keys: np.ndarray, depth: int, buckets: int) -> np.ndarray:
    """By a hash of the nearest context bytes, so that a bucket has whole subtrees."""
    near = (keys >> np.uint64(8 * (depth + 1 - top_of(depth)))) * np.uint64(0x9E3779B97F4A7C15)
    return ((near >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def word_bucket(words: pa.Array, buckets: int) -> np.ndarray:
    return (word_hash(words) * np.uint64(buckets)) >> np.uint64(32)


def top_of(depth: int) -> int:
    return min(TOP, depth - 1)


def by_bucket(bucket: np.ndarray, buckets: int):
    """(bucket, positions of its keys in order), for buckets that have any."""
    order = np.argsort(bucket.astype(np.uint16 if buckets <= 1 << 16 else np.uint32), kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in range(buckets):
        if edges[b] < edges[b + 1]:
            yield b, order[edges[b] : edges[b + 1]]


# ---- blocks


class _Block:
    """The distinct grams and words of one block's texts, with their training counts."""

    def __init__(self, depth: int) -> None:
        self.depth = depth
        self.grams = {training: Counter() for training in (True, False)}
        self.words: list[tuple[pa.Array, np.ndarray]] = []

    def add(self, lines: list[bytes], held: list[bool]) -> None:
        for training, grams in self.grams.items():
            own = [t for t, h in zip(lines, held, strict=True) if h != training]
            if not own:
                continue
            grams.add(keys_of(own, self.depth)[0])
            _, at, words = words_of(b"".join(own))
            counts = np.append(np.bincount(at, minlength=len(words)), len(own))
            self.words.append((pa.concat_arrays([words, END]), counts if training else np.zeros_like(counts)))

    def merge(self) -> None:
        keys, counts = self.grams[True].result()
        asked = self.grams[False].result()[0]
        self.keys, self.counts = summed(np.concatenate([keys, asked]), np.concatenate([counts, np.zeros(len(asked), dtype=counts.dtype)]))
        self.words = [sums_of(*zip(*self.words, strict=True))]

    def rows(self, buckets: int):
        self.merge()
        for b, at in by_bucket(gram_bucket(self.keys, self.depth, buckets), buckets):
            yield _GRAMS, b, pack_grams(self.keys[at]), pack_columns(self.counts[at])
        words, counts = in_order(*self.words[0])
        for b, at in by_bucket(word_bucket(words, buckets), buckets):
            yield _WORDS, b, pack_words(words.take(pa.array(at))), pack_columns(counts[at])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"kind": pa.int32(), "block": pa.string(), "bucket": pa.int32(), "part": pa.int32(), "keys": pa.binary(), "counts": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


def _pack_texts(ids: list, held: list[bool], lines: list[bytes]) -> bytes:
    raw = b"".join(lines)
    return _frame([
        np.array([x if x is not None else 0 for x in ids], dtype=np.int64).tobytes(), bytes(x is None for x in ids), bytes(held),
        len(raw).to_bytes(8, "little"), pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True),
    ])


def _unpack_texts(raw: bytes) -> tuple[list, list[bool], bytes]:
    ids, nulls, held, size, texts = _parts(raw)
    lines = pa.decompress(texts, int.from_bytes(size, "little"), codec="zstd", asbytes=True)
    return [None if n else i for i, n in zip(np.frombuffer(ids, dtype=np.int64).tolist(), nulls, strict=True)], [bool(h) for h in held], lines


def _packer(depth: int, buckets: int, texts_only: bool):
    """Blocks of a task's rows, named by its partition and their order: either their texts or the lists of what they ask for.

    Both are made from the same rows in the same order; :func:`_scorer` refuses a block whose two sides differ."""

    def run(batches):
        partition, number, block, name = TaskContext.get().partitionId(), 0, None, None
        ids, held, texts, size, total, part = [], [], [], 0, 0, 0

        def close_part():
            nonlocal ids, held, texts, size, part
            if texts_only:
                yield _batch([(_TEXTS, name, -1, part, _pack_texts(ids, held, texts), None)])
            else:
                block.add(texts, held)
            ids, held, texts, size, part = [], [], [], 0, part + 1

        def close_block():
            rows = []
            for kind, b, keys, counts in () if texts_only else block.rows(buckets):
                rows.append((kind, name, b, 0, keys, counts))
                if len(rows) == 256:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

        for batch in batches:
            for start in range(0, batch.num_rows, PART_ROWS):
                rows = batch.slice(start, PART_ROWS)
                for doc_id, is_held, text in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                    own = line(text)
                    n = len(own)
                    if texts and (len(texts) == PART_ROWS or size + n > PART_BYTES):
                        yield from close_part()
                    if block is not None and total and total + n > BLOCK_BYTES:
                        if texts:
                            yield from close_part()
                        yield from close_block()
                        block = None
                    if block is None:
                        block, name, number, total, part = _Block(depth), f"{partition}-{number}", number + 1, 0, 0
                    ids.append(doc_id)
                    held.append(bool(is_held))
                    texts.append(own)
                    size += n
                    total += n
        if block is not None:
            if texts:
                yield from close_part()
            yield from close_block()
        release_memory()

    return run


# ---- merging a bucket's lists


def _merge(rows: pa.Table) -> pa.Table:
    """One row for all lists of a bucket or of one of its salted groups: distinct keys and the sums of their counts."""
    kind = rows.column("kind")[0].as_py()
    unpacked, add = (unpack_words, sums_of) if kind == _WORDS else (unpack_grams, lambda k, c: summed(np.concatenate(k), np.concatenate(c)))
    held, size, done = [], 0, 0
    for keys, counts in zip(rows.column("keys"), rows.column("counts"), strict=True):
        held.append((unpacked(keys.as_py()), unpack_columns(counts.as_py(), np.int64)[0]))
        size += len(held[-1][1])
        if size > max(2_000_000, 2 * done):
            held = [add(*zip(*held, strict=True))]
            size = done = len(held[0][1])
    keys, counts = add(*zip(*held, strict=True))
    if kind == _WORDS:
        keys, counts = in_order(keys, counts)
    return pa.table({
        "kind": rows.column("kind")[:1], "bucket": rows.column("bucket")[:1], "salts": rows.column("salts")[:1], "keys": pa.array([(pack_words if kind == _WORDS else pack_grams)(keys)], pa.binary()),
        "counts": pa.array([pack_columns(counts)], pa.binary()), "n": pa.array([int(counts.sum())], pa.int64()), "v": pa.array([int((counts > 0).sum())], pa.int64()),
    })


# ---- the tree


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by 8; relative error under 1e-12 for x >= 0.5."""
    low = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    s = x + 8
    return (s - 0.5) * np.log(s) - s + 0.5 * math.log(2 * math.pi) + 1 / (12 * s) - 1 / (360 * s**3) + 1 / (1260 * s**5) - low


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def weighted(own: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log of the weighted probability, share of the node's own estimate)."""
    both = _LOG_HALF + np.logaddexp(own, children)
    return both, np.exp(_LOG_HALF + own - both)


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct key starts, and the number of its run for every place."""
    new = np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))
    return np.flatnonzero(new), np.cumsum(new, dtype=np.int32) - 1


def subtrees(keys: np.ndarray, counts: np.ndarray, depth: int, top: int):
    """For each of the 8 bits, over grams that have all of a node's grams or none: the bit's probability after each gram's
    context, mixed over depths ``top`` to ``depth``; and the nodes of depth ``top``: (node, log weighted, zeros, ones)."""
    level, up = {depth: (keys, counts.astype(np.float64))}, {}
    for d in range(depth - 1, top - 1, -1):
        below, n = level[d + 1]
        short = (below >> np.uint64(16)) << np.uint64(8) | (below & np.uint64(255))
        k, up[d + 1] = np.unique(short, return_inverse=True)
        level[d] = k, np.bincount(up[d + 1], weights=n, minlength=len(k))
    for j in range(8):
        seen = {}  # per depth: share of the own estimate, and the estimate, for every gram of that depth
        children = groups = None
        for d in range(depth, top - 1, -1):
            k, n = level[d]
            node = k >> np.uint64(8 - j)
            first, at = _runs(node)
            bit = (k >> np.uint64(7 - j)) & np.uint64(1)
            ones = np.add.reduceat(n * bit, first)
            zeros = np.add.reduceat(n, first) - ones
            own = kt(zeros, ones)
            estimate = (np.where(bit == 1, ones[at], zeros[at]) + 0.5) / (zeros[at] + ones[at] + 1.0)
            if d == depth:
                log_w, seen[d] = own, (None, estimate)
            else:
                log_w, share = weighted(own, np.bincount(at[up[d + 1][groups]], weights=children, minlength=len(first)))
                seen[d] = share[at], estimate
            children, groups = log_w, first
        mixed, path = seen[top][1], None  # from above downwards, so that each step works on the grams of one depth
        below = 1.0
        if top < depth:
            share, estimate = seen[top]
            mixed, below = share * estimate, 1.0 - share
            for d in range(top + 1, depth + 1):
                share, estimate = seen[d]
                path = up[d]
                share = 1.0 if share is None else share
                mixed, below = mixed[path] + below[path] * share * estimate, below[path] * (1.0 - share)
        yield mixed, (node[first], log_w, zeros, ones)


def _frontier(depth: int):
    """Per bucket and nearest byte: the nodes one level above its subtrees, as (place, sum of the children's log weighted, zeros, ones)."""
    top = top_of(depth)

    def run(batches):
        for batch in batches:
            for bucket, keys, counts in zip(batch.column("bucket").to_pylist(), batch.column("keys"), batch.column("counts"), strict=True):
                out = []
                for j, (_, (node, log_w, zeros, ones)) in enumerate(subtrees(unpack_grams(keys.as_py()), unpack_columns(counts.as_py(), np.int64)[0], depth, top)):
                    place = (node >> np.uint64(8 + j)) << np.uint64(8) | np.uint64(1 << j) | (node & np.uint64((1 << j) - 1))
                    at, back = np.unique(place, return_inverse=True)
                    out.append((at, *[np.bincount(back, weights=x, minlength=len(at)) for x in (log_w, zeros, ones)]))
                columns = [np.concatenate(x) for x in zip(*out, strict=True)]
                order = np.argsort(columns[0])
                columns = [x[order] for x in columns]
                near = columns[0] >> np.uint64(8 * (top - 1))
                first, end = _edges(near)
                nodes = [pack_columns(*[x[lo:hi] for x in columns]) for lo, hi in zip(first.tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(near[first].astype(np.int32)), pa.array([bucket] * len(nodes), pa.int32()), pa.array(nodes, pa.binary())], names=["near", "bucket", "nodes"])

    return run


def _edges(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = _runs(sorted_keys)[0]
    return first, np.append(first[1:], len(sorted_keys))


def _nodes_of(raw: bytes) -> tuple[np.ndarray, ...]:
    return unpack_columns(raw, np.uint64, np.float64, np.float64, np.float64)


def _levels(nodes: pa.ChunkedArray, depth: int) -> list[tuple[np.ndarray, ...]]:
    """From depth ``top`` - 1 to depth one, for one nearest byte: (place, log weighted, share, zeros, ones, place's row one level up)."""
    place, s, zeros, ones = (np.concatenate(x) for x in zip(*[_nodes_of(raw.as_py()) for raw in nodes], strict=True))
    out = []
    for d in range(top_of(depth) - 1, 0, -1):
        at, back = np.unique(place, return_inverse=True)
        s, zeros, ones = (np.bincount(back, weights=x, minlength=len(at)) for x in (s, zeros, ones))
        log_w, share = weighted(kt(zeros, ones), s)
        if out:
            out[-1] = (*out[-1], back)
        out.append((at, log_w, share, zeros, ones))
        place, s = (at >> np.uint64(16)) << np.uint64(8) | (at & np.uint64(255)), log_w
    return out


def _root_rows(depth: int):
    """Of one nearest byte: its part of the root's sums."""

    def run(rows: pa.Table) -> pa.Table:
        at, log_w, _, zeros, ones = _levels(rows.column("nodes"), depth)[-1]
        return pa.table({"node": pa.array((at & np.uint64(255)).astype(np.int32)), "s": log_w, "zeros": zeros, "ones": ones})

    return run


def root_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Share, zeros and ones of the root's 255 nodes."""
    node = rows.column("node").to_numpy()
    s, zeros, ones = (np.zeros(256) for _ in range(3))
    for name, x in (("s", s), ("zeros", zeros), ("ones", ones)):
        x[node] = rows.column(name).to_numpy()
    return weighted(kt(zeros, ones), s)[1], zeros, ones


def _above(depth: int, root):
    """Of one nearest byte, for every bucket: what the levels above give to each of its nodes' bits, and the weight left below."""

    def run(rows: pa.Table) -> pa.Table:
        levels = _levels(rows.column("nodes"), depth)
        share, zeros, ones = (x[(levels[-1][0] & np.uint64(255)).astype(np.int64)] for x in root.value)
        zero, one, below = share * (zeros + 0.5) / (zeros + ones + 1), share * (ones + 0.5) / (zeros + ones + 1), 1 - share
        for k in range(len(levels) - 1, -1, -1):
            _, _, share, zeros, ones, *up = levels[k]
            if up:
                zero, one, below = zero[up[0]], one[up[0]], below[up[0]]
            zero = zero + below * share * (zeros + 0.5) / (zeros + ones + 1)
            one = one + below * share * (ones + 0.5) / (zeros + ones + 1)
            below = below * (1 - share)
        out = []
        for raw in rows.column("nodes"):
            place = _nodes_of(raw.as_py())[0]
            at = np.searchsorted(levels[0][0], place)
            out.append(pack_columns(place, zero[at], one[at], below[at]))
        return pa.table({"bucket": rows.column("bucket"), "above": pa.array(out, pa.binary())})

    return run


def _bucket_logs(depth: int):
    """The log probability of the last byte of each of a bucket's grams."""
    top = top_of(depth)

    def run(grams: pa.Table, above: pa.Table) -> pa.Table:
        if not grams.num_rows:
            return pa.table({"kind": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "keys": pa.array([], pa.binary()), "counts": pa.array([], pa.binary())})
        keys = unpack_grams(grams.column("keys")[0].as_py())
        place, zero, one, below = (np.concatenate(x) for x in zip(*[_nodes_of(raw.as_py()) for raw in above.column("above")], strict=True))
        order = np.argsort(place)
        place, zero, one, below = (x[order] for x in (place, zero, one, below))
        context = (keys >> np.uint64(8 * (depth + 2 - top))) << np.uint64(8)
        total = np.zeros(len(keys))
        for j, (mixed, _) in enumerate(subtrees(keys, unpack_columns(grams.column("counts")[0].as_py(), np.int64)[0], depth, top)):
            at = np.searchsorted(place, context | np.uint64(1 << j) | ((keys & np.uint64(255)) >> np.uint64(8 - j)))
            total += np.log10(np.where((keys >> np.uint64(7 - j)) & np.uint64(1) == 1, one[at], zero[at]) + below[at] * mixed)
        return pa.table({"kind": grams.column("kind"), "bucket": grams.column("bucket"), "keys": grams.column("keys"), "counts": pa.array([pack_fixed(to_fixed(total))], pa.binary())})

    return run


def _reply(asked: pa.Table, model: pa.Table) -> pa.Table:
    """Of one salted group: for each block's list, in its order, the log probabilities of its grams or the counts of its words."""
    if not asked.num_rows:
        return pa.table({"kind": pa.array([], pa.int32()), "block": pa.array([], pa.string()), "bucket": pa.array([], pa.int32()), "reply": pa.array([], pa.binary())})
    words = asked.column("kind")[0].as_py() == _WORDS
    values = unpack_columns(model.column("counts")[0].as_py(), np.int64)[0] if words else unpack_fixed(model.column("counts")[0].as_py())
    keys = (unpack_words if words else unpack_grams)(model.column("keys")[0].as_py())
    out = []
    for raw in asked.column("keys"):
        at = places_of(unpack_words(raw.as_py()), keys) if words else np.searchsorted(keys, unpack_grams(raw.as_py()))
        out.append(pack_columns(values[at]) if words else pack_fixed(values[at]))
    return pa.table({"kind": asked.column("kind"), "block": asked.column("block"), "bucket": asked.column("bucket"), "reply": pa.array(out, pa.binary())})


def _scorer(depth: int, buckets: int, n: int, v: int):
    base_unit = math.log10(n + v + 1)

    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        order = sorted(range(texts.num_rows), key=lambda k: texts.column("part")[k].as_py())
        found = {(kind, bucket): k for k, (kind, bucket) in enumerate(zip(replies.column("kind").to_pylist(), replies.column("bucket").to_pylist(), strict=True))}

        def reply(kind: int, b: int, unpacked, n: int) -> np.ndarray:
            values = unpacked(replies.column("reply")[found[kind, b]].as_py()) if (kind, b) in found else ()
            if len(values) != n:
                raise ValueError("the rows came in another order when they were read again: write them to a table first")
            return values

        grams = Counter()
        words = [END]
        for k in order:  # the block's grams and words again, in the order in which it asked
            lines = _unpack_texts(texts.column("keys")[k].as_py())[2]
            grams.add(keys_of(lines.splitlines(keepends=True), depth)[0])
            words.append(words_of(lines)[2])
        keys, grams = grams.result()[0], None
        logs = np.zeros(len(keys))
        for b, at in by_bucket(gram_bucket(keys, depth, buckets), buckets):
            logs[at] = from_fixed(reply(_GRAMS, b, unpack_fixed, len(at)))
        found_words = pa.concat_arrays(words).dictionary_encode()
        by_name = pc.sort_indices(found_words.dictionary)
        known, counts = found_words.dictionary.take(by_name), np.zeros(len(by_name), dtype=np.int64)
        for b, at in by_bucket(word_bucket(known, buckets), buckets):
            counts[at] = reply(_WORDS, b, lambda raw: unpack_columns(raw, np.int64)[0], len(at))
        counts[by_name.to_numpy()] = counts.copy()  # in the order of the dictionary
        end, *places = np.split(found_words.indices.to_numpy(), np.cumsum([len(w) for w in words])[:-1])  # each part's words in the dictionary
        end = int(end[0])
        word_logs, word_known = np.log10(counts + 1.0) - base_unit, counts > 0
        out = []
        for k, place in zip(order, places, strict=True):
            ids, held, lines = _unpack_texts(texts.column("keys")[k].as_py())
            own, row = keys_of(lines.splitlines(keepends=True), depth)
            by_key = np.argsort(own)
            first, at = _runs(own[by_key])
            values = logs[np.searchsorted(keys, own[by_key[first]])][at]
            scores, sizes = np.bincount(row[by_key], weights=values, minlength=len(ids)), np.bincount(row, minlength=len(ids))
            row, at, _ = words_of(lines)
            at = place[at]
            n, seen, base = (np.bincount(row, weights=w, minlength=len(ids)) for w in (None, word_known[at], word_logs[at]))
            out.append(pa.table({
                "id": pa.array(ids, pa.int64()), "held_out": pa.array(held, pa.bool_()), "n_tokens": pa.array(n + 1, pa.int64()), "n_known": pa.array(seen.astype(np.int64) + int(word_known[end]), pa.int64()),
                "base_score": pa.array(base + word_logs[end]), "score": pa.array(scores), "n_bytes": pa.array(sizes, pa.int64()),
            }))
        release_memory()
        return pa.concat_tables(out)

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, buckets: int | None = None) -> DataFrame:
    """One row per input row: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Rows whose crc32 of the id modulo 7 is 2 are held out; all others train the model. ``score`` is the model's log10
    probability of the text (a byte's is exact to 3e-11), ``bits_per_byte`` its code length per byte
    (words, single spaces and the end). Null and empty texts are the end alone. Without training rows each bit has
    probability 1/2 and base_score is 0. Repeated rows are counted and scored as often as they occur; an empty table
    gives no row. Other columns are ignored. ``docs`` is read twice and must give its rows in the same order, as files do; it is
    an error if it does not. ``depth`` is 3 to 7: a gram of one byte more fills 64 bits. ``buckets``
    changes how the work is dealt, not the result; unless given it grows with the square root of the input's
    partitions, and salted groups take up the rest of the growth."""
    if not 3 <= depth <= 7:
        raise ValueError("depth must be 3 to 7")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (crc_mod(id_col, 7) == 2).alias("held"), F.col(text_col).cast("string").alias("text"))
    buckets = buckets or 8 * math.isqrt(64 + rows.rdd.getNumPartitions())
    lists, texts = table(rows.mapInArrow(_packer(depth, buckets, False), _PACKED), "ctw-blocks"), rows.mapInArrow(_packer(depth, buckets, True), _PACKED)
    sizes = table(lists.groupBy("kind", "bucket").agg(F.ceil(F.sum(F.octet_length("keys") + F.octet_length("counts")) / GROUP_BYTES).cast("int").alias("salts")), "ctw-sizes")
    sizes = F.broadcast(sizes)  # at most 2 * buckets rows
    lists = lists.join(sizes, ["kind", "bucket"]).withColumn("salt", F.pmod(F.xxhash64("block"), F.col("salts")).cast("int"))
    groups = table(lists.drop("block", "part").groupBy("kind", "bucket", "salt").applyInArrow(_merge, _MERGED), "ctw-groups", by="kind")
    several = table(groups.filter("salts > 1").groupBy("kind", "bucket").applyInArrow(_merge, _MERGED), "ctw-merged", by="kind")
    merged = groups.filter("salts = 1").unionByName(several)
    grams, words = merged.filter(F.col("kind") == _GRAMS), merged.filter(F.col("kind") == _WORDS)
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    frontier = table(grams.select("bucket", "keys", "counts").mapInArrow(_frontier(depth), "near int, bucket int, nodes binary"), "ctw-frontier")
    root = frontier.groupBy("near").applyInArrow(_root_rows(depth), "node int, s double, zeros double, ones double").groupBy("node").agg(*[F.sum(c).alias(c) for c in ("s", "zeros", "ones")]).toArrow()
    above = frontier.groupBy("near").applyInArrow(_above(depth, docs.sparkSession.sparkContext.broadcast(root_of(root))), "bucket int, above binary")
    logs = grams.select("kind", "bucket", "keys", "counts").groupBy("bucket").cogroup(above.groupBy("bucket")).applyInArrow(_bucket_logs(depth), _MODEL)
    model = logs.unionByName(words.select("kind", "bucket", "keys", "counts")).join(sizes, ["kind", "bucket"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    replies = lists.select("kind", "block", "bucket", "salt", "keys").groupBy("kind", "bucket", "salt").cogroup(model.groupBy("kind", "bucket", "salt")).applyInArrow(_reply, "kind int, block string, bucket int, reply binary")
    scored = texts.select("block", "part", "keys").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        _scorer(depth, buckets, n, v), "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long"
    )
    return scored.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes",
        (-F.col("score") / F.col("n_bytes") / math.log10(2)).alias("bits_per_byte"),
    )
