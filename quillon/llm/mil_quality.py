"""Quality classification by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded (pairs of character classes and
word statistics, then a learned layer); a gated attention network gives each passage a weight, learned only from the
labels of whole documents; the weighted sum of the encodings is scored. One bad passage can thus
decide a long document, and no text is cut.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, kept_columns, map_kept, map_packed, table

PASSAGE = 64
#: Character classes: white space, line end, lower, upper, digit, sentence mark, other sign, byte of a longer character.
CLASSES = 8
FEATURES = CLASSES * CLASSES + 11
#: At most this many labelled documents are used for training, those with the smallest hash of their id, and of those as
#: many as have this many passages together, each with all its passages. So the driver holds at most 160 MB of them.
TRAINING_ROWS, TRAINING_PASSAGES = 4000, 500_000
THRESHOLD = 0.7


def _class_table() -> np.ndarray:
    table = np.full(256, 6, dtype=np.uint8)
    table[128:] = 7
    for value, members in ((0, b" \t\x0b\x0c\r"), (1, b"\n"), (5, b".,;:?'\"()-")):
        table[list(members)] = value
    for value, (first, last) in ((2, b"az"), (3, b"AZ"), (4, b"09")):
        table[first : last + 1] = value
    return table


_TABLE = _class_table()
_POWERS = np.random.default_rng(3).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def passages(text: str | None) -> np.ndarray:
    """n x FEATURES for the passages of ``PASSAGE`` words; a short rest joins the passage before it.

    Shares of pairs of neighbouring character classes, and word statistics. A text without words is one row of zeros."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace") + b" ", dtype=np.uint8)
    kinds = _TABLE[raw]
    inside = kinds > 1
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate(([0], edges))
    first, last = edges[::2], edges[1::2]
    n = len(first)
    if not n:
        return np.zeros((1, FEATURES))
    begins = np.arange(0, max(1, n - PASSAGE // 2), PASSAGE)
    k = len(begins)
    word_of = np.repeat(np.arange(k), np.diff(np.append(begins, n)))
    starts = np.concatenate(([0], first[begins[1:]]))
    byte_sizes = np.diff(np.append(starts, len(raw)))
    pairs = np.repeat(np.arange(k) * CLASSES * CLASSES, byte_sizes)[:-1] + kinds[:-1] * np.uint8(CLASSES) + kinds[1:]
    out = np.zeros((k, FEATURES))
    out[:, : CLASSES * CLASSES] = np.bincount(pairs, minlength=k * CLASSES * CLASSES).reshape(k, -1) / byte_sizes[:, None]
    lengths = last - first
    sizes = np.bincount(word_of)
    places = np.arange(len(raw)) - np.repeat(np.append(0, first), np.diff(np.concatenate(([0], first, [len(raw)]))))
    hashes = np.add.reduceat(np.where(inside, raw, 0).astype(np.uint64) * _POWERS[places & 255], first)
    # kinds of words: short, long, capitals only, signs only, starting with a sign, ending with a sentence mark
    capitals = np.add.reduceat(kinds == 3, first, dtype=np.int64)
    signs = np.add.reduceat((kinds == 5) | (kinds == 6), first, dtype=np.int64)
    words = (lengths <= 3, lengths >= 12, (capitals == lengths) & (lengths > 1), signs == lengths, kinds[first] >= 5, kinds[last - 1] == 5)
    for j, kind in enumerate(words):
        out[:, CLASSES * CLASSES + j] = np.bincount(word_of, weights=kind) / sizes
    distinct, seen = np.unique(hashes, return_inverse=True)
    in_passage = np.unique(word_of * len(distinct) + seen) // len(distinct)
    out[:, -5:] = np.stack([np.bincount(word_of, weights=lengths) / sizes, np.log1p(sizes), np.bincount(in_passage, minlength=k) / sizes, np.full(k, math.log1p(k)), np.full(k, len(distinct) / n)], axis=1)
    return out


@dataclass
class Model:
    """Encoder layer (w, b), attention (v, u, a), head (c, c0) and the features' mean and scale."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    u: np.ndarray
    a: np.ndarray
    c: np.ndarray
    c0: np.ndarray

    PARTS = ("w", "b", "v", "u", "a", "c", "c0")

    def forward(self, x: np.ndarray, starts: np.ndarray):
        sizes = np.diff(np.append(starts, len(x)))
        h = np.tanh((x - self.mean) / self.scale @ self.w + self.b)
        t, g = np.tanh(h @ self.v), 1 / (1 + np.exp(-(h @ self.u)))
        e = (t * g) @ self.a
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        weight = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(weight[:, None] * h, starts, axis=0)
        return sizes, h, t, g, weight, z, 1 / (1 + np.exp(-np.clip(z @ self.c + self.c0, -30, 30)))

    def scores(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return self.forward(x, starts)[-1]


def gradients(m: Model, x: np.ndarray, starts: np.ndarray, labels: np.ndarray, decay: float) -> tuple[float, dict[str, np.ndarray]]:
    """The mean log loss of the documents' labels (with the weights' decay), and its gradient by part of the model."""
    sizes, h, t, g, weight, z, p = m.forward(x, starts)
    loss = -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p)) + decay / 2 * sum((getattr(m, k) ** 2).sum() for k in ("w", "v", "u", "c"))
    d = (p - labels) / len(labels)
    dz = np.repeat(d[:, None] * m.c, sizes, axis=0)
    pull = (dz * h).sum(1)
    de = weight * (pull - np.repeat(np.add.reduceat(weight * pull, starts), sizes))
    dt, dg = de[:, None] * m.a * g * (1 - t * t), de[:, None] * m.a * t * g * (1 - g)
    dh = (weight[:, None] * dz + dt @ m.v.T + dg @ m.u.T) * (1 - h * h)
    normal = (x - m.mean) / m.scale
    return float(loss), {"w": normal.T @ dh + decay * m.w, "b": dh.sum(0), "v": h.T @ dt + decay * m.v, "u": h.T @ dg + decay * m.u, "a": (t * g).T @ de, "c": z.T @ d + decay * m.c, "c0": d.sum(keepdims=True)}


def _bag_batches(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of documents with at most ``most`` passages each; a longer document is a range by itself."""
    out, first, held = [], 0, 0
    for k, n in enumerate(sizes.tolist()):
        if k > first and held + n > most:
            out.append((first, k))
            first, held = k, 0
        held += n
    return [*out, (first, len(sizes))]


def fit(x: np.ndarray, starts: np.ndarray, labels: np.ndarray, width: int = 24, gates: int = 12, epochs: int = 150, rate: float = 0.02, decay: float = 1e-3, seed: int = 7, most: int = 50_000) -> Model:
    """Adam on the log loss of the documents' labels; the same rows give the same model.

    ``x`` may be of single precision; each step adds up the gradients of batches of ``most`` passages, so that only one batch is widened at a time."""
    rng = np.random.default_rng(seed)
    sizes = np.diff(np.append(starts, len(x)))
    batches = [(slice(starts[i], starts[i] + sizes[i:j].sum()), starts[i:j] - starts[i], labels[i:j]) for i, j in _bag_batches(sizes, most)]
    mean = sum(x[rows].sum(0, dtype=np.float64) for rows, _, _ in batches) / len(x)
    scale = np.sqrt(sum(((x[rows] - mean) ** 2).sum(0) for rows, _, _ in batches) / len(x))
    m = Model(
        mean, np.where(scale > 1e-6, scale, 1), rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], width)), np.zeros(width),
        rng.normal(0, width**-0.5, (width, gates)), rng.normal(0, width**-0.5, (width, gates)), rng.normal(0, gates**-0.5, gates), rng.normal(0, width**-0.5, width), np.zeros(1),
    )
    first, second = ({k: np.zeros_like(getattr(m, k)) for k in Model.PARTS} for _ in range(2))
    for step in range(1, epochs + 1):
        total = dict.fromkeys(Model.PARTS, 0.0)
        for rows, own, y in batches:
            for k, grad in gradients(m, x[rows].astype(np.float64), own, y, decay)[1].items():
                total[k] = total[k] + grad * (len(y) / len(labels))
        for k, grad in total.items():
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.999 * second[k] + 0.001 * grad * grad
            setattr(m, k, getattr(m, k) - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8))
    return m


def _training_batches(batches):
    for batch in batches:
        for label, text, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x = passages(text)
            row = [[label], pa.float64()], [[place], pa.int64()], [[len(x)], pa.int64()], [[x.astype(np.float32).tobytes()], pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(*r) for r in row], names=["label", "place", "n", "x"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAINING_ROWS, most: int = TRAINING_PASSAGES) -> Model | None:
    """A model fitted on at most ``rows`` labelled documents outside the held-out part, on all passages of each; None without labels.

    The documents are those with the smallest hash of their id, as many of them as have ``most`` passages together; one that has
    more alone is passed over. Several labels of one document count as their mean, repeated rows as often as they occur; null
    labels and ids are left out, null texts are empty. Empty tables give None."""
    known = (
        labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("__label")).filter("__id IS NOT NULL AND __label IS NOT NULL")
        .filter(crc_mod("__id", 4) != 2).groupBy("__id").agg(F.avg("__label").alias("__label")).orderBy(F.xxhash64("__id"), "__id").limit(rows)
    )
    met = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).cast("string").alias("__text")).join(F.broadcast(known), F.col("__doc") == F.col("__id"))
    bags = table(met.withColumn("__order", F.xxhash64("__id")).select("__label", "__text", "__order").mapInArrow(_training_batches, "label double, place long, n long, x binary"), "training-bags")
    chosen, held = [], 0
    for place, n in sorted(tuple(r) for r in bags.groupBy("place").agg(F.sum("n")).collect()):  # a row for each of at most `rows` documents
        if n <= most:
            held += n
            if held > most:
                break
            chosen.append(place)
    if not chosen:
        return None
    got = bags.filter(F.col("place").isin(chosen)).select("label", "place", "x").toArrow()
    order = sorted(range(got.num_rows), key=lambda k: (got.column("place")[k].as_py(), got.column("x")[k].as_py()))
    found = [np.frombuffer(got.column("x")[k].as_py(), dtype=np.float32).reshape(-1, FEATURES) for k in order]
    starts = np.concatenate(([0], np.cumsum([len(x) for x in found])[:-1])).astype(np.int64)
    return fit(np.concatenate(found), starts, np.array([got.column("label")[k].as_py() for k in order]))


def _scorer(model: Model | None):
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 250):
                part = batch.slice(start, 250)
                bags = [passages(t) for t in part.column(part.num_columns - 1).to_pylist()]
                if model is None:
                    scores = np.full(len(bags), 0.5)
                else:
                    starts = np.concatenate(([0], np.cumsum([len(x) for x in bags])[:-1])).astype(np.int64)
                    scores = model.scores(np.concatenate(bags), starts)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(scores, pa.float64())], names=[*part.schema.names[:-1], "__score"])

    return run


def score(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with __score (0 to 1, higher: good quality likelier), from the whole text only.

    Null and empty texts are scored as one empty passage; without a model every score is 0.5. All columns stay, but one
    that is called __score is replaced. Repeated rows get equal scores; an empty table stays empty."""
    return map_kept(docs, kept_columns(docs, ["__score"]), text_col, "string", _scorer(model), "__score double")


def keep_accepted(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the model accepts, with all their columns; without a model all rows stay."""
    if model is None:
        return docs
    return map_packed(docs, docs.columns, text_col, "string", _scorer(model), "__score double").filter(F.col("__score") >= threshold).select("kept.*")
