"""SentencePiece encoding and decoding by a shared-prefix forward pass.

Pieces never reach over the mark that begins a word, so a text is encoded word by word. Each task sorts the distinct
marked words of a block, which is a trie in depth-first order: a word keeps the forward states of the prefix it
shares with the word before and computes only those of its own letters. A state is that of the best segmentation of
the prefix: its last piece and where this begins, in flat arrays, so that a text without a space costs a few bytes a
letter. The ids are read off backwards at a word's end.

* unigram models: the largest sum of piece scores (Viterbi); a state has its forward score, too. Ties go to the longer last piece;
* merge (BPE) models: the segmentation that merging gives. Merging leaves two pieces side by side exactly if it leaves
  them so on their own, so the last piece of a prefix is the one that is compatible with the state before it; no scores
  are added up, as merging has none for a whole segmentation.

Both give the ids of the sentencepiece library. Characters without a piece become byte pieces or <unk>.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_columns, map_kept, map_packed

MARK = "▁"
#: Where the public vocabulary lies; a parameter of every function that reads it.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text whose distinct words are encoded together.
BLOCK_BYTES = 8 << 20
_CHUNK = re.compile(rf"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
#: Compatible pairs, and words of earlier blocks in each of two generations, that a worker remembers.
_PAIRS, _WORDS = 250_000, 120_000


@dataclass
class Vocabulary:
    """What encoding and decoding need of a model file."""

    ids: dict[str, int]
    scores: list[float]
    spelled: list[bytes]
    bytes_at: list[int] | None
    unk: int
    merges: bool
    unk_score: float = 0.0
    long: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        """Keep the pieces that an encoding can have, and for each four last letters the sizes of longer ones, the largest first."""
        self.unk_score = min([self.scores[i] for i in self.ids.values()], default=0.0) - 10.0
        names = dict(self.ids)
        kept = {p: i for p, i in names.items() if not self.merges or merged(p, names, self.scores) == [p]}
        found: dict[str, set[int]] = {}
        for p in kept:
            if len(p) > 4:
                found.setdefault(p[-4:], set()).add(len(p))
        self.long = {k: tuple(sorted(v, reverse=True)) for k, v in found.items()}
        self.names, self.pieces = names, kept


def merged(text: str, ids: dict[str, int], scores: list[float]) -> list[str]:
    """Plain merging: the best-scored pair first, the leftmost of equals. For short strings."""
    parts = list(text)
    while len(parts) > 1:
        best, at = None, -1
        for k in range(len(parts) - 1):
            i = ids.get(parts[k] + parts[k + 1])
            if i is not None and (best is None or scores[i] > best):
                best, at = scores[i], k
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def load(path: str = MODEL_PATH) -> Vocabulary:
    """Read a model file on the driver; what is sent to tasks is as large as the file."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    raw = open(path, "rb").read()
    model = pb.ModelProto.FromString(raw)
    if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces or not model.normalizer_spec.add_dummy_prefix:
        raise ValueError("only models with the identity normaliser and a dummy prefix are supported")
    sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    plain = {p: i for i, p in enumerate(pieces) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
    if any(MARK in p.lstrip(MARK) for p in plain) or any("\n" in p for p in plain):
        raise ValueError("pieces that reach over words or lines are not supported")
    byte_ids = {int(p[3:5], 16): i for i, p in enumerate(pieces) if sp.is_byte(i)}
    spelled = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
    return Vocabulary(plain, [sp.get_score(i) for i in range(n)], spelled, [byte_ids[b] for b in range(256)] if len(byte_ids) == 256 else None, sp.unk_id(), model.trainer_spec.model_type == 2)


class Encoder:
    """Forward states of words in sorted order: the last piece of a prefix (-1 for a letter without one), its begin, and the score so far."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.pairs: dict[int, bool] = {}
        self.last: dict[str, tuple[tuple[int, int], ...]] = {}
        self.size = max(vocabulary.names.values(), default=0) + 1
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.spelled = {i: p for p, i in vocabulary.names.items()}
        self.coded = {i: i.to_bytes(4, "little") for i in vocabulary.names.values()}
        self.unk = vocabulary.unk.to_bytes(4, "little")
        self.piece, self.begin, self.score = array("i", [-1]), array("q", [0]), array("d", [0.0])

    def forget(self) -> None:
        """Drop all but the compatible pairs, which cost most to find."""
        self.kept, self.older, self.last = {}, {}, {}

    def fits(self, before: int, piece: int) -> bool:
        """Whether merging leaves the two pieces side by side."""
        key = before * self.size + piece
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > _PAIRS:
                self.pairs.clear()
            a, b = self.spelled[before], self.spelled[piece]
            ok = self.pairs[key] = merged(a + b, self.v.names, self.v.scores) == [a, b]
        return ok

    def _read_off(self, word: str) -> bytes:
        """The ids of a word whose states are there. Of neighbouring letters without a piece, a model without byte pieces makes one <unk>."""
        piece, begin, coded, out, end = self.piece, self.begin, self.coded, [], len(word)
        while end:
            start, p = begin[end], piece[end]
            if p >= 0:
                out.append(coded[p])
            elif self.v.bytes_at:
                out.append(b"".join([self.v.bytes_at[b].to_bytes(4, "little") for b in word[start:end].encode("utf-8", "replace")]))
            elif not start or piece[start] >= 0:
                out.append(self.unk)
            end = start
        out.reverse()
        return b"".join(out)

    def _candidates(self, last: str) -> tuple[tuple[int, int], ...]:
        """(size, id) of the pieces that can end at these last four letters (fewer: all there are), the largest first; the id of
        a piece of over four letters is left to be looked up (-1), one letter without a piece is -1, too."""
        found = [(n, -1) for n in self.v.long.get(last, ())] + [(n, i) for n in range(len(last), 0, -1) if (i := self.v.pieces.get(last[-n:])) is not None]
        if not found or found[-1][0] > 1:
            found.append((1, -1))
        if len(self.last) > _PAIRS:
            self.last.clear()
        self.last[last] = tuple(found)
        return self.last[last]

    def _extend_merges(self, word: str, start: int) -> None:
        ids, known, pairs, fits, n = self.v.pieces.get, self.last.get, self.pairs.get, self.fits, self.size
        pieces, add, add_begin = self.piece, self.piece.append, self.begin.append
        for end in range(start + 1, len(word) + 1):
            last = word[end - 4 : end] if end > 3 else word[:end]
            for size, piece in known(last) or self._candidates(last):
                if piece < 0:
                    piece = ids(word[end - size : end], -1) if 1 < size <= end else -1
                    if piece < 0:
                        if size == 1:
                            add(-1)
                            add_begin(end - 1)
                        continue
                before = pieces[end - size]
                if before >= 0:
                    ok = pairs(before * n + piece)
                    if not (fits(before, piece) if ok is None else ok):
                        continue
                add(piece)
                add_begin(end - size)
                break

    def _extend_scores(self, word: str, start: int) -> None:
        ids, known, scores, unk = self.v.pieces.get, self.last.get, self.v.scores, self.v.unk_score
        forward, add, add_begin, add_score = self.score, self.piece.append, self.begin.append, self.score.append
        for end in range(start + 1, len(word) + 1):
            last, chosen = word[end - 4 : end] if end > 3 else word[:end], None
            for size, piece in known(last) or self._candidates(last):
                if piece < 0 and size > 1:
                    piece = ids(word[end - size : end], -1) if size <= end else -1
                    if piece < 0:
                        continue
                total = forward[end - size] + (scores[piece] if piece >= 0 else unk)
                if chosen is None or total > best:
                    chosen, begin, best = piece, end - size, total
            add(chosen)
            add_begin(begin)
            add_score(best)

    def encode_sorted(self, words: list[str]):
        """(word, its ids as little-endian int32 bytes) for words in sorted order."""
        states = (self.piece, self.begin) if self.v.merges else (self.piece, self.begin, self.score)
        extend = self._extend_merges if self.v.merges else self._extend_scores
        before = ""
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            for x in states:
                del x[shared + 1 :]
            extend(word, shared)
            yield word, self._read_off(word)
            before = word
        for x in states:
            del x[1:]


def fields_of(text: str | None) -> list[str]:
    """The text's marked words; where runs of spaces occur, the marks of a run stand with the word after it."""
    text = (text or "").replace(MARK, " ")
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " ":
        return _CHUNK.findall(MARK + text.replace(" ", MARK))
    return (MARK + text.replace(" ", " " + MARK)).split(" ")


def encode_texts(texts: list[str | None], encoder: Encoder) -> list[np.ndarray]:
    """The ids of each text; distinct words are encoded once, in sorted order."""
    wanted: set[str] = set()
    for text in texts:
        wanted.update(fields_of(text))
    lines = {f: _CHUNK.findall(f) for f in wanted if "\n" in f}
    wanted.difference_update(lines)
    for found in lines.values():
        wanted.update(found)
    if len(encoder.kept) > _WORDS:  # words that are not met again are forgotten
        encoder.kept, encoder.older = {}, encoder.kept
    known, older = encoder.kept, encoder.older
    missing = wanted.difference(known)
    known.update([(w, older[w]) for w in missing.intersection(older)])
    known.update(encoder.encode_sorted(sorted(missing.difference(older))))
    known |= {f: b"".join([known[c] for c in found]) for f, found in lines.items()}
    return [np.frombuffer(b"".join([known[f] for f in fields_of(text)]), dtype="<i4") for text in texts]


def decode_ids(ids: np.ndarray, spelled: list[bytes]) -> str:
    text = b"".join([spelled[i] for i in ids.tolist()]).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


_encoders: dict[int, Encoder] = {}


def _encoder(sent) -> Encoder:
    """One per worker process and broadcast vocabulary, so that compatible pairs are kept over tasks."""
    found = _encoders.get(id(sent.value))
    if found is None:
        _encoders.clear()
        found = _encoders[id(sent.value)] = Encoder(sent.value)
    return found


def _ids_array(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, dtype=np.int32), *ids]), pa.int32()))


def _encode_batches(sent):
    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0

        def flush():
            rows = pa.Table.from_batches(held)
            ids = encode_texts(rows.column(rows.num_columns - 1).to_pylist(), _encoder(sent))
            for start in range(0, rows.num_rows, 500):
                part = rows.slice(start, 500).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], _ids_array(ids[start : start + 500])], names=[*part.schema.names[:-1], "__ids"])

        for batch in batches:
            for start in range(0, batch.num_rows, 250):
                part = batch.slice(start, 250)
                held.append(part)
                size += sum(len(x.as_py() or "") for x in part.column(part.num_columns - 1))
                if size > BLOCK_BYTES:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()
        _encoder(sent).forget()

    return run


def _decode_batches(sent):
    def run(batches):
        spelled = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                ids = part.column(part.num_columns - 1)
                texts = [None if not x.is_valid else decode_ids(x.values.to_numpy(), spelled) for x in ids]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=[*part.schema.names[:-1], "__text"])

    return run


def _both_batches(sent):
    """Encode, then decode what was encoded, in one task."""
    encode_all = _encode_batches(sent)

    def run(batches):
        for batch in encode_all(batches):
            spelled = sent.value.spelled
            texts = [decode_ids(x.values.to_numpy(), spelled) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "__text"])

    return run


def _send(spark: SparkSession, value):
    return spark.sparkContext.broadcast(value)


def encode(docs: DataFrame, text_col: str = "text", path: str = MODEL_PATH) -> DataFrame:
    """``docs`` with __ids (array of int), the ids of the whole text. Null and empty texts have no ids.

    All columns (but one called __ids, which is replaced) and rows stay; repeated rows get equal ids. U+2581 in a text counts as a space, as in the library."""
    task = _encode_batches(_send(docs.sparkSession, load(path)))
    return map_kept(docs, kept_columns(docs, ["__ids"]), text_col, "string", task, "__ids array<int>")


def decode(encoded: DataFrame, ids_col: str = "__ids", path: str = MODEL_PATH) -> DataFrame:
    """``encoded`` with __text, the text of its ids (null for null). Unknown pieces read as in the library."""
    task = _decode_batches(_send(encoded.sparkSession, load(path).spelled))
    return map_kept(encoded, kept_columns(encoded, ["__text"]), ids_col, "array<int>", task, "__text string")


def round_trip(docs: DataFrame, text_col: str = "text", path: str = MODEL_PATH, ids_as: str = "__ids", text_as: str = "__text") -> DataFrame:
    """``docs`` with ids as by :func:`encode` and text as by :func:`decode` from them, in one pass over the rows. The two columns
    are called as asked, and replace columns of these names only."""
    task = _both_batches(_send(docs.sparkSession, load(path)))
    found = map_packed(docs, kept_columns(docs, [ids_as, text_as]), text_col, "string", task, "__ids array<int>, __text string")
    return found.select("kept.*", F.col("__ids").alias(ids_as), F.col("__text").alias(text_as))
