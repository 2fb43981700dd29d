"""Alignment against a brute-force version over whole texts, with both libraries."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from quillon.llm import alignment

from .helpers import awkward, empty


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.BYTE_PATH)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_PATH)


def tokens(text, a, b):
    """(id, start, stop) of both sides, or none."""
    whole = (" " + text).encode()
    ids = a.encode(" " + text, add_special_tokens=False)
    sizes_a = [len(t) for t in ids.tokens]
    pieces = b.encode(text, out_type=str)
    spelled = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in pieces]
    if not text or b"".join(spelled) != whole:
        return [], []
    out = []
    for found, sizes in ((ids.ids, sizes_a), (b.encode(text), [len(x) for x in spelled])):
        at, side = 0, []
        for k, n in zip(found, sizes, strict=True):
            side.append((k, at, at + n))
            at += n
        out.append(side)
    return out


def brute(rows, a, b):
    made, counts = [], Counter()
    for doc_id, text in rows:
        left, right = tokens(text or "", a, b)
        links = [(x[0], y[0]) for x in left for y in right if x[1] < y[2] and y[1] < x[2]]
        cuts = sorted({x[2] for x in left} & {y[2] for y in right})
        sides = []
        for side in (left, right):
            groups = defaultdict(list)
            for k, _, stop in side:
                groups[sum(c < stop for c in cuts)].append(str(k))
            sides.append(groups)
        spelled = ";".join(",".join(sides[0][g]) + "|" + ",".join(sides[1][g]) for g in range(len(cuts)))
        counts.update(links)
        made.append((doc_id, len(left), len(right), len(cuts), links, spelled))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return sorted(
        ((d is None, d or 0), na, nb, ng, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(s.encode()).hexdigest() if na else "")
        for d, na, nb, ng, links, s in made
    )


def found(made):
    return sorted(((r.doc_id is None, r.doc_id or 0), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in made.by_document().collect())


TEXTS = ["a  b\n c d", " leading and trailing ", "x 's y don't", "mark ▁ here", "mark▁", "日本語 のテキスト é ü", "<|endoftext|> <s> </s> <0x41>", "tab\tand hard　space", "ﬁne \x00 null", "123 4567 89.0", "\n\n", " ", "the the the", "🙂🙃 x"]


def test_equals_brute_force(spark, tokenizers):
    rows = list(enumerate(TEXTS)) + [(k, r.text[:1500]) for k, r in enumerate(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect(), 100)]
    made = alignment.Alignment(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert found(made) == brute(rows, *tokenizers)
    every = Counter()
    for _, text in rows:
        left, right = tokens(text, *tokenizers)
        every.update((x[0], y[0]) for x in left for y in right if x[1] < y[2] and y[1] < x[2])
    assert {(r.a, r.b): r.n for r in made.pairs.collect()} == every


def test_awkward_rows_and_small_blocks(spark, tokenizers, monkeypatch):
    docs = awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(alignment.Alignment(docs)) == brute(rows, *tokenizers)
    assert found(alignment.Alignment(empty(spark))) == []
    monkeypatch.setattr(alignment, "PAIRS", 0)
    assert found(alignment.Alignment(docs)) == brute(rows, *tokenizers)


def test_cuts():
    for text in [*TEXTS, "a b", "a\u00a0b c", "x\n y", "x \ny", "a\x1cb c", "", None]:
        assert alignment.stretches_of(text) == (re.split(r"(?<=\S) (?=\S)", text) if text else [])


def test_blocks_hold_each_stretch_once(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(alignment, "BLOCK", 150)
    monkeypatch.setattr(alignment.TaskContext, "get", staticmethod(lambda: type("T", (), {"partitionId": lambda self: 3})()))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(["a b a", "b c", None, "a"])], names=["id", "text"])
    rows = [r for b in alignment._cut_batches([batch]) for r in b.to_pylist()]
    for block in {r["block"] for r in rows}:
        texts = [r["text"] for r in rows if r["block"] == block and r["kind"] == 0]
        assert len(texts) == len(set(texts))
    counts = Counter()
    for r in rows:
        if r["kind"] == 0:
            counts[r["text"]] += r["n"]
    assert counts == Counter(a=3, b=2, c=1) and len({r["block"] for r in rows}) > 1


def test_python_looks_at_each_distinct_stretch_of_a_part_once():
    import pyarrow as pa

    class Known(dict):
        asked = 0

        def setdefault(self, *args):
            Known.asked += 1
            return super().setdefault(*args)

    known = Known()
    texts = [*TEXTS, "a b a " * 200 + "a", "x\ty z  w x", "", None, "b a"]
    numbers = alignment._numbered(pa.array(texts), known)
    names = list(known)
    assert [[names[i] for i in x] for x in numbers] == [alignment.stretches_of(t) if t and alignment.MARK not in t else [] for t in texts]
    assert Known.asked == len(known)


def test_documents_leave_the_cutting_as_they_come(monkeypatch):
    import pyarrow as pa

    drawn = []

    def batches():
        for k, text in enumerate(["a b a", "b c", "a c d"]):
            drawn.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([text])], names=["id", "text"])

    monkeypatch.setattr(alignment, "PART", 5)
    monkeypatch.setattr(alignment.TaskContext, "get", staticmethod(lambda: type("T", (), {"partitionId": lambda self: 3})()))
    out = alignment._cut_batches(batches())
    first = next(out).to_pylist()
    assert drawn == [0, 1] and [(r["kind"], r["id"]) for r in first] == [(1, 0)]
    rows = first + [r for b in out for r in b.to_pylist()]
    names = {r["no"]: r["text"] for r in rows if r["kind"] == 0}
    assert sorted(names) == list(range(4)) and {r["text"]: r["n"] for r in rows if r["kind"] == 0} == dict(a=3, b=2, c=2, d=1)
    assert [" ".join(names[k] for k in alignment._unpack(r["body"], r["n"])) for r in rows if r["kind"] == 1] == ["a b a", "b c", "a c d"]


@pytest.mark.parametrize("size", [1, 3, 100])
def test_documents_come_back_from_a_stream(monkeypatch, size):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(alignment, "NUMBERS", 4)
    blocks = {7: ([1, 2, 3], [(10, [0, 2, 0]), (11, []), (None, [1] * 6)]), 8: ([], [(12, [])]), 9: ([5], [(13, [0])])}
    rows, expected = [], []
    for block, (values, docs) in blocks.items():
        rows += [dict(block=block, no=k, groups=f"{v}|{v}", id=None, n=None, body=None) | {c: v * 2**33 for c in alignment._SUMS} for k, v in enumerate(values)]
        for doc_id, numbers in docs:
            rows.append(dict(block=block, no=None, groups=None, id=doc_id, n=len(numbers), body=alignment._pack(np.array(numbers, np.uint32)) if numbers else b"") | {c: None for c in alignment._SUMS})
            spelled = ";".join(f"{values[k]}|{values[k]}" for k in numbers)
            expected.append((doc_id, sum(values[k] for k in numbers) * 2**33, hashlib.sha256(spelled.encode()).hexdigest() if numbers else ""))
    kinds = pa.schema([("block", pa.int64()), ("no", pa.int32()), ("groups", pa.string()), ("id", pa.int64()), ("n", pa.int32()), ("body", pa.binary()), *[(c, pa.int64()) for c in alignment._SUMS]])
    drawn = []

    def batches():
        for start in range(0, len(rows), size):
            drawn.append(start)
            yield pa.RecordBatch.from_pylist(rows[start : start + size], kinds)

    out = alignment._document_batches(batches())
    first = next(out)
    assert max(drawn) <= 3  # the first document, not the block's last
    found = [r for b in [first, *out] for r in b.to_pylist()]
    assert [(r["id"], r["count_sum"], r["groups_sha256"]) for r in found] == expected
    assert all(r[c] == r["count_sum"] for r in found for c in alignment._SUMS)


def test_short_texts_are_put_together(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(alignment, "PART", 10)
    texts = ["ab", None, "cd", "ef gh ij", "k", "", "l" * 30, "m"]
    out = list(alignment._gathered(pa.RecordBatch.from_arrays([pa.array([k]), pa.array([t], pa.string())], names=["id", "text"]) for k, t in enumerate(texts)))
    assert [b.column(0).to_pylist() for b in out] == [[0, 1, 2], [3, 4, 5], [6], [7]]
    assert [t for b in out for t in b.column(1).to_pylist()] == texts
