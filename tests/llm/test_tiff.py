from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import queries, tiff

from .helpers import awkward, empty


@given(st.binary(max_size=5000))
@settings(max_examples=60, deadline=None)
def test_codecs_round_trip(data):
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data
    assert tiff.packbits_decode(tiff.packbits_encode(data), len(data)) == data


@pytest.mark.parametrize("n", [1, 253, 254, 255, 3836, 3837, 3838, 20_000])
def test_lzw_at_the_width_changes(n):
    data = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    assert tiff.lzw_decode(tiff.lzw_encode(data), n) == data


def test_lzw_stops_at_the_size():
    import tracemalloc

    raw = tiff.lzw_encode(bytes(3_000_000))
    tracemalloc.start()
    assert tiff.lzw_decode(raw, 10) == bytes(10)
    assert tracemalloc.get_traced_memory()[1] < 1_000_000
    tracemalloc.stop()


def test_known_streams():
    assert tiff.packbits_decode(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA"), 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    # Clear, 7, 258, 8, 8, 258, 6, 6, End in nine bits each
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    assert tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8))


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("order", ["<", ">"])
def test_files_round_trip(compression, predictor, tile, order):
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, 99, shape).astype(kind) for kind in ("u1", "u2", "i4") for shape in ((5, 7, 1), (70, 33, 3))]
    found = list(tiff.read(tiff.write(pages, compression, predictor, tile, 16, order)))
    assert [e for _, e in found] == [None] * len(pages)
    assert all((p.samples == q).all() and p.samples.dtype == q.dtype for (p, _), q in zip(found, pages, strict=True))


def test_floating_predictor_and_bilevel_and_planes():
    values = np.array([[1.5, -2.25, 3e7], [0.0, 1e-9, 7.0]], dtype=np.float32)
    planes = values.astype(">f4").view(np.uint8).reshape(2, 3, 4).transpose(0, 2, 1).reshape(2, 12)
    coded = np.diff(planes, axis=1, prepend=0).astype(np.uint8)
    assert (tiff._unpredicted(coded.view("<f4").reshape(2, 3, 1), 3, True)[:, :, 0].astype("f4") == values).all()

    def file(entries, payload):
        head = b"II*\0" + struct.pack("<I", 8 + len(payload)) + payload
        return head + struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", t, 3 if t != 273 and t != 279 else 4, 1, v) for t, v in entries) + b"\0\0\0\0"

    bits = file([(256, 10), (257, 2), (258, 1), (259, 1), (262, 1), (273, 8), (277, 1), (278, 2), (279, 4)], bytes([0b10110000, 0b01000000, 0b11111111, 0b11000000]))
    ((page, error),) = tiff.read(bits)
    assert error is None
    assert page.samples[:, :, 0].tolist() == [[1, 0, 1, 1, 0, 0, 0, 0, 0, 1], [1] * 10]


def test_damage_is_reported_and_ends():
    good = tiff.write([np.zeros((4, 4, 1), dtype=np.uint8)] * 2, tiff.LZW)
    for raw in (b"", b"II", b"GIF89a" * 9, good[:20], good[:-10]):
        found = list(tiff.read(raw))
        assert found
        assert found[-1][1]
    (first,) = struct.unpack_from("<I", good, 4)
    (n,) = struct.unpack_from("<H", good, first)
    loop = bytearray(good)
    struct.pack_into("<I", loop, first + 2 + 12 * n, first)
    assert list(tiff.read(bytes(loop)))[-1] == (None, "directories form a loop")
    huge = bytearray(good)
    at = good.index(struct.pack("<HHI", 256, 4, 1), first)
    struct.pack_into("<I", huge, at + 8, 1 << 31)
    assert "too large" in list(tiff.read(bytes(huge)))[0][1]


def test_one_row_per_page(spark):
    a = tiff.write([np.full((2, 3, 1), k, dtype=np.uint8) for k in range(3)], tiff.PACKBITS)
    df = spark.createDataFrame([(1, bytearray(a), "x"), (2, bytearray(b"no"), "y"), (3, None, "z"), (1, bytearray(a), "x")], "id long, media binary, other string")
    rows = tiff.pages(df, "media", ["id"]).collect()
    assert sorted((r["id"], r["page"], r["n_pages"], bytes(r["pixels"] or b"")) for r in rows) == sorted([(1, k, 3, bytes([k] * 6)) for k in range(3)] * 2 + [(2, 0, 1, b"")])
    assert {r["error"] for r in rows if r["id"] == 2} == {"not a TIFF file"}


def test_documents_as_media(spark, tmp_path):
    docs = awkward(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op1_tiff_media(spark, str(tmp_path)).collect()
    assert len(got) == docs.count()
    expected = []
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        padded = raw + b" " * (-len(raw) % 192 or 192 * (not raw))
        expected.append((r["doc_id"], len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:])))
    assert sorted(((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got), key=lambda x: (x[0] is None, x[0] or 0, x[3])) == sorted(expected, key=lambda x: (x[0] is None, x[0] or 0, x[3]))
    assert {r["error"] for r in got} == {None}
    by = {}
    for r in got:
        by.setdefault(r["payload_sha256"], set()).add((r["media_sha256"], r["feature"], r["media_bytes"]))
    assert all(len(v) == 1 for v in by.values())


def test_empty_table(spark):
    assert tiff.pages(tiff.media_column(empty(spark), "text", ["doc_id"]), "media", ["doc_id"]).count() == 0
