"""Media columns: TIFF files held in a binary column, read into one row per page.

Reading walks the chain of image directories (classic and big files, either byte order), decodes the strips or
tiles of each page (stored, PackBits, LZW, deflate), undoes horizontal and floating-point prediction and returns the
samples of the page in row order. Writing makes such files from arrays, so that a column can be stored losslessly.
Each file is read where its row lies: nothing is shuffled, and a batch holds a bounded number of bytes.
"""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: tags, and the size and struct code of each field type.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, FILL_ORDER = 256, 257, 258, 259, 262, 266
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_SIZES, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES, SAMPLE_FORMAT = 322, 323, 324, 325, 339
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
CLEAR, END = 256, 257

#: A page may declare at most this many bytes of samples: a damaged header must not claim all memory.
MOST_BYTES = 1 << 31
#: Bytes of media that one batch of results is made from.
BATCH_BYTES = 8 << 20
#: Pixels in a row of a stored payload, of three 8-bit samples each: 192 bytes.
ROW_PIXELS, ROW_BYTES = 64, 192
_RUN = re.compile(rb"(.)\1{2,127}", re.S)


# ---- codecs


def packbits_encode(row: bytes) -> bytes:
    """One row: runs of three and more as repeats, what lies between as literals of up to 128 bytes."""
    out, at = [], 0
    for m in [*_RUN.finditer(row), None]:
        until = m.start() if m else len(row)
        for k in range(at, until, 128):
            part = row[k : min(k + 128, until)]
            out += (bytes((len(part) - 1,)), part)
        if m:
            out += (bytes((257 - (m.end() - m.start()),)), m[1])
            at = m.end()
    return b"".join(out)


def packbits_decode(raw: bytes, size: int) -> bytes:
    out, at, have = [], 0, 0
    while have < size:
        n = raw[at]
        if n < 128:
            part = raw[at + 1 : at + 2 + n]
            at += 2 + n
            if len(part) != n + 1:
                raise ValueError("PackBits data ends early")
        elif n > 128:
            part = raw[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
            continue
        out.append(part)
        have += len(part)
    return b"".join(out)


def _widths(n: int) -> np.ndarray:
    """Bits of the first n codes after a clear code; a code gets wider one entry early."""
    return np.where(np.arange(n) < 254, 9, np.where(np.arange(n) < 766, 10, np.where(np.arange(n) < 1790, 11, 12)))


_CYCLE = _widths(4096)


def lzw_encode(data: bytes) -> bytes:
    """Codes from the highest bit down, the table cleared before it is full."""
    codes, runs, table, free = [CLEAR], [], {}, 258
    begun = 1
    word = -1
    for c in data:
        if word < 0:
            word = c
            continue
        found = table.get(word << 8 | c)
        if found is not None:
            word = found
            continue
        codes.append(word)
        table[word << 8 | c] = free
        free += 1
        word = c
        if free == 4094:
            codes.append(CLEAR)
            runs.append(len(codes) - begun)
            begun, free = len(codes), 258
            table.clear()
    if word >= 0:
        codes.append(word)
    codes.append(END)
    runs.append(len(codes) - begun)
    widths = np.concatenate([[9], *[_CYCLE[:n] for n in runs]])
    values = np.array(codes, dtype=np.uint32) << (32 - widths).astype(np.uint32)
    bits = np.unpackbits(values.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, :12]
    return np.packbits(bits[np.arange(12) < widths[:, None]]).tobytes()


def _lzw_codes(raw: bytes):
    """Codes in lists; each list follows a clear code and ends before the next one, or before the end."""
    bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8))
    at, held = 0, []
    for_width = {w: 1 << np.arange(w - 1, -1, -1) for w in (9, 10, 11, 12)}
    place = 0
    while True:
        width, last = (9, 254) if place < 254 else (10, 766) if place < 766 else (11, 1790) if place < 1790 else (12, 4096)
        n = min((len(bits) - at) // width, last - place)
        if n <= 0:
            yield held
            return
        codes = bits[at : at + n * width].reshape(n, width) @ for_width[width]
        stop = np.flatnonzero((codes == CLEAR) | (codes == END))
        if len(stop):
            held += codes[: stop[0]].tolist()
            yield held
            if codes[stop[0]] == END:
                return
            at, place, held = at + (int(stop[0]) + 1) * width, 0, []
        else:
            held += codes.tolist()
            at, place = at + n * width, place + n


_LETTERS = [bytes((i,)) for i in range(256)] + [b"", b""]


def lzw_decode(raw: bytes, size: int) -> bytes:
    """At most ``size`` bytes; what a strip would expand to beyond them is not made."""
    out, have = [], 0
    for codes in _lzw_codes(raw):
        if not codes:
            continue
        table = _LETTERS.copy()
        if codes[0] > 255:
            raise ValueError("bad LZW code")
        before = table[codes[0]]
        out.append(before)
        have += 1
        for code in codes[1:]:
            if have >= size:
                return b"".join(out)[:size]
            if code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = before + before[:1]
            else:
                raise ValueError("bad LZW code")
            table.append(before + entry[:1])
            out.append(entry)
            have += len(entry)
            before = entry
    return b"".join(out)[:size]


def decode(raw: bytes, compression: int, size: int) -> bytes:
    """The ``size`` bytes of one strip or tile."""
    if compression == NONE:
        out = raw[:size]
    elif compression == PACKBITS:
        out = packbits_decode(raw, size)[:size]
    elif compression == LZW:
        out = lzw_decode(raw, size)
    elif compression in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompressobj().decompress(raw, size)
    else:
        raise ValueError(f"compression {compression} is not supported")
    if len(out) < size:
        raise ValueError(f"{len(out)} of {size} bytes in a strip or tile")
    return out


# ---- reading


@dataclass
class Page:
    """Samples: height x width x samples, in the machine's byte order."""

    samples: np.ndarray
    compression: int
    predictor: int
    tiled: bool
    photometric: int


def _fields(data: bytes, at: int, order: str, big: bool) -> tuple[dict[int, tuple], int]:
    """The entries of the directory at this offset, and the offset of the next."""
    count_code, entry, slot, offset_code = ("Q", 20, 8, "Q") if big else ("H", 12, 4, "I")
    (n,) = struct.unpack_from(order + count_code, data, at)
    at += struct.calcsize(count_code)
    found = {}
    for k in range(n):
        start = at + k * entry
        tag, kind, count = struct.unpack_from(order + ("HHQ" if big else "HHI"), data, start)
        code = TYPES.get(kind)
        if code is None:
            continue
        size = struct.calcsize("<" + code) * count
        where = start + entry - slot
        if size > slot:
            (where,) = struct.unpack_from(order + offset_code, data, where)
        if size > len(data):
            raise ValueError("a field is longer than the file")
        found[tag] = struct.unpack_from(f"{order}{count}s" if code == "s" else order + code * count, data, where)
    (following,) = struct.unpack_from(order + offset_code, data, at + n * entry)
    return found, following


def _unpredicted(block: np.ndarray, predictor: int, floating: bool) -> np.ndarray:
    """block: rows x columns x samples."""
    if predictor == 1:
        return block
    if predictor == 2 and not floating:
        return np.cumsum(block, axis=1, dtype=block.dtype)
    if predictor == 3 and floating:
        rows, columns, samples = block.shape
        size = block.dtype.itemsize
        raw = np.ascontiguousarray(block).view(np.uint8).reshape(rows, columns * size, samples)
        planes = np.cumsum(raw.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, size, columns * samples)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">f{size}").reshape(rows, columns, samples)
    raise ValueError(f"predictor {predictor} is not supported for these samples")


def _page(data: bytes, f: dict[int, tuple], order: str) -> Page:
    one = lambda tag, default=None: f[tag][0] if tag in f else default
    width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    if not width or not height:
        raise ValueError("a page without width or height")
    bits = set(f.get(BITS, (1,)))
    compression, predictor, planar, form = one(COMPRESSION, NONE), one(PREDICTOR, 1), one(PLANAR, 1), one(SAMPLE_FORMAT, 1)
    if len(bits) != 1:
        raise ValueError("samples of several sizes")
    (depth,) = bits
    if depth not in (1, 2, 4, 8, 16, 32, 64) or (form == 3 and depth < 32):
        raise ValueError(f"samples of {depth} bits are not supported")
    kind = np.dtype(order + {1: "u", 2: "i", 3: "f"}.get(form, "u") + str(max(1, depth // 8)))
    if width * height * samples * kind.itemsize > MOST_BYTES:
        raise ValueError("the page is too large")
    tiled = TILE_OFFSETS in f
    across, down = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(height, one(ROWS_PER_STRIP, height) or height))
    offsets, sizes = f[TILE_OFFSETS if tiled else STRIP_OFFSETS], f.get(TILE_SIZES if tiled else STRIP_SIZES)
    deep = samples if planar == 1 else 1
    columns, rows = -(-width // across), -(-height // down)
    if len(offsets) < columns * rows * (samples if planar == 2 else 1):
        raise ValueError("strips or tiles are missing")
    sizes = sizes or [len(data) - o for o in offsets]
    out = np.zeros((height, width, samples), dtype=kind)
    line = -(-across * deep * depth // 8)
    for k in range(columns * rows * (samples if planar == 2 else 1)):
        plane, place = divmod(k, columns * rows)
        top, left = place // columns * down, place % columns * across
        high = down if tiled else min(down, height - top)
        raw = data[offsets[k] : offsets[k] + sizes[k]]
        if one(FILL_ORDER, 1) == 2:
            raw = np.packbits(np.unpackbits(np.frombuffer(raw, dtype=np.uint8)).reshape(-1, 8)[:, ::-1]).tobytes()
        raw = np.frombuffer(decode(raw, compression, high * line), dtype=np.uint8).reshape(high, line)
        if depth < 8:
            parts = np.unpackbits(raw, axis=1).reshape(high, -1, depth) @ (1 << np.arange(depth - 1, -1, -1))
            block = parts[:, : across * deep].astype(np.uint8).reshape(high, across, deep)
        else:
            block = raw.view(kind).reshape(high, across, deep)
        if predictor > 1 and depth < 8:
            raise ValueError("prediction of samples below 8 bits")
        block = _unpredicted(block, predictor, form == 3)
        block = block[: height - top, : width - left]
        out[top : top + block.shape[0], left : left + block.shape[1], plane if planar == 2 else slice(None)] = block[:, :, 0] if planar == 2 else block
    return Page(out.astype(kind.newbyteorder("=")), compression, predictor, tiled, one(PHOTOMETRIC, 1))


def read(data: bytes):
    """(page or None, what is wrong with it or None) for every page of a file; a damaged page does not end the walk."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or len(data) < 8:
        yield None, "not a TIFF file"
        return
    (version,) = struct.unpack_from(order + "H", data, 2)
    if version not in (42, 43):
        yield None, "not a TIFF file"
        return
    seen: set[int] = set()
    try:
        (at,) = struct.unpack_from(order + ("I" if version == 42 else "Q"), data, 4 if version == 42 else 8)
    except struct.error:
        at = 0
    while at and at not in seen:
        seen.add(at)
        try:
            fields, at = _fields(data, at, order, version == 43)
        except (struct.error, ValueError, MemoryError) as e:
            yield None, f"bad directory: {e}"
            return
        try:
            yield _page(data, fields, order), None
        except (struct.error, ValueError, IndexError, KeyError, TypeError, zlib.error) as e:
            yield None, f"bad page: {e}"
    if at in seen and at:
        yield None, "directories form a loop"
    elif not seen:
        yield None, "no page"


# ---- writing


def _predicted(block: np.ndarray, predictor: int) -> np.ndarray:
    if predictor == 1:
        return block
    out = block.copy()
    out[:, 1:] = block[:, 1:] - block[:, :-1]
    return out


def _encoded(block: np.ndarray, compression: int, level: int) -> bytes:
    if compression == PACKBITS:
        return b"".join([packbits_encode(row.tobytes()) for row in block])
    raw = block.tobytes()
    return lzw_encode(raw) if compression == LZW else zlib.compress(raw, level) if compression == DEFLATE else raw


def write(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: tuple[int, int] | None = None, rows_per_strip: int = 256, order: str = "<", level: int = 6) -> bytes:
    """A classic file of integer pages (height x width x samples). predictor: 1 or 2; tile: (rows, columns), multiples of 16."""
    out = bytearray({"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        height, width, samples = page.shape
        kind = page.dtype.newbyteorder(order)
        depth = page.dtype.itemsize * 8
        if tile:
            down, across = tile
            padded = np.pad(page, ((0, -height % down), (0, -width % across), (0, 0)))
            blocks = [padded[y : y + down, x : x + across] for y in range(0, height, down) for x in range(0, width, across)]
        else:
            blocks = [page[y : y + rows_per_strip] for y in range(0, height, rows_per_strip)]
        offsets, sizes = [], []
        for block in blocks:
            raw = _encoded(_predicted(np.ascontiguousarray(block), predictor).astype(kind), compression, level)
            offsets.append(len(out))
            sizes.append(len(raw))
            out += raw
            out += b"\0" * (len(raw) & 1)
        entries = [
            (WIDTH, "I", [width]), (HEIGHT, "I", [height]), (BITS, "H", [depth] * samples), (COMPRESSION, "H", [compression]),
            (PHOTOMETRIC, "H", [2 if samples == 3 else 1]), (SAMPLES, "H", [samples]), (PLANAR, "H", [1]), (PREDICTOR, "H", [predictor]),
            (SAMPLE_FORMAT, "H", [1 if page.dtype.kind == "u" else 2] * samples),
        ]
        if tile:
            entries += [(TILE_WIDTH, "I", [across]), (TILE_HEIGHT, "I", [down]), (TILE_OFFSETS, "I", offsets), (TILE_SIZES, "I", sizes)]
        else:
            entries += [(STRIP_OFFSETS, "I", offsets), (ROWS_PER_STRIP, "I", [rows_per_strip]), (STRIP_SIZES, "I", sizes)]
        directory = b""
        for tag, code, values in sorted(entries):
            raw = struct.pack(f"{order}{len(values)}{code}", *values)
            directory += struct.pack(order + "HHI", tag, 3 if code == "H" else 4, len(values))
            if len(raw) <= 4:
                directory += raw.ljust(4, b"\0")
            else:
                directory += struct.pack(order + "I", len(out))
                out += raw + b"\0" * (len(raw) & 1)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + directory
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def store(payload: bytes) -> bytes:
    """A payload of a positive multiple of 192 bytes as one page of RGB samples.

    The payload's checksum chooses compression, prediction, layout and byte order, so that equal payloads are stored
    alike and a corpus has files of every kind."""
    page = np.frombuffer(payload, dtype=np.uint8).reshape(-1, ROW_PIXELS, 3)
    kind = zlib.crc32(payload)
    compression = (DEFLATE, LZW, PACKBITS, DEFLATE)[kind & 3]
    tile = (32, 32) if kind >> 4 & 1 and len(page) >= 32 else None
    return write([page], compression, 1 + (kind >> 2 & 1), tile, 64, "<>"[kind >> 3 & 1])


# ---- columns


def _outline(samples: np.ndarray) -> str:
    """Size, mean of each sample, entropy of the bytes, and the average hash of an 8 x 8 reduction, as text."""
    height, width, n = samples.shape
    raw = np.ascontiguousarray(samples).view(np.uint8).ravel()
    shares = np.bincount(raw, minlength=256) / max(1, raw.size)
    entropy = -(shares[shares > 0] * np.log2(shares[shares > 0])).sum()
    rows = np.add.reduceat(samples.sum(2, dtype=np.float64), np.minimum(np.arange(8) * height // 8, height - 1), axis=0)
    grid = np.add.reduceat(rows, np.minimum(np.arange(8) * width // 8, width - 1), axis=1)
    counts = np.diff(np.append(np.arange(8) * height // 8, height)).clip(1)[:, None] * np.diff(np.append(np.arange(8) * width // 8, width)).clip(1)
    grid = grid / counts
    mark = np.packbits(grid.ravel() > grid.mean()).tobytes().hex()
    means = ",".join(f"{m:.3f}" for m in samples.mean((0, 1), dtype=np.float64))
    return f"{width}x{height}x{n};mean={means};entropy={entropy:.4f};hash={mark}"


def _by_size(batches, most: int = BATCH_BYTES):
    """Slices of the batches whose last column holds about ``most`` bytes, a larger value alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy()
        start, held = 0, 0
        for k, n in enumerate(sizes):
            if k > start and held + n > most:
                yield batch.slice(start, k - start)
                start, held = k, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


_PAGE = "page int, n_pages int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, pixels binary, feature string, error string"


def _read_batches(batches):
    for batch in _by_size(batches):
        rows, out = [], []
        for k, media in enumerate(batch.column(batch.num_columns - 1)):
            found = list(read(media.as_py())) if media.is_valid else []
            for n, (page, error) in enumerate(found):
                rows.append(k)
                if page is None:
                    out.append((n, len(found), *[None] * 9, error))
                else:
                    s = page.samples
                    out.append((n, len(found), s.shape[1], s.shape[0], s.shape[2], s.dtype.itemsize * 8, page.compression, page.predictor, page.tiled, s.tobytes(), _outline(s), None))
        kept = [c.take(pa.array(rows, pa.int32())) for c in batch.columns[:-1]]
        types = [pa.int32()] * 8 + [pa.bool_(), pa.binary(), pa.string(), pa.string()]
        columns = list(zip(*out, strict=True)) if out else [[]] * len(types)
        yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=[*batch.schema.names[:-1], *[x.split()[0] for x in _PAGE.split(", ")]])


def _kept(df: DataFrame, keep: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*keep).schema.fields)


def pages(df: DataFrame, media_col: str, keep: list[str]) -> DataFrame:
    """One row per page of every file in ``media_col``: the ``keep`` columns, page (from 0), n_pages, width, height,
    samples, bits, compression, predictor, tiled, pixels (all samples in row order, little-endian), feature, error.

    A file or page that cannot be read is a row with ``error`` and no pixels; a null file has no rows. Repeated rows
    are kept. ``keep`` must not name one of the new columns; other columns are ignored."""
    rows = df.select(*keep, F.col(media_col).alias("__media"))
    return rows.mapInArrow(_read_batches, _kept(rows, keep) + _PAGE)


def _store_batches(batches):
    for batch in _by_size(batches):
        media = [store(x.as_py()) for x in batch.column(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(media, pa.binary())], names=[*batch.schema.names[:-1], "media"])


def payload(text: Column) -> Column:
    """The text's UTF-8 bytes (null: none), with spaces up to a positive multiple of 192 bytes."""
    raw = F.coalesce(text.cast("string").cast("binary"), F.lit(b""))
    size = F.octet_length(raw)
    padded = F.when(size == 0, ROW_BYTES).otherwise(size + F.pmod(-size, F.lit(ROW_BYTES)))
    return F.rpad(raw, padded, F.lit(b" "))


def media_column(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of every row, and ``media``: its padded text as a file. Null texts are empty, repeated rows get equal
    files, an empty table stays empty; ``keep`` must not name media."""
    rows = docs.select(*keep, payload(F.col(text_col)).alias("__payload"))
    return rows.mapInArrow(_store_batches, _kept(rows, keep) + "media binary")
