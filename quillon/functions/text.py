"""Text expressions: case folding, tokens, words, trimming, name matching."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Characters that Python calls white space, as the inside of a regular expression class (fixed value; Java and RE2 syntax).
SPACE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The same characters as a string.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: A token: letters, digits and underscores, with inner apostrophes.
TOKEN = r"[\p{L}\p{N}_]+(?:['’][\p{L}\p{N}_]+)*"
_DRIVER_TOKEN = re.compile(r"\w+(?:['’]\w+)*")


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, list[tuple[str, str]]]:
    """What case folding changes in lower-case text: one-to-one letters as two strings, and the letters that expand."""
    source, target, longer = [], [], []
    for point in range(0x30000):
        c = chr(point)
        folded = c.casefold()
        if folded != c and c.lower() == c:
            if len(folded) == 1:
                source.append(c)
                target.append(folded)
            else:
                longer.append((c, folded))
    return "".join(source), "".join(target), longer


@lru_cache(maxsize=1)
def _rare_class() -> str:
    """A class of few ranges that has all letters the tables change (but the sharp s), and some others: it only opens the slow path."""
    ranges: list[list[int]] = []
    source, _, longer = _fold_tables()
    for point in sorted(ord(a) for a in (*source, *[a for a, _ in longer]) if a != "ß"):
        if ranges and point - ranges[-1][1] <= 64:
            ranges[-1][1] = point
        else:
            ranges.append([point, point])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


def fold(text: Column) -> Column:
    """Full case folding. Beyond lower case and the sharp s, tables are only applied to texts that may need them."""
    source, target, longer = _fold_tables()
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in longer])
    lower = F.lower(text)
    whole = F.aggregate(pairs, F.translate(lower, source, target), lambda acc, p: F.replace(acc, p["a"], p["b"]))
    return F.when(lower.rlike(_rare_class()), whole).otherwise(F.replace(lower, F.lit("ß"), F.lit("ss")))


def tokens(text: Column) -> Column:
    """Case-folded tokens in order (an array; null for null)."""
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))


@lru_cache(maxsize=1)
def token_letters() -> bytes:
    """For each code point a byte, 1 if the engine takes it for a letter of a token: what :func:`tokens` cuts by, for tasks that cut many texts at once."""
    points = np.setdiff1d(np.arange(0x110000, dtype="<u4"), np.arange(0xD800, 0xE000, dtype="<u4"))
    found = SparkSession.active().range(1).select(F.regexp_extract_all(F.lit(points.tobytes().decode("utf-32-le")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)).alias("runs")).first()["runs"]
    table = np.zeros(0x110000, np.uint8)
    for run in found:
        table[ord(run[0]) : ord(run[-1]) + 1] = 1
    table[0xD800:0xE000] = 0
    return table.tobytes()


def cut_tokens(folded: list[str], letters: np.ndarray) -> tuple[np.ndarray, pa.StringArray]:
    """The tokens of folded texts, in order, and of each the place of its text; as :func:`tokens`, of which this is the same for a batch."""
    points = np.frombuffer("\n".join([*folded, ""]).encode("utf-32-le", "replace"), "<u4")
    inside = letters[points].astype(bool)
    quote = np.flatnonzero((points == 0x27) | (points == 0x2019))
    quote = quote[(quote > 0)]
    quote = quote[inside[quote - 1] & inside[quote + 1]]  # a line end is the last
    inside[quote] = True
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
    starts, ends = edges[::2], edges[1::2]
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in folded]), starts, "right")
    kept = points[inside]
    width = np.cumsum(1 + (kept >= 0x80).view(np.int8) + (kept >= 0x800).view(np.int8) + (kept >= 0x10000).view(np.int8), dtype=np.int64)
    offsets = np.append(0, width[np.cumsum(ends - starts) - 1]).astype(np.int32)
    return text, pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(kept.tobytes().decode("utf-32-le").encode()))


def query_tokens(text: str) -> list[str]:
    """Tokens of a query on the driver, each once, in order of appearance."""
    return list(dict.fromkeys(x.casefold() for x in _DRIVER_TOKEN.findall(text)))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(SPACES))


def _spaced(text: Column) -> Column:
    """With each white space as a plain one: a class of one character is matched many times faster than that of all."""
    return F.translate(text, SPACES, " " * len(SPACES))


def words(text: Column) -> Column:
    """Words between white space, as an array."""
    return F.regexp_extract_all(_spaced(text), F.lit("[^ ]+"), F.lit(0))


def word_count(text: Column) -> Column:
    """Words between white space, at least one."""
    return F.greatest(F.lit(1), F.coalesce(F.regexp_count(_spaced(text), F.lit("[^ ]+")), F.lit(0)))


def squeeze(text: Column) -> Column:
    """Folded, with single spaces: the form in which names are compared."""
    return F.array_join(words(fold(text)), " ")


def name_tier(name: Column, query: str) -> Column:
    """How a name answers a query: struct(tier, overlap) with tier 0 equal, 1 prefix, 2 inside, 3 common tokens (overlap
    is their negative number), null if not at all."""
    wanted = " ".join(query.casefold().split())
    own, asked = squeeze(name), F.array(*[F.lit(t) for t in query_tokens(query)])
    common = F.size(F.array_intersect(asked, tokens(name))) if query_tokens(query) else F.lit(0)
    pair = lambda tier, overlap: F.struct(F.lit(tier).alias("tier"), overlap.cast("int").alias("overlap"))
    return (
        F.when(own == wanted, pair(0, F.lit(0))).when(own.startswith(wanted), pair(1, F.lit(0))).when(F.contains(own, F.lit(wanted)), pair(2, F.lit(0)))
        .when(common > 0, pair(3, -common))
    )


def cue_text(text: Column) -> Column:
    """Lines stripped, blank ones dropped, joined by spaces. Text with a NUL, or without any line, is an error."""
    one, plain = strip(text), ~F.contains(text, F.lit("\r"))
    lines = F.split(F.when(plain, text).otherwise(F.regexp_replace(text, r"\r\n|\r", "\n")), "\n")
    kept = F.filter(F.transform(lines, strip), lambda x: x != "")
    joined = F.when(plain & ~F.contains(text, F.lit("\n")), one).otherwise(F.array_join(kept, " "))
    bad = F.contains(text, F.lit("\x00")) | (one == "")
    return F.when(bad, F.raise_error(F.lit("text cannot be exported"))).otherwise(joined)


def speaker_text(text: Column, speaker_ref: Column) -> Column:
    return F.when(speaker_ref.isNull(), cue_text(text)).otherwise(F.concat(F.lit("["), speaker_ref, F.lit("] "), cue_text(text)))


def display_name(label: Column, speaker_ref: Column) -> Column:
    return F.when(label.isNotNull(), F.concat(label, F.lit(" ("), speaker_ref, F.lit(")"))).otherwise(speaker_ref)


def label_is_valid(label: Column) -> Column:
    """At most 200 characters, trimmed, not empty, no line ends and no NUL."""
    return label.isNotNull() & (F.length(label) > 0) & (F.length(label) <= 200) & (strip(label) == label) & ~label.rlike(r"[\r\n\x00]")


def file_name(text: Column) -> Column:
    """Letters, digits and ``._-() `` stay, anything else becomes ``_``; trailing spaces and dots go, reserved names get a ``_``."""
    clean = F.regexp_replace(text, r"[^\p{L}\p{N} ._\-()]", "_")
    cut = F.rtrim(clean, F.lit(" ."))
    cut = F.when(cut == "", "_").otherwise(cut)
    reserved = F.upper(F.regexp_replace(cut, r"(?<=.)\.[^.]*$", "")).rlike(r"^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$")
    named = F.when(reserved, F.concat(F.lit("_"), cut)).otherwise(cut)
    return F.when(clean.isin("", ".", ".."), F.repeat(F.lit("_"), F.greatest(F.lit(1), F.length(clean)))).otherwise(named)
