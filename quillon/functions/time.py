"""Time expressions: source-relative seconds as text and as milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _exact(seconds: Column) -> Column:
    """Milliseconds as a decimal, from the shortest text of the number, so that 83.456 stays 83456."""
    return seconds.cast("string").cast("decimal(20,9)") * 1000


def milliseconds(seconds: Column, rounding: str = "half_up") -> Column:
    """rounding: half_up, floor or ceil."""
    value = _exact(seconds)
    return {"half_up": F.round(value, 0), "floor": F.floor(value), "ceil": F.ceil(value)}[rounding].cast("long")


def clock(ms: Column, separator: str = ".") -> Column:
    """HH:MM:SS and milliseconds; hours are not wrapped."""
    part = lambda per, mod: F.floor(ms / per) % mod if mod else F.floor(ms / per)
    return F.format_string(f"%02d:%02d:%02d{separator}%03d", part(3_600_000, 0), part(60_000, 60), part(1000, 60), ms % 1000)


def elapsed(seconds: Column) -> Column:
    return clock(milliseconds(seconds))


def cue_time(seconds: Column, separator: str, end: bool = False) -> Column:
    """A cue never starts after its text nor ends before it."""
    return clock(milliseconds(seconds, "ceil" if end else "floor"), separator)


def short_clock(seconds: Column) -> Column:
    """M:SS, or H:MM:SS from one hour on."""
    s = F.floor(seconds).cast("long")
    hours, minutes, rest = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, rest)).otherwise(F.format_string("%d:%02d", minutes, rest))


def frames_to_seconds(frames: Column, rate: Column) -> Column:
    return frames / rate


def overlap_seconds(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(end, other_end) - F.greatest(start, other_start))
