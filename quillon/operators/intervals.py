"""Overlap joins of intervals of mixed length inside a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width of the finest buckets, in the unit of the intervals; each further level is ``GROWTH`` times as wide.
BUCKET, GROWTH = 60.0, 8
#: An interval belongs to the first level whose buckets are this many times as long, so that it and what may begin before it within
#: half a bucket lie in two buckets at most (with a tenth of a bucket to spare for rounding).
ROOM = 2.5
#: No finite double needs a level beyond this one at widths of 1e-3 and more.
LAST_LEVEL = 345


def level(start: Column, end: Column, width: float) -> Column:
    """The level of an interval by its length; 0 for what has no length. Null for null bounds."""
    rises = F.ceil(F.log(float(GROWTH), (end - start) * F.lit(ROOM / width)))
    return F.when(start.isNotNull() & end.isNotNull(), F.coalesce(F.greatest(F.lit(0), F.least(rises, F.lit(LAST_LEVEL))), F.lit(0))).cast("int")


def _bucket(at: Column, where: Column, width: float) -> Column:
    return F.floor(at / (F.lit(width) * F.pow(F.lit(float(GROWTH)), where)))


def placed(rows: DataFrame, bounds: tuple[str, str], others: DataFrame, other_bounds: tuple[str, str], width: float, longer: int, ties: bool) -> DataFrame:
    """``rows`` once for each place where a partner may be: _role, _level, _bucket.

    As the longer one of a pair (role ``longer``) an interval lies in the one or two buckets of its own level in which a partner may begin. As
    the shorter one (role ``1 - longer``) it asks with its begin, in one bucket, each level above its own (its own, too, with ``ties``) that
    ``others`` have. Their levels are one row of at most ``LAST_LEVEL`` + 1 numbers."""
    start, end = (F.col(b) for b in bounds)
    there = others.select(level(*(F.col(b) for b in other_bounds), width).alias("l")).agg(F.array_sort(F.collect_set("l")).alias("_there"))
    own = level(start, end, width)
    wide = F.lit(width) * F.pow(F.lit(float(GROWTH)), F.col("_own"))
    first, last = F.floor((start - wide / 2) / wide), F.floor(F.least(end, start + wide / 2) / wide)
    spot = lambda role, at, bucket: F.struct(F.lit(role).alias("_role"), at.alias("_level"), bucket.cast("long").alias("_bucket"))
    shorter_ones = F.exists("_there", (lambda l: l < F.col("_own")) if ties else (lambda l: l <= F.col("_own")))
    stored = F.when(shorter_ones, F.transform(F.array_distinct(F.array(first, F.greatest(first, last))), lambda b: spot(longer, F.col("_own"), b)))
    asked = F.filter("_there", (lambda l: l >= F.col("_own")) if ties else (lambda l: l > F.col("_own")))
    asking = F.transform(asked, lambda l: spot(1 - longer, l, _bucket(start, l, width)))
    none = F.array().cast("array<struct<_role:int,_level:int,_bucket:bigint>>")
    rows = rows.withColumn("_own", own).filter("_own IS NOT NULL").crossJoin(F.broadcast(there))
    rows = rows.withColumn("_spot", F.explode(F.concat(F.coalesce(stored, none), F.coalesce(asking, none))))
    return rows.withColumns({c: F.col(f"_spot.{c}") for c in ("_role", "_level", "_bucket")}).drop("_own", "_there", "_spot")


def bucket_join(left: DataFrame, right: DataFrame, keys: list[str], left_bounds: tuple[str, str], right_bounds: tuple[str, str], width: float = BUCKET, left_lengths: DataFrame | None = None) -> DataFrame:
    """Pairs with equal keys whose closed intervals may meet, each pair once. It has all pairs that touch or overlap, and others that
    the caller's condition removes.

    Lengths may differ by any factor: an interval takes two buckets of a width like its own and one for each longer level of the other
    side, never one for each stretch of its time. A pair meets where its shorter one begins, at the level of its longer one. An interval
    with a null bound has no partner; one that ends before it begins counts as a point at its begin.

    ``left_lengths``: rows with the same bounds' names and the same lengths as ``left``, where these are cheaper to read than ``left`` itself."""
    one = placed(left, left_bounds, right, right_bounds, width, 1, True)
    two = placed(right, right_bounds, left if left_lengths is None else left_lengths, left_bounds, width, 0, False)
    return one.join(two, [*keys, "_role", "_level", "_bucket"]).drop("_role", "_level", "_bucket")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], left_bounds: tuple[str, str], right_bounds: tuple[str, str], width: float = BUCKET, left_lengths: DataFrame | None = None) -> DataFrame:
    """Pairs with equal keys whose intervals share more than a point.

    Both sides are dealt to buckets, so one long document is many tasks. Interval columns must have different names on
    the two sides."""
    (ls, le), (rs, re) = left_bounds, right_bounds
    return bucket_join(left, right, keys, left_bounds, right_bounds, width, left_lengths).filter(F.least(F.col(le), F.col(re)) > F.greatest(F.col(ls), F.col(rs)))


def contains_point(start: Column, end: Column, at: Column) -> Column:
    """A point belongs to the intervals that end or begin at it, too."""
    return (start <= at) & (at <= end)
