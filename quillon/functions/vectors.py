"""Vector expressions over arrays, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def is_valid(v: Column, dimensions: int, tolerance: float = 1e-4) -> Column:
    """The right size, all numbers finite, length one."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dimensions) & finite & (F.abs(norm(v) - 1) <= tolerance), F.lit(False))


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])
