"""Vector expressions: L2 normalisation and cosine as inner product, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The inner product, summed in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def l2_normalise(v: Column) -> Column:
    """v over its norm, which counts as 1e-10 at least; a zero vector stays zero."""
    n = F.greatest(norm(v), F.lit(1e-10))
    return F.transform(v, lambda x: x.cast("double") / n)
