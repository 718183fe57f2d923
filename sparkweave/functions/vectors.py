"""Distances between vectors as expressions; smaller is nearer for all of them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "l2", "dot")

#: The distance of vectors of different lengths: the largest 32-bit float.
MISMATCH = 3.4028234663852886e38


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def distance(a: Column, b: Column | Sequence[float], metric: str = "cosine") -> Column:
    """1 - cosine, Euclidean distance, or the negated inner product."""
    constant = None if isinstance(b, Column) else [float(v) for v in b]
    other = b if constant is None else literal(constant)
    if metric == "cosine":
        length = norm(other) if constant is None else F.lit(math.sqrt(sum(v * v for v in constant)))
        value = 1 - F.try_divide(dot_product(a, other), norm(a) * length)
    elif metric == "l2":
        value = F.sqrt(F.aggregate(F.zip_with(a, other, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))
    elif metric == "dot":
        value = -dot_product(a, other)
    else:
        raise ValueError(f"metric must be one of {METRICS}")
    return F.when(F.size(a) == F.size(other), value).otherwise(F.lit(MISMATCH))
