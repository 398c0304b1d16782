"""Arithmetic on ARRAY<DOUBLE> columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def finite(x: Column) -> Column:
    """True for a real number; NULL, NaN and both infinities are False.

    Spark orders NaN above every number, so comparisons must not see one.
    """
    return F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(INF)), F.lit(False))


def all_finite(a: Column) -> Column:
    return F.coalesce(F.forall(a, finite), F.lit(False))


def first_non_finite(a: Column) -> Column:
    """Zero-based index of the first element that is not a number, else NULL."""
    pos = F.array_position(F.transform(a, lambda x: ~finite(x)), True)
    return F.when(pos > 0, pos - 1).cast("bigint")


def sq_dist(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v
    )


def sq_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v)


def axpy(a: Column, s: Column | float, b: Column) -> Column:
    """``a + s * b`` element by element."""
    factor = s if isinstance(s, Column) else F.lit(float(s))
    return F.zip_with(a, b, lambda x, y: x + factor * y)


def scale(a: Column, s: Column | float) -> Column:
    factor = s if isinstance(s, Column) else F.lit(float(s))
    return F.transform(a, lambda x: factor * x)


def literal_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def log_loss(y: Column, p: Column, eps: float = 1e-12) -> Column:
    """Logistic loss with the probability kept inside [eps, 1 - eps]."""
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))
    return -(y * F.log(q) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - q))


def shape_size(shape: Column) -> Column:
    """Number of elements a shape describes; an empty shape is a scalar."""
    return F.aggregate(shape, F.lit(1).cast("bigint"), lambda s, n: s * n.cast("bigint"))
