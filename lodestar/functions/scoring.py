"""Vector scores as columns: sums of products in double precision, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("COSINE", "L2")


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def literal(vector) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, a_norm: Column | None = None, b_norm: Column | None = None) -> Column:
    """0 where either vector has no length. Norms that are known spare their sums."""
    n = (norm(a) if a_norm is None else a_norm) * (norm(b) if b_norm is None else b_norm)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def score(metric: str, a: Column, b: Column, a_norm: Column | None = None, b_norm: Column | None = None) -> Column:
    """Higher is better for either metric; a distance is negated, and -0.0 is made 0.0."""
    if metric == "COSINE":
        return cosine(a, b, a_norm, b_norm)
    if metric == "L2":
        return -l2_squared(a, b) + F.lit(0.0)
    raise ValueError(f"metric {metric!r}; one of {METRICS}")
