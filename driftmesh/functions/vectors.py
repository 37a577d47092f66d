"""Vector arithmetic over ARRAY<DOUBLE> columns, with higher-order functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda t, x: t + x * x))


def minus(a, b) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def axpy(scale, a, b) -> Column:
    """scale * a + b"""
    return F.zip_with(a, b, lambda x, y: F.lit(scale) * x + y)


def distance(a, b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x))


def project(own, other, radius) -> Column:
    """From own towards other, by at most radius; own itself if they are equal."""
    d = distance(own, other)
    step = F.when(d > 0, F.least(F.lit(1.0), F.lit(radius) / d)).otherwise(F.lit(0.0))
    return F.zip_with(own, other, lambda x, y: x + step * (y - x))


def argmax(a) -> Column:
    """Position of the largest value from 0; the first one among equals."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def long_form(df: DataFrame, vector: str, *keys: str, c: str = "c", v: str = "v") -> DataFrame:
    """A row for each coordinate."""
    return df.select(*keys, F.posexplode(vector).alias(c, v))


def wide_form(df: DataFrame, *keys: str, c: str = "c", v: str = "v", out: str = "x") -> DataFrame:
    """The vector of each key's coordinates, in their order."""
    pairs = F.sort_array(F.collect_list(F.struct(c, v)))
    return df.groupBy(*keys).agg(F.transform(pairs, lambda p: p[v]).alias(out))


def tidy(x, digits: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(x, digits) + F.lit(0.0)
