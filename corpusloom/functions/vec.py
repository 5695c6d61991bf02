"""Vector columns (array<double>): row-local higher-order functions and JVM aggregates, no Python worker.

A null vector gives null; vectors of different lengths give null sums and products.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least length by which a vector is divided; a zero vector stays zero.
EPSILON = 1e-12


def doubles(v: str | Column) -> Column:
    """The vector in double precision."""
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """The inner product."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def length(v: Column) -> Column:
    """The Euclidean length."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is computed once a row, however often and in however many lambdas it is used."""
    return F.transform(F.array(value), use)[0]


def unit(v: Column) -> Column:
    """The vector at length 1."""
    return bound(F.greatest(length(v), F.lit(EPSILON)), lambda n: F.transform(v, lambda x: x / n))


def minus(a: Column, b: Column) -> Column:
    """The difference, element by element."""
    return F.zip_with(a, b, lambda x, y: x - y)


def mean(v: Column) -> Column:
    """Aggregate: the mean vector, summed up partition by partition before the shuffle."""
    return vector_to_array(Summarizer.mean(array_to_vector(v)))


def rounded(v: Column, digits: int = 6) -> Column:
    """Every element rounded, and minus zero made zero."""
    return F.transform(v, lambda x: F.round(x, digits) + F.lit(0.0))
