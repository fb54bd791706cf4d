"""Vector columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(v: Column) -> Column:
    """At length one; a zero vector stays as it is. The length is taken once, not for every number."""
    scaled = lambda n: F.transform(v, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"), lambda s: scaled(F.sqrt(s)))


def rounded(x: Column, digits: int) -> Column:
    """`x` rounded, where a negative number that becomes zero stays a negative zero, as floating-point rounding has it."""
    short = F.round(x, digits)
    return F.when(short == 0, x * 0.0).otherwise(short)


def checked(v: Column, size: int) -> Column:
    """The vector, or an error if it has another size."""
    return F.when(F.size(v) == size, v).otherwise(F.raise_error(F.concat(F.lit(f"expected {size} dimensions, found "), F.size(v))))
