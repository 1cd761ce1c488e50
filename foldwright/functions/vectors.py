"""Column functions on arrays of numbers; all stay inside generated code."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def is_valid(v: Column) -> Column:
    """Not null, not empty, every entry finite, norm not zero."""
    fine = F.forall(as_double(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & fine & (norm(v) > 0)


def unit(v: Column) -> Column:
    """Scaled to length one; null for vectors that are not valid."""
    return F.when(is_valid(v), F.transform(as_double(v), lambda x: x / norm(v)))


def argmax(p: Column) -> Column:
    """Index from 0 of the largest entry, the first on ties."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def softmax(z: Column) -> Column:
    top = F.array_max(as_double(z))
    e = F.transform(as_double(z), lambda x: F.exp(x - top))
    total = F.aggregate(F.transform(as_double(z), lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def max_abs_diff(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(as_double(a), as_double(b), lambda x, y: F.abs(x - y)))


def concat_vectors(*parts: Column) -> Column:
    return F.concat(*[as_double(p) for p in parts])
