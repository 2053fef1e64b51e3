"""Vector columns are ``ARRAY<DOUBLE>``; these are the expressions over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F

# Up to this width a vector sum is one SUM per dimension inside generated code; wider
# vectors go through the MLlib summarizer, which keeps a dense buffer per group.
WIDE = 96


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def squared_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x)


def scaled(a: Column, factor: Column) -> Column:
    return F.transform(a, lambda x: x * factor)


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtracted(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once; a lambda would recompute it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unit(a: Column) -> Column:
    """L2-normalised; the zero vector stays zero."""
    return let(a, lambda v: let(
        F.sqrt(squared_norm(v)), lambda n: F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))))


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def as_doubles(a: Column) -> Column:
    return a.cast("array<double>")


def vector_sum(a: Column, dim: int, weight: Column | None = None) -> Column:
    """Element-wise (weighted) sum of a vector column; combines on the map side."""
    if dim <= WIDE:
        cells = [F.get(a, F.lit(i)) for i in range(dim)]
        return F.array(*[F.sum(c if weight is None else c * weight) for c in cells])
    return vector_to_array(Summarizer.sum(array_to_vector(a if weight is None else scaled(a, weight))))


def cosine_score(user_vec: Column, item_vec: Column, temperature: float = 5.0) -> Column:
    """Temperature times the dot product of unit vectors; 0 where a side is missing."""
    return F.coalesce(dot(unit(user_vec), unit(item_vec)) * temperature, F.lit(0.0))
