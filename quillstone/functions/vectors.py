"""Vector expressions over array<float> columns, in double precision and inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(vector: Sequence[float]) -> Column:
    """A query vector as one literal, its numbers rounded to six decimals as in a text literal."""
    return F.array(*[F.lit(round(float(x), 6)) for x in vector])


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is zero or a vector is null; NaN spreads."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)


def negative_inner_product(a: Column, b: Column) -> Column:
    return -dot(a, b)


def knn_score(a: Column, b: Column) -> Column:
    """Cosine on [0, 1]: (1 + cos) / 2."""
    return (1 + cosine(a, b)) / 2


def parse(text: Column) -> Column:
    """`[0.1,0.2]` as array<float>; null where it isn't such a list."""
    return F.from_json(text, "array<float>")


def usable(vector: Column, dim: int) -> Column:
    """Of the dimension, without nulls and NaN, not all zero."""
    return vector.isNotNull() & (F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(vector, lambda x: x != 0)
