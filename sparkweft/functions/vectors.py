"""Row-wise vector functions on ``array<float>`` columns, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkweft.functions.binding import let

METHODS = ("cosine", "dot", "euclidean")


def check_method(method: str) -> str:
    if method not in METHODS:
        raise ValueError(f"unknown similarity method {method!r}; use one of {METHODS}")
    return method


def dimension(vector: Column) -> Column:
    """Number of components; NULL for a NULL vector."""
    return F.when(vector.isNotNull(), F.size(vector))


def dot(left: Column, right: Column) -> Column:
    """Dot product; NULL when the dimensions differ."""
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    total = F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(left) == F.size(right), total)


def euclidean(left: Column, right: Column) -> Column:
    """Distance; NULL when the dimensions differ."""
    squares = F.zip_with(left, right, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    total = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))
    return F.when(F.size(left) == F.size(right), total)


def similarity(left: Column, right: Column, method: str = "cosine") -> Column:
    """Cosine and dot are the dot product (vectors of unit length); euclidean is the distance."""
    return euclidean(left, right) if check_method(method) == "euclidean" else dot(left, right)


def norm(vector: Column) -> Column:
    """Length of the vector."""
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def unit(vector: Column) -> Column:
    """Vector scaled to length one; NULL for a zero vector."""
    return let(
        norm(vector),
        lambda size: F.when(size > 0, F.transform(vector, lambda x: (x.cast("double") / size).cast("float"))),
    )
