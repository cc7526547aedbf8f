"""Removing repeats with a defined survivor.

All of these are plain aggregations, so a key with very many rows shrinks before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_rows(df: DataFrame) -> DataFrame:
    """Distinct rows."""
    return df.distinct()


def _rest(df: DataFrame, keys: Sequence[str]) -> list[str]:
    return [name for name in df.columns if name not in keys]


def keep_first(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], copies: str | None = None) -> DataFrame:
    """First row of each key by the order columns. ``copies`` names a column for the number of rows of the key."""
    row = F.struct(*order_by, *[c for c in _rest(df, keys) if c not in order_by])
    counts = [F.count(F.lit(1)).alias(copies)] if copies else []
    first = df.groupBy(*keys).agg(F.min_by(row, F.struct(*order_by)).alias("__row"), *counts)
    return first.select(
        *[F.col(c) if c in keys else F.col("__row")[c].alias(c) for c in df.columns],
        *([F.col(copies)] if copies else []),
    )


def keep_last(df: DataFrame, key: Column, order: str, position: str = "first_position") -> DataFrame:
    """Last row of each key, at the place where the key first occurred.

    NULL is one key. ``position`` holds the order value of the key's first row; sort by it for the output order.
    """
    row = F.struct(*df.columns)
    last = df.groupBy(key.alias("__key")).agg(
        F.max_by(row, F.col(order)).alias("__row"), F.min(order).alias(position)
    )
    return last.select("__row.*", position)


def ordered_distinct(df: DataFrame, columns: Sequence[str], order: str, position: str = "first_position") -> DataFrame:
    """Distinct values with the order value of their first occurrence."""
    return df.groupBy(*columns).agg(F.min(order).alias(position))
