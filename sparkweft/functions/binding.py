"""Evaluating an expensive expression once where it is needed several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def only_if(value: Column, condition: Callable[[Column], Column]) -> Column:
    """``value`` where the condition holds for it, else NULL; ``value`` is evaluated once per row."""
    return F.get(F.filter(F.array(value), condition), F.lit(0))


def where_once(df: DataFrame, condition: Callable[[Column], Column]) -> DataFrame:
    """Filter on computed columns.

    A plain filter is pushed below the projection that computes its columns, which then runs twice, a heavy cost for
    parsed JSON. The condition gets the row as a struct.
    """
    row = F.struct(*df.columns)
    return df.select(F.explode(F.filter(F.array(row), condition)).alias("__r")).select("__r.*")
