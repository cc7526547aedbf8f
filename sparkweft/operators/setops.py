"""Set operations on lists of names and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sparkweft.operators.rows import drop_blank


def union_names(*frames: DataFrame) -> DataFrame:
    """Distinct rows of all frames."""
    if not frames:
        raise ValueError("at least one frame is needed")
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.union(frame)
    return merged.distinct()


def common_lines(left: DataFrame, right: DataFrame, value: str = "value") -> DataFrame:
    """Trimmed non-blank lines found on both sides, sorted."""
    return drop_blank(left.select(value), value).intersect(drop_blank(right.select(value), value)).orderBy(value)


def missing_names(names: DataFrame, known: DataFrame) -> DataFrame:
    """Names that are not known, sorted."""
    return names.subtract(known).orderBy(*names.columns)
