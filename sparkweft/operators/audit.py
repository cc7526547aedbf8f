"""Checking datasets for wanted members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkweft.functions.json_text import has_wanted_member
from sparkweft.functions.text import contains_marker

PROBE_LINE = 100


def sample_has_member(lines: DataFrame, sample_lines: int | None = None, value: str = "value") -> bool:
    """Whether a line has a wanted member. All lines are looked at, unless the caller asks for the first ``sample_lines``.

    The sample is taken one partition after the other, so a gate in front of a large job opens few files, and only
    the answers reach the driver.
    """
    if sample_lines is None:
        return not lines.where(has_wanted_member(F.col(value))).isEmpty()
    return any(row["found"] for row in lines.select(has_wanted_member(F.col(value)).alias("found")).take(sample_lines))


def member_facts(lines: DataFrame, path: str, value: str = "value") -> DataFrame:
    """``has_field`` per path, over all given lines."""
    return lines.groupBy(path).agg(F.bool_or(has_wanted_member(F.col(value))).alias("has_field"))


def first_lines(lines: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    """First n lines of each group; tasks cut their lines to n per group before the shuffle."""
    number = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    return lines.withColumn("line_no", number).where(F.col("line_no") <= n)


def nth_line(lines: DataFrame, group: list[str], order: list[str], n: int = PROBE_LINE, value: str = "value") -> DataFrame:
    """Line n of each group, its last line when it is shorter, as ``line_no`` and ``value``."""
    first = first_lines(lines, group, order, n)
    return first.groupBy(*group).agg(
        F.max("line_no").cast("long").alias("line_no"), F.max_by(value, "line_no").alias(value)
    )


def probe_marker(probed: DataFrame, marker: str = "merge_field", value: str = "value") -> DataFrame:
    """``status`` of probed lines: ``present`` or ``absent``; ``failed`` when there was no line."""
    found: Column = contains_marker(F.col(value), marker)
    return probed.withColumn(
        "status", F.when(F.col(value).isNull(), "failed").when(found, "present").otherwise("absent")
    )


def audit_paths(requested: DataFrame, facts: DataFrame, path: str = "path") -> DataFrame:
    """Every requested path with ``path_exists`` and three-valued ``has_field``.

    ``facts`` has one row per existing path; its ``has_field`` is NULL for a path without readable lines.
    """
    known = facts.select(path, F.lit(True).alias("__known"), "has_field")
    return requested.join(known, path, "left").withColumn(
        "path_exists", F.coalesce(F.col("__known"), F.lit(False))
    ).drop("__known")


def lacking_paths(audit: DataFrame, path: str = "path") -> DataFrame:
    """Paths that exist but lack the member."""
    return audit.where(F.col("path_exists") & ~F.col("has_field")).select(path)
