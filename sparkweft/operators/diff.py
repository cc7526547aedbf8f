"""Reconciling two versions of a dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweft.functions.binding import where_once
from sparkweft.functions.json_text import feature_fields, parse_object, wanted_members

ONLY_LEFT, ONLY_RIGHT, BOTH = "only_in_1", "only_in_2", "in_both"


def line_diff(left: DataFrame, right: DataFrame, value: str = "value") -> DataFrame:
    """Distinct lines of both sides with ``side`` = ``only_in_1``, ``only_in_2`` or ``in_both``.

    One aggregation over the tagged union takes the place of two anti joins and an inner join.
    """
    tagged = left.select(value, F.lit(1).alias("__s")).unionAll(right.select(value, F.lit(2).alias("__s")))
    sides = tagged.groupBy(value).agg(F.bit_or("__s").alias("__s"))
    name = F.when(F.col("__s") == 1, ONLY_LEFT).when(F.col("__s") == 2, ONLY_RIGHT).otherwise(BOTH)
    return sides.select(value, name.alias("side"))


def line_diff_counts(diff: DataFrame) -> DataFrame:
    """One row with the five counts of a line diff."""
    in_left = F.col("side") != ONLY_RIGHT
    in_right = F.col("side") != ONLY_LEFT
    return diff.agg(
        F.count_if(in_left).alias("distinct_1"),
        F.count_if(in_right).alias("distinct_2"),
        F.count_if(F.col("side") == ONLY_LEFT).alias("only_in_1"),
        F.count_if(F.col("side") == ONLY_RIGHT).alias("only_in_2"),
        F.count_if(F.col("side") == BOTH).alias("in_both"),
    )


def extract_features(
    lines: DataFrame, value: str = "value", key_field: str = "key", list_field: str = "fieldvalues"
) -> DataFrame:
    """``key``, ``merge_fields`` and ``parse_ok`` of feature lines, next to the other columns of ``lines``.

    A valid line without key gets a hash of the line as key. A line that does not parse has ``parse_ok`` false and a
    NULL key.
    """
    kept = [name for name in lines.columns if name != value]
    parsed = lines.select(
        *kept, value, parse_object(F.col(value), feature_fields(key_field, list_field)).alias("__parsed")
    )
    found = F.col("__parsed").isNotNull()
    key = F.coalesce(F.col("__parsed")[key_field], F.sha2(F.col(value), 256))
    return parsed.select(
        *kept,
        F.when(found, key).alias("key"),
        wanted_members(F.col("__parsed")[list_field]).alias("merge_fields"),
        found.alias("parse_ok"),
    )


def feature_diff(left: DataFrame, right: DataFrame, order: str | None = None) -> DataFrame:
    """Key-by-key comparison of two frames of :func:`extract_features`.

    The row of a repeated key that survives is the one with the lowest ``order`` value, without ``order`` the one with
    the lowest member list. ``status`` is ``only_in_backup``, ``only_in_data``, ``diff`` or ``same``; lists are
    compared as lists. ``*_rows`` count the rows of the key on each side. Both sides meet in one aggregation, which
    also removes the repeats.
    """

    def side(df: DataFrame, number: int) -> DataFrame:
        return where_once(df, lambda row: row["parse_ok"]).select(
            "key", F.lit(number).alias("__s"), "merge_fields", *([F.col(order).alias("__o")] if order else [])
        )

    first, second = F.col("__s") == 1, F.col("__s") == 2

    def survivor(mine: Column) -> Column:
        members = F.when(mine, F.col("merge_fields"))
        return F.min_by(members, F.when(mine, F.col("__o"))) if order else F.min(members)

    merged = side(left, 1).unionAll(side(right, 2)).groupBy("key").agg(
        survivor(first).alias("backup_merge_fields"),
        survivor(second).alias("data_merge_fields"),
        F.count_if(first).alias("backup_rows"),
        F.count_if(second).alias("data_rows"),
    )
    status = (
        F.when(F.col("data_rows") == 0, "only_in_backup")
        .when(F.col("backup_rows") == 0, "only_in_data")
        .when(F.col("backup_merge_fields").eqNullSafe(F.col("data_merge_fields")), "same")
        .otherwise("diff")
    )
    return merged.withColumn("status", status)


def diff_examples(diff: DataFrame, n: int = 5) -> DataFrame:
    """The first keys whose lists differ, in key order; each task keeps only its first ``n``."""
    return diff.where("status = 'diff'").orderBy("key").limit(n)


def feature_diff_counts(diff: DataFrame) -> DataFrame:
    """One row: keys, discarded repeats and status counts of a feature diff."""
    has_left, has_right = F.col("backup_rows") > 0, F.col("data_rows") > 0
    return diff.agg(
        F.count_if(has_left).alias("backup_keys"),
        F.count_if(has_right).alias("data_keys"),
        (F.count_if(has_right) - F.count_if(has_left)).alias("key_difference"),
        F.coalesce(F.sum(F.greatest(F.col("backup_rows") - 1, F.lit(0))), F.lit(0)).alias("backup_repeats"),
        F.coalesce(F.sum(F.greatest(F.col("data_rows") - 1, F.lit(0))), F.lit(0)).alias("data_repeats"),
        *[
            F.count_if(F.col("status") == status).alias(status)
            for status in ("only_in_backup", "only_in_data", "diff", "same")
        ],
    )


def parse_failures(features: DataFrame, **more: Column) -> DataFrame:
    """One row: valid and failed lines of :func:`extract_features`, and any further aggregates."""
    return features.agg(
        F.count_if("parse_ok").alias("valid_lines"),
        F.count_if(~F.col("parse_ok")).alias("failed_lines"),
        *[measure.alias(name) for name, measure in more.items()],
    )
