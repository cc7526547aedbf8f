"""CSV, text, JSON and vector sinks. All of them overwrite."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweft.functions.text import csv_cell, csv_line
from sparkweft.operators.diff import BOTH, ONLY_LEFT, ONLY_RIGHT
from sparkweft.operators.ordinal import member_lists
from sparkweft.sources.paths import list_files, rename_file

_PARALLEL_RENAMES = 16


def write_csv(df: DataFrame, path: str, delimiter: str = ",") -> None:
    """Headed CSV that quotes only where needed; spaces stay and empty cells stay empty."""
    df.write.mode("overwrite").options(
        header=True,
        sep=delimiter,
        quote='"',
        escape='"',
        emptyValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    ).csv(path)


def write_ragged_csv(df: DataFrame, path: str, overflow: str = "overflow") -> None:
    """Headed CSV whose rows end with the surplus cells of an array column, which has no header."""
    names = [name for name in df.columns if name != overflow]
    surplus = F.transform(overflow, lambda cell: F.concat(F.lit(","), csv_cell(cell)))
    record = F.concat(csv_line([F.col(name) for name in names]), F.array_join(surplus, ""))
    header = ",".join(names)
    # Records are complete already: a separator no text holds and no quote make the CSV writer a line writer that
    # puts the header on top of every file.
    df.select(record.alias(header)).write.mode("overwrite").options(
        header=True, sep="\x01\x02\x01", quote="", escape="\0", emptyValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)


def write_quoted_csv(df: DataFrame, path: str) -> None:
    """Headed CSV with every value in quotes, inner quotes doubled."""
    df.write.mode("overwrite").options(header=True, quoteAll=True, escape='"').csv(path)


def write_text(df: DataFrame, path: str, compression: str = "none") -> None:
    """One text column, one value per line."""
    df.write.mode("overwrite").option("compression", compression).text(path)


def write_gzip_text(df: DataFrame, path: str, files: int) -> None:
    """Gzipped text in about ``files`` files. Lines are dealt out after they are computed, so the work before keeps the
    tasks of its scan."""
    write_text(df.repartition(max(files, 1)), path, "gzip")


def _part_number(name: str) -> int | None:
    """Number of a gzipped part file, None for any other file."""
    stem, _, kind = name.partition(".")
    words = stem.split("-")
    return int(words[1]) if kind == "txt.gz" and words[0] == "part" and len(words) > 1 and words[1].isdigit() else None


def stable_part_names(spark: SparkSession, directory: str) -> list[str]:
    """Give gzipped part files the names ``part-NNNNN.gz``; returns the new names.

    All names are settled before the first file is renamed, and a name that is taken is refused. The driver handles names
    only, several at a time.
    """
    files = [path.rsplit("/", 1) for path in list_files(spark, directory)]
    there = {name for _, name in files}
    numbered = {(parent, name): _part_number(name) for parent, name in files}
    wanted = {place: f"part-{number:05d}.gz" for place, number in numbered.items() if number is not None}
    if len(set(wanted.values())) < len(wanted) or there & set(wanted.values()):
        raise FileExistsError(f"part names would meet in {directory}")

    def rename(place: tuple[str, str]) -> str:
        parent, name = place
        if not rename_file(spark, f"{parent}/{name}", f"{parent}/{wanted[place]}"):
            raise OSError(f"cannot rename {name} to {wanted[place]}")
        return wanted[place]

    with ThreadPoolExecutor(_PARALLEL_RENAMES) as pool:
        return sorted(pool.map(inheritable_thread_target(spark)(rename), wanted))


def write_line_diff(diff: DataFrame, path: str, value: str = "value") -> None:
    """``only_in_1``, ``only_in_2`` and ``in_both`` below ``path``, written in one pass as ``side=…`` folders."""
    diff.select(value, "side").write.mode("overwrite").partitionBy("side").text(path)


def read_line_diff(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The three sides of :func:`write_line_diff`; a side without lines is empty."""
    lines = spark.read.schema("value string, side string").text(path)
    return {side: lines.where(F.col("side") == side).select("value") for side in (ONLY_LEFT, ONLY_RIGHT, BOTH)}


def write_feature_diff(diff: DataFrame, path: str) -> None:
    """Keys of each status but ``same`` as JSON, in one pass as ``status=…`` folders."""
    listed = diff.where("status <> 'same'").select("key", "backup_merge_fields", "data_merge_fields", "status")
    listed.write.mode("overwrite").partitionBy("status").json(path)


def write_vectors(df: DataFrame, path: str, vector: str = "embedding") -> None:
    """Vectors as JSON documents ``{dimension, embedding}``, one per line, next to the other columns."""
    others = [name for name in df.columns if name != vector]
    df.select(*others, F.size(vector).alias("dimension"), F.col(vector).alias("embedding")).write.mode(
        "overwrite"
    ).json(path)


def write_library(library: DataFrame, path: str) -> None:
    """Case library as JSON lines of its flat table, which ``read_library`` reads again."""
    library.write.mode("overwrite").json(path)


def group_documents(df: DataFrame, group: str, member: str, list_rows: int = 10_000) -> DataFrame:
    """Summary as JSON lines: one document with the totals, then one per group and list of members.

    A group longer than ``list_rows`` has several documents, told apart by ``part``.
    """
    totals = df.agg(
        F.count_distinct(group).alias("num_groups"), F.count(member).alias("num_members")
    ).select(F.to_json(F.struct("num_groups", "num_members")).alias("value"))
    lists = member_lists(df, group, member, list_rows)
    return totals.unionAll(lists.select(F.to_json(F.struct(group, "part", "members")).alias("value")))


def write_group_documents(df: DataFrame, group: str, member: str, path: str, list_rows: int = 10_000) -> None:
    """Write :func:`group_documents`."""
    write_text(group_documents(df, group, member, list_rows), path)
