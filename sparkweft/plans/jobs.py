"""Whole jobs over directories."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweft.functions.json_text import rewrite_members
from sparkweft.functions.text import parent_name, swap_segment
from sparkweft.operators.audit import audit_paths, member_facts, nth_line, probe_marker, sample_has_member
from sparkweft.operators.cases import classify
from sparkweft.operators.cluster import DEFAULT_THRESHOLD, leader_clusters
from sparkweft.operators.diff import extract_features, feature_diff, line_diff
from sparkweft.operators.encode import encode
from sparkweft.operators.logs import params_records
from sparkweft.operators.rows import reorder_columns
from sparkweft.sinks.files import (
    stable_part_names,
    write_csv,
    write_feature_diff,
    write_gzip_text,
    write_line_diff,
    write_ragged_csv,
)
from sparkweft.sources.inventory import read_pictures
from sparkweft.sources.paths import data_files, list_files, path_state
from sparkweft.sources.text_files import PLACE, RECORD_FIELDS, RECORD_ORDER, read_lines, read_positional
from sparkweft.staging import stage

_PARALLEL_DIRECTORIES = 8

# What a job raises when its files can't be read, after Spark's own retries.
_UNREADABLE = (PySparkException, Py4JJavaError)

BACKUP_SEGMENT, DATA_SEGMENT = "data_backup", "data"


def output_directory(spark: SparkSession, input_dir: str, output_dir: str | None = None) -> str:
    """Given output directory, or the input path with its first ``data_backup`` segment turned into ``data``."""
    given = F.lit(input_dir)
    paths = spark.range(1).select(
        F.rtrim(given, F.lit("/")).alias("source"), swap_segment(given, BACKUP_SEGMENT, DATA_SEGMENT).alias("swapped")
    )
    found = paths.head()
    target = output_dir or found["swapped"]
    if target is None:
        raise ValueError(f"no {BACKUP_SEGMENT} segment in {input_dir}; name the output directory")
    if target.rstrip("/") == found["source"]:
        raise ValueError("the output directory must differ from the input directory")
    return target


def filter_features(
    spark: SparkSession, input_dir: str, output_dir: str | None = None, sample_lines: int | None = None
) -> str | None:
    """Rewrite feature files with only their wanted members.

    Gives the output directory, or None, writing nothing, when no line (of the first ``sample_lines``, if given) has a wanted member.
    """
    target = output_directory(spark, input_dir, output_dir)
    lines = read_lines(spark, input_dir)
    if not sample_has_member(lines, sample_lines):
        return None
    write_gzip_text(lines.select(rewrite_members(F.col("value")).alias("value")), target, len(lines.inputFiles()))
    stable_part_names(spark, target)
    return target


def compare_features(
    spark: SparkSession, backup_dir: str, data_dir: str, output_dir: str | None = None, key_field: str = "key"
) -> DataFrame:
    """Key-by-key diff of two feature directories, written as JSON if an output directory is given."""
    backup, data = (
        extract_features(read_lines(spark, path), key_field=key_field) for path in (backup_dir, data_dir)
    )
    diff = stage(feature_diff(backup, data))
    if output_dir:
        write_feature_diff(diff, output_dir)
    return diff


def compare_lines(spark: SparkSession, path1: str, path2: str, output_dir: str | None = None) -> DataFrame:
    """Distinct-line diff of two directories, written as text if an output directory is given."""
    diff = stage(line_diff(read_lines(spark, path1), read_lines(spark, path2)))
    if output_dir:
        write_line_diff(diff, output_dir)
    return diff


def _path_states(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, str, str]]:
    """Each path once with its full form and its state; the file system is asked for several at a time."""
    with ThreadPoolExecutor(_PARALLEL_DIRECTORIES) as pool:
        ask = inheritable_thread_target(spark)(lambda path: (path, *path_state(spark, path)))
        return list(pool.map(ask, dict.fromkeys(paths)))


def _scanned(spark: SparkSession, files: dict[str, list[tuple[str, str]]], skip_broken: bool = False) -> dict[str, bool]:
    """Whether a line of each directory has a wanted member: one scan over the files of all, one answer per directory."""
    table = spark.createDataFrame(
        [(directory, place) for directory, found in files.items() for _, place in found], "directory string, src_file string"
    )
    paths = sorted({path for found in files.values() for path, _ in found})
    lines = read_lines(spark, paths, place=True, skip_broken=skip_broken)
    facts = table.join(member_facts(lines, "src_file"), "src_file", "left").groupBy("directory").agg(
        F.coalesce(F.bool_or("has_field"), F.lit(False)).alias("has_field")
    )
    return {row["directory"]: row["has_field"] for row in facts.collect()}


def _scanned_to_the_end(spark: SparkSession, files: dict[str, list[tuple[str, str]]]) -> dict[str, bool | None]:
    """As :func:`_scanned`, NULL where a file breaks off: a scan that fails is repeated for each half of its directories,
    so every broken directory costs about twice the logarithm of their number in scans, the others nothing."""
    if not files:
        return {}
    try:
        return _scanned(spark, files)
    except _UNREADABLE:
        if len(files) == 1:
            return dict.fromkeys(files)
    names = sorted(files)
    halves = names[: len(names) // 2], names[len(names) // 2 :]
    return {
        name: answer
        for half in halves
        for name, answer in _scanned_to_the_end(spark, {name: files[name] for name in half}).items()
    }


def _members_found(spark: SparkSession, directories: dict[str, str]) -> dict[str, bool | None]:
    """``has_field`` of many directories by scans over all that are still open.

    First one file of each is read, which answers most that have the member; then all files of the others, up to where
    they break. A directory without a find is told to lack the member only if all its files were read to their end.
    """
    with ThreadPoolExecutor(_PARALLEL_DIRECTORIES) as pool:
        ask = inheritable_thread_target(spark)(lambda place: (place[0], data_files(spark, place[1])))
        files = dict(pool.map(ask, directories.items()))
    answers: dict[str, bool | None] = {path: None if not found else False for path, found in files.items()}
    for taken in (1, None):
        open_files = {path: found[:taken] for path, found in files.items() if found and not answers[path]}
        if open_files:
            answers |= _scanned(spark, open_files, skip_broken=True)
    lacking = {path: files[path] for path, found in answers.items() if found is False}
    return answers | _scanned_to_the_end(spark, lacking)


def audit_directories(
    spark: SparkSession, paths: Sequence[str], sample_lines: int | None = None
) -> DataFrame:
    """``path``, ``task_name``, ``path_exists`` and three-valued ``has_field`` of every path.

    ``has_field`` tells whether any line of a directory has a wanted member; all directories are scanned together. It is
    NULL where there are no files to look at, and where none was found and a file can't be read to its end; the other
    directories keep their answers. With ``sample_lines`` only the first lines of each directory count, which takes a job
    for each that opens few files.
    """
    states = _path_states(spark, paths)
    filled = {path: full for path, full, state in states if state == "directory"}

    def sampled(place: tuple[str, str]) -> tuple[str, bool | None]:
        try:
            return place[0], sample_has_member(read_lines(spark, place[1]), sample_lines)
        except _UNREADABLE:
            return place[0], None

    if sample_lines is None:
        found = _members_found(spark, filled)
    else:
        with ThreadPoolExecutor(_PARALLEL_DIRECTORIES) as pool:
            found = dict(pool.map(inheritable_thread_target(spark)(sampled), filled.items()))
    requested = spark.createDataFrame([(path,) for path, _, _ in states], "path string")
    facts = spark.createDataFrame(
        [(path, found.get(path)) for path, _, state in states if state != "missing"], "path string, has_field boolean"
    )
    audited = audit_paths(requested, facts)
    return audited.select("path", parent_name(F.col("path")).alias("task_name"), "path_exists", "has_field")


def _probed_line(spark: SparkSession, file: str, line: int) -> tuple[int | None, str | None]:
    """Number and text of one line of a file, of its last line if it is shorter; nothing if it is empty or unreadable.

    The file's first block nearly always holds the line, and the task that reads it stops there.
    """
    lines = read_lines(spark, file, place=True)
    try:
        first = lines.where("src_block = 0").select("value").take(line)
        if len(first) == line:
            return line, first[-1]["value"]
        found = nth_line(lines, ["src_file"], ["src_block", "src_seq"], line).head()
    except _UNREADABLE:
        return None, None
    return (None, None) if found is None else (found["line_no"], found["value"])


def probe_last_files(spark: SparkSession, paths: Sequence[str], line: int = 100, marker: str = "merge_field") -> DataFrame:
    """``path``, ``last_file``, ``line_no`` and ``status`` of one line in the last file of every directory.

    ``status`` is ``failed`` for a path that is no directory or whose last file is empty or can't be read.
    """
    states = _path_states(spark, paths)

    def probed(place: tuple[str, str, str]) -> tuple[str, str | None, int | None, str | None]:
        path, full, state = place
        files = list_files(spark, full) if state == "directory" else []
        seen = [file for file in files if file.rsplit("/", 1)[1][0] not in "._"]
        if not seen:
            return path, None, None, None
        return path, seen[-1], *_probed_line(spark, seen[-1], line)

    with ThreadPoolExecutor(_PARALLEL_DIRECTORIES) as pool:
        found = list(pool.map(inheritable_thread_target(spark)(probed), states))
    rows = spark.createDataFrame(found, "path string, last_file string, line_no long, value string")
    return probe_marker(rows, marker).select("path", "last_file", "line_no", "status")


def export_params(spark: SparkSession, log_path: str, output_dir: str) -> DataFrame:
    """Parameter records of a log as CSV, in the order their keys first occur.

    The place of a line, written so that it sorts as text, is its order; the log itself is neither sorted nor copied.
    """
    file, *numbers = PLACE
    digits = [F.lpad(F.col(number).cast("string"), 19, "0") for number in numbers]
    place = F.concat_ws("\u0000", file, *digits).alias("place")
    records = stage(params_records(read_lines(spark, log_path, place=True).select(place, "value"), "place"))
    write_csv(records.orderBy("first_position").drop("first_position"), output_dir)
    return records


def reorder_positional(
    spark: SparkSession,
    input_path: str,
    output_dir: str,
    names: Sequence[str] = RECORD_FIELDS,
    wanted: Sequence[str] = RECORD_ORDER,
) -> None:
    """Positional tab-separated records as CSV: wanted columns first, then the others, then surplus cells."""
    rows = reorder_columns(read_positional(spark, input_path, names), wanted, strict=True)
    write_ragged_csv(rows, output_dir)


def cluster_pictures(
    spark: SparkSession,
    paths: list[str],
    make_model: Callable[[], Callable[[np.ndarray], np.ndarray]],
    threshold: float = DEFAULT_THRESHOLD,
) -> DataFrame:
    """Leader clusters of picture files in path order; ``make_model`` turns file contents into vectors."""
    vectors = stage(encode(read_pictures(spark, paths), "content", make_model).select("path", "embedding"))
    return leader_clusters(vectors, "path", "embedding", threshold)


def classify_pictures(
    spark: SparkSession,
    paths: list[str],
    library: DataFrame,
    make_model: Callable[[], Callable[[np.ndarray], np.ndarray]],
    threshold: float = 0.0,
) -> DataFrame:
    """Nearest-case classes of picture files."""
    vectors = stage(encode(read_pictures(spark, paths), "content", make_model).select("path", "embedding"))
    return classify(vectors, library, threshold, "path", "embedding")
