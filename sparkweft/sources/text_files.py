"""Text, JSON-lines and record-separated files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweft.functions.json_text import parse_object
from sparkweft.functions.text import split_pair, trim_ws
from sparkweft.operators.rows import split_positional

# The cells of a positional trip record, by position.
RECORD_FIELDS = (
    "estimate_id", "supplier_name", "driver_id", "driver_last_name", "car_type", "car_number", "product_type",
    "start_date", "end_date", "summary_order_count", "driver_cancel_count", "online_duration",
    "peak_online_duration", "ok_server_day_count", "serve_duration", "income_amount", "reward_amount", "images",
    "performance_order_count", "source_type", "city_name", "activity_name", "city_illegal", "platform",
    "week_number", "platform_income_total", "base_fare", "reward", "other", "channel_reward", "placeholder",
)
# The sheet order: images first, then the other fields up to the platform.
RECORD_ORDER = ("images", *(name for name in RECORD_FIELDS[:24] if name != "images"))

PLACE = ("src_file", "src_block", "src_seq")


def read_lines(
    spark: SparkSession, path: str | list[str], place: bool = False, skip_broken: bool = False
) -> DataFrame:
    """Lines of plain or gzipped files as ``value``; ``place`` adds where each line stands.

    Sorting by ``src_file, src_block, src_seq`` gives file order. With ``skip_broken`` a file that can't be read gives the
    lines before its break only.
    """
    lines = spark.read.option("ignoreCorruptFiles", skip_broken).option("ignoreMissingFiles", skip_broken).text(path)
    if not place:
        return lines
    return lines.select(
        "value",
        F.col("_metadata.file_path").alias("src_file"),
        F.col("_metadata.file_block_start").alias("src_block"),
        F.monotonically_increasing_id().alias("src_seq"),
    )


def read_whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per file with its whole content; for collections of small files."""
    return spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("src_file"))


def read_records(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """Pieces of text between separators, however many lines they span, with their place.

    The separator takes the place of the line break, so files of any size still split into blocks.
    """
    return spark.read.option("lineSep", separator).text(path).select(
        "value",
        F.col("_metadata.file_path").alias("src_file"),
        F.col("_metadata.file_block_start").alias("src_block"),
        F.monotonically_increasing_id().alias("src_seq"),
    )


def read_name_lists(spark: SparkSession, path: str, list_field: str = "dict_list") -> DataFrame:
    """Distinct names in JSON objects written back to back with a blank line between; broken objects are skipped."""
    pieces = read_records(spark, path, "}\n\n{").select(trim_ws(F.col("value")).alias("value"))
    opened = F.when(F.col("value").startswith("{"), F.col("value")).otherwise(F.concat(F.lit("{"), F.col("value")))
    closed = F.when(opened.endswith("}"), opened).otherwise(F.concat(opened, F.lit("}")))
    fields = T.StructType([T.StructField(list_field, T.ArrayType(T.StringType()))])
    names = pieces.where("value <> ''").select(F.explode(parse_object(closed, fields)[list_field]).alias("name"))
    return names.distinct()


def read_request_keys(spark: SparkSession, path: str) -> DataFrame:
    """``dict`` and ``key`` of the first entry of every ``"keys": [{"key": …, "dict": …}]``, with its place.

    Each piece after a ``"keys"`` is matched at its start, so an entry may span lines and a file may span blocks.
    """
    entry = r'^:\s*\[\s*\{\s*"key":\s*"([^"]+)"\s*,\s*"dict":\s*"([^"]+)"'
    pieces = read_records(spark, path, '"keys"').where(F.col("value").rlike(entry))
    return pieces.select(
        F.regexp_extract("value", entry, 2).alias("dict"), F.regexp_extract("value", entry, 1).alias("key"), *PLACE
    )


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``dict key`` lines split at the first white space; other lines are dropped."""
    return split_pairs(read_lines(spark, path))


def split_pairs(lines: DataFrame, value: str = "value") -> DataFrame:
    """:func:`read_pairs` for a line frame; the other columns stay in front."""
    kept = [name for name in lines.columns if name != value]
    parts = lines.select(*kept, split_pair(F.col(value)).alias("__p")).where(F.size("__p") == 2)
    return parts.select(*kept, F.get("__p", F.lit(0)).alias("dict"), F.get("__p", F.lit(1)).alias("key"))


def read_positional(
    spark: SparkSession, path: str, names: Sequence[str] = RECORD_FIELDS, delimiter: str = "\t"
) -> DataFrame:
    """Records without header, cells named by position (see :func:`split_positional`)."""
    return split_positional(read_lines(spark, path), names, delimiter)


def read_vectors(spark: SparkSession, path: str, others: str = "", one_per_file: bool = False) -> DataFrame:
    """JSON vector documents ``{dimension, embedding}`` with their file: one per line, or ``one_per_file`` over any
    number of lines. ``others`` is the schema of further fields, as text."""
    schema = ", ".join(filter(None, [others, "dimension int, embedding array<float>"]))
    documents = spark.read.schema(schema).option("multiLine", one_per_file).json(path)
    return documents.select("*", F.col("_metadata.file_path").alias("src_file"))
