"""What lies in a directory, read without opening the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweft.functions.text import file_parent

# Suffixes of the picture files that are collected.
PICTURE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "gif", "webp")


def list_directory(spark: SparkSession, path: str | list[str], recursive: bool = True) -> DataFrame:
    """``path``, ``length`` and ``modificationTime`` of every file; the content is not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(path).select("path", "length", "modificationTime")


def directory_summary(files: DataFrame) -> DataFrame:
    """Per directory: files, total bytes, files that are not gzipped, last file by name."""
    packed = F.lower("path").endswith(".gz")
    return files.groupBy(file_parent(F.col("path")).alias("directory")).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("length").alias("total_bytes"),
        F.count_if(~packed).alias("plain_files"),
        F.max("path").alias("last_file"),
    )


def plain_files(files: DataFrame) -> DataFrame:
    """Files that are not gzipped."""
    return files.where(~F.col("path").endswith(".gz"))


def collect_pictures(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Distinct picture paths below the given files and directories, sorted."""
    suffix = rf"\.({'|'.join(PICTURE_SUFFIXES)})$"
    files = list_directory(spark, paths).where(F.lower("path").rlike(suffix))
    return files.select("path").distinct().orderBy("path")


def read_pictures(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path`` and ``content`` of the picture files."""
    suffix = rf"\.({'|'.join(PICTURE_SUFFIXES)})$"
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return reader.load(paths).where(F.lower("path").rlike(suffix)).select("path", "content")
