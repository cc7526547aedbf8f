"""Case libraries: labelled sample vectors.

The flat table is ``case_no BIGINT, case_name STRING, idx BIGINT, path STRING, embedding ARRAY<FLOAT>, description
STRING``; ``case_no`` is the place of the class in the library, ``idx`` the place of the sample in its class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FLAT = "case_no bigint, case_name string, idx bigint, path string, embedding array<float>, description string"
SAMPLE = "struct<path:string,embedding:array<float>,description:string>"


def flatten_library(documents: DataFrame, value: str = "value") -> DataFrame:
    """Flat table of library documents in either layout: a class is one sample or a list of samples."""
    cases = documents.select(F.from_json(value, "map<string,string>").alias("m")).select(
        F.posexplode(F.map_entries("m")).alias("case_no", "entry")
    )
    body = F.col("entry.value")
    is_list = F.ltrim(body).startswith("[")
    samples = F.when(is_list, F.from_json(body, f"array<{SAMPLE}>")).otherwise(F.array(F.from_json(body, SAMPLE)))
    rows = cases.select(
        F.col("case_no").cast("long").alias("case_no"),
        F.col("entry.key").alias("case_name"),
        is_list.alias("is_list"),
        F.posexplode(samples).alias("idx", "sample"),
    )
    usable = F.col("is_list") | F.col("sample.embedding").isNotNull()
    return rows.where(usable).select("case_no", "case_name", F.col("idx").cast("long").alias("idx"), "sample.*")


def read_library(spark: SparkSession, path: str) -> DataFrame:
    """Flat table of a library: a saved one, which is one JSON line per sample and splits into blocks, or one JSON
    document with its classes in document order. Only in a saved library is ``case_no`` of the first line a number."""
    lines = spark.read.text(path)
    number = F.from_json("value", "case_no bigint")["case_no"]
    first = lines.where("value <> ''").select(number.alias("case_no")).head()
    if first is None or first["case_no"] is not None:
        return spark.read.schema(FLAT).json(path)
    return flatten_library(spark.read.text(path, wholetext=True))
