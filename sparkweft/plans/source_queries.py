"""Queries on further file forms and on inputs that partly fail: written from the tables, then read or processed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweft.operators.encode import encode
from sparkweft.operators.series import chart_points
from sparkweft.plans.jobs import audit_directories, probe_last_files
from sparkweft.plans.registry import query, table
from sparkweft.plans.vector_queries import library
from sparkweft.sinks.files import write_csv, write_library
from sparkweft.sources.case_files import flatten_library, read_library
from sparkweft.sources.csv_files import read_csv, read_headed_tsv, row_count
from sparkweft.sources.inventory import collect_pictures, list_directory
from sparkweft.sources.paths import list_files, rename_file
from sparkweft.sources.text_files import read_lines
from sparkweft.staging import stage_path


def _write_headed(lines: DataFrame, header: str, path: str) -> None:
    """Ready lines below a header in every file."""
    lines.toDF(header).write.options(
        header=True, sep="\x01\x02\x01", quote="", escape="\0", emptyValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)


@query(
    """
    select case when c_custkey % 5 = 0 then '' else c_name end as name, c_mktsegment as segment, c_nationkey::varchar as flag
    from customer where c_custkey % 3 <> 0
    """
)
def headed_tsv_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab-separated files with a header: required columns by name, rows too short for them skipped, empty cells kept."""
    path = stage_path(spark)
    name = F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.col("c_name"))
    whole = F.concat_ws("\t", "c_mktsegment", F.lit("x"), name, F.col("c_nationkey").cast("string"))
    line = F.when(F.col("c_custkey") % 3 == 0, F.concat_ws("\t", "c_mktsegment", F.lit("short"))).otherwise(whole)
    _write_headed(table(spark, sf_dir, "customer").select(line), "segment\tother\tname\tflag", path)
    return read_headed_tsv(spark, path, ["name", "segment", "flag"]).select("name", "segment", "flag")


@query("select count(*) as records, count(*) + count(*) filter (where c_custkey % 2 = 0) as lines from customer")
def file_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of headed files whose cells hold line breaks, and their lines without the headers."""
    path = stage_path(spark)
    name = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit("\nsecond"))).otherwise(F.col("c_name"))
    write_csv(table(spark, sf_dir, "customer").select("c_custkey", name.alias("name")), path)
    more_headers = len(read_lines(spark, path).inputFiles()) - 1  # counting lines takes off one header
    counts = row_count(spark, path), row_count(spark, path, physical=True) - more_headers
    return spark.createDataFrame([counts], "records long, lines long")


@query(
    """
    select c_custkey, c_acctbal, c_name, 'int' as key_type, 'double' as balance_type, 'string' as name_type from customer
    """
)
def csv_inferred_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV files whose column types are found from their cells."""
    path = stage_path(spark)
    write_csv(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_name"), path)
    rows = read_csv(spark, path, infer_types=True)
    return rows.select(
        F.col("c_custkey").cast("long").alias("c_custkey"), "c_acctbal", "c_name",
        F.typeof("c_custkey").alias("key_type"), F.typeof("c_acctbal").alias("balance_type"),
        F.typeof("c_name").alias("name_type"),
    )


def _write_by_type(rows: DataFrame, path: str, endings: dict[str, str]) -> None:
    """``value`` as text files in a folder per ``event_type``, with the given endings of their names."""
    rows.write.partitionBy("event_type").text(path)
    spark = rows.sparkSession
    for kind, ending in endings.items():
        for file in list_files(spark, f"{path}/event_type={kind}"):
            rename_file(spark, file, file.removesuffix(".txt") + ending)


@query(
    """
    select event_type, sum(strlen(props) + 1)::bigint as total_bytes from events
    where event_type in ('click', 'view', 'purchase') group by event_type
    """
)
def picture_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picture files below folders that also hold other files, each once though its folder is named twice."""
    path = stage_path(spark)
    rows = table(spark, sf_dir, "events").select("event_type", F.col("props").alias("value"))
    _write_by_type(rows, path, {"click": ".jpg", "view": ".PNG", "purchase": ".webp", "error": ".jpg.txt"})
    pictures = collect_pictures(spark, [path, path]).join(list_directory(spark, path), "path")
    kind = F.regexp_extract("path", "event_type=([^/]+)", 1).alias("event_type")
    return pictures.groupBy(kind).agg(F.sum("length").alias("total_bytes"))


@query(
    """
    select label::bigint as case_no, 'case-' || label::varchar as case_name, vec_id::varchar as path,
           row_number() over (partition by label order by vec_id) - 1 as idx,
           round(list_sum(embedding::double[]), 6) as total
    from embeddings
    """
)
def library_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case library saved and loaded again."""
    path = stage_path(spark)
    write_library(library(spark, sf_dir), path)
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return read_library(spark, path).select("case_no", "case_name", "path", "idx", F.round(total, 6).alias("total"))


@query(
    """
    select 0::bigint as case_no, 'case-' || label::varchar as case_name, 0::bigint as idx, vec_id::varchar as path,
           64::bigint as dimension
    from embeddings where vec_id % 3 < 2
    union all
    select 0, 'case-' || label::varchar, 1, 'without', null from embeddings where vec_id % 3 = 1
    """
)
def library_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library documents in both layouts: a lone sample needs a vector, a listed one doesn't."""
    path = F.col("vec_id").cast("string").alias("path")
    whole, bare = F.struct(path, "embedding"), F.struct(path)
    remainder = F.col("vec_id") % 3
    listed = F.concat(F.lit("["), F.to_json(whole), F.lit(', {"path": "without"}]'))
    body: Column = F.when(remainder == 0, F.to_json(whole)).when(remainder == 1, listed).otherwise(F.to_json(bare))
    document = F.concat(F.lit('{"case-'), F.col("label").cast("string"), F.lit('": '), body, F.lit("}"))
    cases = flatten_library(table(spark, sf_dir, "embeddings").select(document.alias("value")))
    return cases.select("case_no", "case_name", "idx", "path", F.size("embedding").cast("long").alias("dimension"))


@query(
    """
    with o as (select o_orderkey as k, o_orderkey::varchar as ticker, o_orderkey + 0.5::double as price from orders)
    select ticker, null::double as price, null::bigint as week, null::double as close from o where k % 7 = 0
    union all select ticker, price, 0, k + 2.0::double from o where k % 7 <> 0 and k % 3 = 0
    union all select ticker, price, 0, k::double from o where k % 7 <> 0 and k % 3 <> 0
    union all select ticker, price, 1, k + 1.0::double from o where k % 7 <> 0 and k % 3 <> 0
    """
)
def chart_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chart documents: adjusted values if there are any, else raw ones, without NULLs; some without a result."""
    key = F.col("o_orderkey")
    adjusted = F.when(key % 3 == 0, "").otherwise(F.format_string("%d, null, %d", key, key + 1))
    chart = F.format_string(
        '{"chart": {"result": [{"meta": {"regularMarketPrice": %d.5}, "indicators": {"adjclose": [{"adjclose": [%s]}], '
        '"quote": [{"close": [%d, null]}]}}]}}',
        key, adjusted, key + 2,
    )
    value = F.when(key % 7 == 0, '{"chart": {"result": null}}').otherwise(chart)
    documents = table(spark, sf_dir, "orders").select(key.cast("string").alias("ticker"), value.alias("value"))
    return chart_points(documents, "ticker").withColumn("week", F.col("week").cast("long"))


def make_length_model():
    """A model that gives the last digit of a text's length next to a 3, and fails on lengths divisible by 7."""

    def vectors(texts: np.ndarray) -> np.ndarray:
        lengths = [len(text) for text in texts]
        if any(length % 7 == 0 for length in lengths):
            raise ValueError("a text this model can't read")
        return np.array([[length % 10, 3] for length in lengths], dtype=np.float32)

    return vectors


@query(
    """
    with d as (select doc_id, case when length(text) % 7 <> 0 then length(text) % 10 end::double as n from documents)
    select doc_id, round(n / sqrt(n * n + 9), 4) as first, round(3 / sqrt(n * n + 9), 4) as second from d
    """
)
def encode_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors from a caller's model that fails on some texts: only those stay without a vector."""
    found = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", make_length_model)
    part = lambda i: F.round(F.col("embedding")[i].cast("double"), 4)
    return found.select("doc_id", part(0).alias("first"), part(1).alias("second"))


def _partly_broken(spark: SparkSession, sf_dir: str) -> list[str]:
    """Folders of feature lines by event type, with wanted members in two of them and one that is no gzip file though
    named so; and a folder that isn't there."""
    path = stage_path(spark)
    member = F.when(F.col("event_type").isin("click", "view"), '"merge_field\\tx"').otherwise('"other\\tx"')
    line = F.format_string('{"key": "u%d", "fieldvalues": [%s]}', "user_id", member)
    rows = table(spark, sf_dir, "events").select("event_type", line.alias("value"))
    _write_by_type(rows, path, {"error": ".gz"})
    kinds = ("click", "error", "purchase", "signup", "view", "none")
    return [f"{path}/event_type={kind}" for kind in kinds]


@query(
    """
    select event_type as directory, true as path_exists,
           case when event_type <> 'error' then event_type in ('click', 'view') end as has_field
    from events group by event_type
    union all select 'none', false, null
    """
)
def audit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit job over folders one of which can't be read and one of which is missing."""
    audited = audit_directories(spark, _partly_broken(spark, sf_dir))
    return audited.select(F.regexp_extract("path", "event_type=(.+)", 1).alias("directory"), "path_exists", "has_field")


@query(
    """
    select event_type as directory, case when event_type = 'error' then 'failed'
                                         when event_type in ('click', 'view') then 'present' else 'absent' end as status
    from events group by event_type
    union all select 'none', 'failed'
    """
)
def probe_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probe job over the same folders."""
    probed = probe_last_files(spark, _partly_broken(spark, sf_dir))
    return probed.select(F.regexp_extract("path", "event_type=(.+)", 1).alias("directory"), "status")
