"""Queries that write data derived from the tables as files and read or process the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweft.operators.ordinal import page, paged
from sparkweft.operators.rows import with_prefix
from sparkweft.plans.feature_queries import CHANGED_SQL, DIFF_SQL, LINE_SIDES_SQL, feature_lines
from sparkweft.plans.jobs import compare_features, compare_lines, export_params, filter_features, reorder_positional
from sparkweft.plans.registry import query, table
from sparkweft.plans.table_queries import NAMES, document_lines, ragged_lines
from sparkweft.sinks.files import group_documents, read_line_diff, write_csv, write_quoted_csv, write_text, write_vectors
from sparkweft.sources.csv_files import read_csv, read_csv_arrays, read_csv_chunks, read_csv_ordered, read_csv_records
from sparkweft.sources.inventory import directory_summary, list_directory
from sparkweft.sources.text_files import read_lines, read_name_lists, read_request_keys, read_vectors
from sparkweft.staging import stage_path


@query(
    """
    select c_custkey, c_name || chr(10) || '"' || c_mktsegment || '", x' as label, '  ' || c_mktsegment || ' ' as segment,
           case when c_nationkey % 3 = 0 then '' else c_nationkey::varchar end as nation
    from customer
    """
)
def csv_file_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV files with quotes, line breaks in cells, spaces and empty cells."""
    path = stage_path(spark)
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.concat("c_name", F.lit('\n"'), "c_mktsegment", F.lit('", x')).alias("label"),
        F.concat(F.lit("  "), "c_mktsegment", F.lit(" ")).alias("segment"),
        F.when(F.col("c_nationkey") % 3 != 0, F.col("c_nationkey").cast("string")).alias("nation"),
    )
    write_csv(rows, path)
    return read_csv(spark, path).select(
        F.col("c_custkey").cast("long").alias("c_custkey"), "label", "segment", F.coalesce("nation", F.lit("")).alias("nation")
    )


@query(
    """
    with o as (
      select row_number() over (order by c_custkey) as ordinal, c_custkey, c_name || chr(10) || c_mktsegment as label from customer)
    select 'page' as part, ordinal, c_custkey, label from o where ordinal between 201 and 260
    union all
    select 'rest' as part, max(ordinal), max(c_custkey), min(label) from o where ordinal > 260 having count(*) > 0
    """
)
def row_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a CSV file's rows in file order, and what a reader that resumes behind it still gets."""
    path = stage_path(spark)
    label = F.concat_ws("\n", "c_name", "c_mktsegment").alias("label")
    write_csv(table(spark, sf_dir, "customer").orderBy("c_custkey").select("c_custkey", label), path)
    rows = read_csv_ordered(spark, path)
    index = paged(rows, ["src_file", "src_block", "src_seq"])
    index = index.select("ordinal", F.col("c_custkey").cast("long").alias("c_custkey"), "label")
    resumed = index.where(F.col("ordinal") > 260)
    rest = resumed.agg(*[F.max(c).alias(c) for c in ("ordinal", "c_custkey")], F.min("label").alias("label")).where(F.col("ordinal").isNotNull())
    return page(index, 201, 60).select(F.lit("page").alias("part"), "*").unionByName(rest.select(F.lit("rest").alias("part"), "*"))


@query(
    """
    select chunk_id, count(*) as n_rows, min(event_id) as first_event, max(event_id) as last_event
    from (select event_id, (row_number() over (order by event_type, event_id) - 1) // 700 as chunk_id from events)
    group by chunk_id
    """
)
def csv_file_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 700 rows in file order."""
    path = stage_path(spark)
    write_csv(table(spark, sf_dir, "events").select("event_type", "event_id").orderBy("event_type", "event_id"), path)
    chunks = read_csv_chunks(spark, path, 700).withColumn("event_id", F.col("event_id").cast("long"))
    return chunks.groupBy("chunk_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event")
    )


@query("select distinct 'dict,' || event_type as dict, 'u\"' || user_id::varchar as key from events")
def quoted_csv_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Always-quoted pair files, read as arrays of cells."""
    path = stage_path(spark)
    pairs = table(spark, sf_dir, "events").select(
        F.concat(F.lit("dict,"), "event_type").alias("dict"), F.concat(F.lit('u"'), F.col("user_id").cast("string")).alias("key")
    )
    write_quoted_csv(pairs.distinct(), path)
    cells = read_csv_arrays(spark, path).select(F.col("cells")[0].alias("dict"), F.col("cells")[1].alias("key"))
    return cells.where("dict <> 'dict'")  # every file starts with the header


@query(
    """
    select o_orderkey::varchar as order_key,
           case when o_orderkey % 4 = 1 then '' else o_custkey::varchar end as customer,
           case when o_orderkey % 4 = 1 then '' else o_orderstatus end as status,
           case when o_orderkey % 4 in (0, 1) then '' else o_orderpriority end as priority,
           case when o_orderkey % 4 = 3 then 'extra|' else '' end as overflow
    from orders
    """
)
def positional_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positional tab-separated files turned into CSV files with other column order and surplus cells."""
    source, target = stage_path(spark), stage_path(spark)
    write_text(ragged_lines(spark, sf_dir), source)
    reorder_positional(spark, source, target, NAMES, ("priority", "order_key"))
    back = read_csv_records(spark, target)
    return back.withColumn("overflow", F.coalesce(F.array_join("overflow", "|"), F.lit("")))


@query(
    f"""
    with {CHANGED_SQL}
    select value, count(*) as n_lines from (
      select case when not parse_ok then line
                  else '{{"key": ' || case when shown_key is null then 'null' else '"' || shown_key || '"' end ||
                       ', "fieldvalues": ' ||
                       case when kind = 1 then '"none"'
                            else '[' || array_to_string(list_transform(members, lambda m: '"merge_field\\t' || m || '"'), ', ')
                                 || ']' end ||
                       ', "n": ' || l_linenumber::varchar || '.5}}' end as value
      from changed) group by value
    """
)
def feature_files_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter job: gzipped feature files rewritten next to their backup."""
    source = f"{stage_path(spark)}/data_backup"
    write_text(feature_lines(spark, sf_dir, changed=True).select("value"), source, "gzip")
    target = filter_features(spark, source)
    return read_lines(spark, target).groupBy("value").agg(F.count(F.lit(1)).alias("n_lines"))


@query(DIFF_SQL + "select key, status from diff where status <> 'same'")
def feature_files_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key-by-key diff job with its JSON report."""
    backup, data, report = (stage_path(spark) for _ in range(3))
    write_text(feature_lines(spark, sf_dir).select("value"), backup, "gzip")
    write_text(feature_lines(spark, sf_dir, changed=True).select("value"), data, "gzip")
    compare_features(spark, backup, data, report)
    return spark.read.schema("key string, status string").json(report)


@query(LINE_SIDES_SQL + "select value, side from sides")
def line_files_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line diff job with its three text outputs."""
    path1, path2, report = (stage_path(spark) for _ in range(3))
    lines = document_lines(spark, sf_dir).select("value")
    write_text(lines, path1)
    longer = F.when(F.length("value") % 5 == 0, F.concat("value", F.lit("!"))).otherwise(F.col("value"))
    write_text(lines.select(longer.alias("value")), path2)
    compare_lines(spark, path1, path2, report)
    first, second, both = (df.withColumn("side", F.lit(side)) for side, df in read_line_diff(spark, report).items())
    return first.unionAll(second).unionAll(both)


@query("select 'dict_' || event_type as dict, 'u' || user_id::varchar as key, count(*) as requests from events group by 1, 2")
def request_dump_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request dumps whose entries span lines."""
    path = stage_path(spark)
    text = F.format_string(
        'curl {"keys":[\n {"key": "u%d",\n  "dict": "dict_%s"}, {"key": "no", "dict": "dict_no"}]}\n{"keys":[{"key": "x", "dict": "curl"}]}',
        "user_id", "event_type",
    )
    write_text(table(spark, sf_dir, "events").select(text.alias("value")), path)
    pairs = with_prefix(read_request_keys(spark, path), "dict", "dict_")
    return pairs.groupBy("dict", "key").agg(F.count(F.lit(1)).alias("requests"))


@query("select c_name as name from customer where c_custkey % 10 <> 0 union select c_mktsegment from customer where c_custkey % 10 <> 0")
def name_list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name lists in JSON objects written back to back, some of them broken."""
    path = stage_path(spark)
    good = F.format_string('{"dict_list": ["%s",\n "%s"]}\n', "c_name", "c_mktsegment")
    broken = F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit('{"x" '), good)).otherwise(good)
    write_text(table(spark, sf_dir, "customer").select(broken.alias("value")), path)
    return read_name_lists(spark, path)


@query(
    """
    select 'source=' || source as directory, 1::bigint as files, sum(strlen(text) + 1)::bigint as total_bytes,
           1::bigint as plain_files
    from documents group by source
    """
)
def directory_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes per directory, without opening the files."""
    path = stage_path(spark)
    documents = table(spark, sf_dir, "documents").select("source", "text")
    documents.repartition("source").write.partitionBy("source").text(path)
    summary = directory_summary(list_directory(spark, path).where(F.col("path").contains("/source=")))
    return summary.select(
        F.element_at(F.split("directory", "/"), -1).alias("directory"), "files", "total_bytes", "plain_files"
    )


@query(
    """
    select vec_id, len(embedding) as dimension, round(list_sum(embedding::double[]), 6) as total from embeddings
    """
)
def vector_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as JSON documents and read again."""
    path = stage_path(spark)
    write_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), path)
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return read_vectors(spark, path, others="vec_id long").select(
        "vec_id", F.col("dimension").cast("long").alias("dimension"), F.round(total, 6).alias("total")
    )


@query(
    """
    with numbered as (
      select event_type, event_id, (row_number() over (partition by event_type order by event_id) - 1) // 900 as part from events)
    select '{"event_type":"' || event_type || '","part":' || part::varchar || ',"members":['
           || string_agg(event_id::varchar, ',' order by event_id) || ']}' as value
    from numbered group by event_type, part
    union all
    select '{"num_groups":' || count(distinct event_type)::varchar || ',"num_members":' || count(*)::varchar || '}' from events
    """
)
def group_document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups as JSON documents: totals, then bounded member lists."""
    return group_documents(table(spark, sf_dir, "events"), "event_type", "event_id", list_rows=900)


@query(
    """
    select 'u' || user_id::varchar as activity_detail_image_urls, arg_max(event_type, event_id) as city_name,
           max(event_id)::varchar as estimate_id
    from events group by user_id
    """
)
def params_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parameter job: log files to CSV, last record of each key in log order."""
    log, target = stage_path(spark), stage_path(spark)
    line = F.format_string(
        'INFO params={"estimate_id": "%d", "city_name": "%s", "activity_detail_image_urls": "u%d"}',
        "event_id", "event_type", "user_id",
    )
    write_text(table(spark, sf_dir, "events").orderBy("event_id").select(line.alias("value")), log)
    export_params(spark, log, target)
    return read_csv(spark, target).select("activity_detail_image_urls", "city_name", "estimate_id")
