"""Queries on delimited rows: parsing, shaping, filtering, sampling, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweft.functions.formats import grouped_text, stamp_text, zoned_minute_text
from sparkweft.functions.text import (
    cell_at,
    csv_cells,
    csv_line,
    quoted_pair,
    segment_between,
    swap_segment,
    with_scheme,
    zero_pad,
)
from sparkweft.operators.lookup import bucketed_store, compare_replicas, look_up_stores
from sparkweft.operators.ordinal import with_chunk_id
from sparkweft.operators.rows import (
    cast_columns,
    drop_blank,
    filter_equal,
    filter_rows,
    filter_status,
    project_defaults,
    reorder_columns,
    split_positional,
)
from sparkweft.operators.sample import sample_rows
from sparkweft.operators.setops import common_lines, missing_names, union_names
from sparkweft.operators.stats import summary_by
from sparkweft.plans.registry import query, table
from sparkweft.sources.text_files import split_pairs

NAMES = ("order_key", "customer", "status", "priority")


@query(
    """
    select c_custkey, c_name || ', "' || c_mktsegment || '"' as label, c_mktsegment as segment,
           case when c_nationkey % 3 = 0 then '' else c_nationkey::varchar end as nation
    from customer
    """
)
def csv_line_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV records with commas, quotes and empty cells, written and parsed again."""
    label = F.concat(F.col("c_name"), F.lit(', "'), F.col("c_mktsegment"), F.lit('"'))
    nation = F.when(F.col("c_nationkey") % 3 == 0, "").otherwise(F.col("c_nationkey").cast("string"))
    lines = table(spark, sf_dir, "customer").select(
        csv_line([F.col("c_custkey"), label, F.col("c_mktsegment"), nation]).alias("value")
    )
    cells = lines.select(csv_cells(F.col("value")).alias("cells"))
    return cells.select(
        cell_at(F.col("cells"), 0).cast("long").alias("c_custkey"),
        cell_at(F.col("cells"), 1).alias("label"),
        cell_at(F.col("cells"), 2).alias("segment"),
        cell_at(F.col("cells"), 3).alias("nation"),
    )


@query(
    """
    select chunk_id, count(*) as n_rows, min(event_id) as first_event, max(event_id) as last_event,
           min(ordinal) as first_ordinal, max(ordinal) as last_ordinal
    from (select event_id, row_number() over (order by ts, event_id) as ordinal,
                 (row_number() over (order by ts, event_id) - 1) // 1000 as chunk_id
          from events)
    group by chunk_id
    """
)
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive chunks of 1,000 rows."""
    chunks = with_chunk_id(table(spark, sf_dir, "events").select("event_id", "ts"), ["ts", "event_id"], 1000)
    return chunks.groupBy("chunk_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("event_id").alias("first_event"),
        F.max("event_id").alias("last_event"),
        F.min("ordinal").alias("first_ordinal"),
        F.max("ordinal").alias("last_ordinal"),
    )


@query("select c_custkey, c_name, c_acctbal from customer where c_acctbal > 5000 and c_mktsegment = 'BUILDING'")
def row_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that satisfy a column condition."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    rich = filter_rows(customers, (F.col("c_acctbal") > 5000) & (F.col("c_mktsegment") == "BUILDING"))
    return rich.drop("c_mktsegment")


@query("select c_custkey, c_name from customer where c_acctbal < 0 or right(c_name, 1) = '7'")
def batch_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that satisfy a caller's batch function."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    kept = filter_rows(customers, lambda rows: (rows["c_acctbal"] < 0) | rows["c_name"].str.endswith("7"))
    return kept.drop("c_acctbal")


@query(
    """
    with lines as (select unnest(string_split(text, chr(10))) as value from documents)
    select count(*) as physical_lines, count(distinct value) as distinct_lines,
           count(*) filter (where trim(value) <> '') as filled_lines from lines
    """
)
def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Physical, distinct and non-blank lines of all documents."""
    lines = document_lines(spark, sf_dir).select("value")
    return lines.agg(
        F.count(F.lit(1)).alias("physical_lines"),
        F.count_distinct("value").alias("distinct_lines"),
        F.count_if(F.btrim("value") != "").alias("filled_lines"),
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents: ``doc_id``, ``source``, ``lang``, ``line_no`` (from 0) and ``value``."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("line_no", "value")
    )


@query(
    """
    select o_orderpriority as priority, o_orderstatus as status, o_orderkey as order_key, o_custkey as customer
    from orders
    """
)
def column_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted columns first, unknown ones ignored, the rest after."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_key"),
        F.col("o_custkey").alias("customer"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
    )
    return reorder_columns(rows, ["priority", "unknown", "status"])


def ragged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tab-separated line per order with one, three, four or six cells, and a blank line after each."""
    tab, key = F.lit("\t"), F.col("o_orderkey").cast("string")
    kind = F.col("o_orderkey") % 4
    two = F.concat(key, tab, F.col("o_custkey").cast("string"), tab, F.col("o_orderstatus"))
    four = F.concat(two, tab, F.col("o_orderpriority"))
    line = F.when(kind == 1, key).when(kind == 0, two).when(kind == 2, four)
    line = line.otherwise(F.concat(four, tab, F.lit("extra"), tab))
    return table(spark, sf_dir, "orders").select(F.explode(F.array(line, F.lit("\t \t"))).alias("value"))


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
def ragged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab-separated rows with too few, exactly enough and too many cells, and blank lines between."""
    rows = split_positional(ragged_lines(spark, sf_dir), NAMES)
    return rows.withColumn("overflow", F.array_join("overflow", "|"))


@query(
    """
    select o_orderkey, case when o_orderkey % 3 = 0 then null else o_totalprice end as amount,
           case when o_orderkey % 5 = 0 then null else strftime(o_orderdate, '%Y-%m-%d') end as day
    from orders
    """
)
def auto_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text columns as numbers and dates; text that does not fit is NULL."""
    price = F.when(F.col("o_orderkey") % 3 == 0, "1.2.3").otherwise(F.col("o_totalprice").cast("string"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat(F.lit(" "), price).alias("amount"),
        F.when(F.col("o_orderkey") % 5 == 0, "soon").otherwise(day).alias("day"),
    )
    return cast_columns(text, numbers=["amount"], dates=["day"]).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    """
    select event_id::varchar as event_id, event_type as kind, json_extract_string(props, '$.k') as k,
           '' as absent, '' as missing
    from events
    """
)
def fixed_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed list of fields with ``''`` for absent ones."""
    props = F.from_json("props", "map<string,string>")
    known = F.create_map(
        F.lit("event_id"), F.col("event_id").cast("string"), F.lit("kind"), F.col("event_type"), F.lit("k"), props["k"]
    )
    rows = table(spark, sf_dir, "events").select(known.alias("fields"))
    return project_defaults(rows, "fields", ["event_id", "kind", "k", "absent", "missing"])


@query(
    """
    select 'Customer#' || lpad(o_custkey::varchar, 9, '0') as name from orders where o_orderstatus = 'F'
    except
    select c_name from customer where c_acctbal > 0
    """
)
def status_filter_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of rows with the right status that are not in the known list."""
    wide = F.concat(F.lit("　 Customer#"), zero_pad(F.col("o_custkey"), 9), F.lit("\t"))
    status = F.concat(F.lit(" "), F.col("o_orderstatus"), F.lit(" "))
    rows = table(spark, sf_dir, "orders").select(wide.alias("name"), status.alias("done"))
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_name").alias("name"))
    return missing_names(filter_status(rows, "name", "done", "F"), known)


@query(
    """
    with a as (select unnest(string_split(text, chr(10))) as value from documents),
         b as (select unnest(string_split(text, '. ')) as value from documents)
    select distinct trim(value) as value from a where trim(value) <> ''
    intersect
    select distinct trim(value) from b where trim(value) <> ''
    """
)
def lines_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trimmed lines that are also whole sentences somewhere."""
    lines = document_lines(spark, sf_dir).select("value")
    sentences = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"\. ")).alias("value"))
    return common_lines(lines, sentences)


@query(
    """
    select o_orderpriority as name from orders union select c_mktsegment from customer
    union select event_type from events
    """
)
def names_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names of three lists."""
    return union_names(
        table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("name")),
        table(spark, sf_dir, "customer").select("c_mktsegment"),
        table(spark, sf_dir, "events").select("event_type"),
    )


@query(
    """
    select o_orderkey, trim(o_orderpriority) as value from orders where o_orderkey % 3 <> 0
    """
)
def blank_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines trimmed of all white space, blank ones dropped."""
    blank = F.lit("　\t ")
    padded = F.concat(blank, F.col("o_orderpriority"), F.lit("  "))
    lines = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, blank).otherwise(padded).alias("value")
    )
    return drop_blank(lines)


@query(
    """
    select o_orderkey, o_orderstatus, o_orderpriority from orders where o_orderstatus = 'F'
    order by md5(o_orderkey::varchar || '|42'), o_orderkey limit 500
    """
)
def sample_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """500 rows of one status, the same ones every time."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return sample_rows(filter_equal(rows, "o_orderstatus", "F"), 500, key=["o_orderkey"], seed=42)


@query(
    """
    with joined as (
      select o_orderkey, o_custkey, o_totalprice, n_name, c_mktsegment
      from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey)
    select case when grouping(n_name) = 0 then 'n_name' when grouping(c_mktsegment) = 0 then 'c_mktsegment'
                else 'total' end as level,
           case when grouping(n_name) = 0 then n_name when grouping(c_mktsegment) = 0 then c_mktsegment end as member,
           count(*) as records, count(distinct o_custkey) as customers, count(distinct n_name) as nations,
           round(sum(o_totalprice), 2) as income
    from joined group by grouping sets ((), (n_name), (c_mktsegment))
    """
)
def driver_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over all orders, by nation and by segment."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    placed = customers.join(nations, "c_nationkey", "left")
    joined = orders.join(placed, "c_custkey", "left")
    # Only the group columns vary within a nation, so distinct nations are distinct names.
    return summary_by(
        joined.withColumn("__nation", F.col("n_name")),
        ["n_name", "c_mktsegment"],
        {
            "records": F.count(F.lit(1)),
            "customers": F.count_distinct("c_custkey"),
            "nations": F.count_distinct("__nation"),
            "income": F.round(F.sum("o_totalprice"), 2),
        },
    )


_LOOKUP_SQL = """
    select o_orderkey, 'cust' as dict, o_custkey::varchar as key,
           case when c_custkey % 7 <> 0 then c_name end as value_a,
           case when c_custkey % 5 = 0 then 'stale' else c_name end as value_b,
           case when c_custkey is null then true
                else coalesce(case when c_custkey % 7 <> 0 then c_name end, '?')
                     = case when c_custkey % 5 = 0 then 'stale' else c_name end end::integer::bigint as agree
    from orders left join customer on o_custkey = c_custkey
    """


def _replicas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as requests for their customer, and two stores of customers: the first holds NULL for some keys, the second
    an old value for others."""
    stored = table(spark, sf_dir, "customer").select(
        F.lit("cust").alias("dict"), F.col("c_custkey").cast("string").alias("key"), "c_custkey", "c_name"
    )
    replica_a = stored.select("dict", "key", F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")).alias("value"))
    replica_b = stored.select(
        "dict", "key", F.when(F.col("c_custkey") % 5 == 0, "stale").otherwise(F.col("c_name")).alias("value")
    )
    requests = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.lit("cust").alias("dict"), F.col("o_custkey").cast("string").alias("key")
    )
    return requests, replica_a, replica_b


@query(_LOOKUP_SQL)
def key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's customer looked up in two replicas that differ."""
    found = compare_replicas(*_replicas(spark, sf_dir), ["dict", "key"])
    return found.withColumn("agree", F.col("agree").cast("int").cast("long"))


@query(_LOOKUP_SQL)
def key_lookup_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same look-up in replicas that are written as bucketed stores first."""
    requests, *replicas = _replicas(spark, sf_dir)
    stores = [bucketed_store(replica, ["dict", "key"], 8) for replica in replicas]
    found = look_up_stores(requests, *stores, ["dict", "key"])
    return found.withColumn("agree", F.col("agree").cast("int").cast("long"))


@query("select event_id, event_type as dict, 'k ' || user_id::varchar as key from events where event_id % 9 <> 0")
def pair_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``dict key`` lines cut at the first white space; one-word lines are dropped."""
    pair = F.concat(F.lit(" "), F.col("event_type"), F.lit("\t　k "), F.col("user_id").cast("string"), F.lit(" "))
    lines = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_id") % 9 == 0, F.col("event_type")).otherwise(pair).alias("value")
    )
    return split_pairs(lines)


@query("select c_custkey, c_mktsegment || ', x' as dict, c_name as key from customer")
def pair_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Always-quoted ``"dict","key"`` records."""
    quoted = F.concat(F.lit('"'), F.col("c_mktsegment"), F.lit(', x","'), F.col("c_name"), F.lit('"'))
    return table(spark, sf_dir, "customer").select("c_custkey", quoted_pair(quoted).alias("p")).select(
        "c_custkey", "p.dict", "p.key"
    )


@query(
    """
    select event_id, strftime(ts, '%Y%m%d_%H%M%S') as stamp, strftime(ts + interval 8 hour, '%Y-%m-%d %H:%M') as minute
    from events
    """
)
def ts_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time stamps as text, in UTC and in a fixed zone."""
    events = table(spark, sf_dir, "events").withColumn("utc", F.col("ts").cast("timestamp"))
    return events.select("event_id", stamp_text(F.col("utc")).alias("stamp"), zoned_minute_text(F.col("utc")).alias("minute"))


@query(
    """
    select o_orderkey, case when length(o_orderkey::varchar) >= 5 then o_orderkey::varchar
                            else lpad(o_orderkey::varchar, 5, '0') end as padded,
           format('{:,}', round(o_totalprice)::bigint) as grouped
    from orders
    """
)
def zero_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers padded with zeros and grouped by thousands."""
    whole = F.round("o_totalprice").cast("long")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", zero_pad(F.col("o_orderkey")).alias("padded"), grouped_text(whole).alias("grouped")
    )


@query(
    """
    select doc_id,
           case when doc_id % 3 = 0 then null else 'hdfs:///warehouse/' || source || '/online/data/' || lang end as target,
           source as task
    from documents
    """
)
def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output path, scheme and task name of input paths."""
    segment = F.when(F.col("doc_id") % 3 == 0, "data_backup_old").otherwise("data_backup")
    path = F.concat_ws("/", F.lit("/warehouse"), F.col("source"), F.lit("online"), segment, F.col("lang"))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        with_scheme(swap_segment(F.concat(path, F.lit("/")), "data_backup", "data")).alias("target"),
        segment_between(path, "warehouse", "online").alias("task"),
    )
