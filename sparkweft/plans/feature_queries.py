"""Queries on feature lines: filtering, extraction, diffs, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweft.functions.json_text import rewrite_members
from sparkweft.functions.text import parent_name
from sparkweft.operators.audit import audit_paths, lacking_paths, member_facts, nth_line, probe_marker
from sparkweft.operators.diff import (
    diff_examples,
    extract_features,
    feature_diff,
    feature_diff_counts,
    line_diff,
    line_diff_counts,
    parse_failures,
)
from sparkweft.plans.registry import query, spread_table, table
from sparkweft.plans.table_queries import document_lines

IDENTITY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def feature_lines(spark: SparkSession, sf_dir: str, changed: bool = False) -> DataFrame:
    """One JSON feature line per line item, next to its identity.

    Members come from the flags, with repeats and with members of other kinds. Some lines are broken, have trailing
    text, a NULL key or no member list. The changed version renames some keys and alters some members.
    """
    item = spread_table(spark, sf_dir, "lineitem").select(*IDENTITY, "l_returnflag", "l_linestatus")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber")
    third = F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("O")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    flag = F.col("l_returnflag")
    if changed:
        key = F.when(F.col("l_suppkey") % 13 == 0, F.concat(F.lit("new-"), key)).otherwise(key)
        flag = F.when(F.col("l_suppkey") % 7 == 0, F.lit("中")).otherwise(flag)

    def member(kind: str, value) -> object:
        return F.concat(F.lit(f'"{kind}\\t'), value, F.lit('"'))

    members = F.concat_ws(
        ", ",
        member("merge_field", flag),
        member("other", third),
        F.lit("7"),
        member("merge_field", F.col("l_linestatus")),
        F.lit("null"),
        member("merge_field", flag),
        F.lit('"merge_field"'),
        member("merge_field", third),
    )
    kind = F.col("l_partkey") % 11
    quoted = F.when(kind == 2, F.lit("null")).otherwise(F.concat(F.lit('"'), key, F.lit('"')))
    listed = F.when(kind == 1, F.lit('"none"')).otherwise(F.concat(F.lit("["), members, F.lit("]")))
    body = F.concat(F.lit('{"key": '), quoted, F.lit(', "fieldvalues": '), listed, F.lit(', "n": '))
    end = F.when(kind == 0, "").when(kind == 3, "} x").otherwise("}")
    line = F.concat(body, F.col("l_linenumber").cast("string"), F.lit(".50"), end)
    return item.select(*IDENTITY, line.alias("value"))


# The same lines in SQL: l.flag, l.third and l.key stand for the parts that the changed version alters.
_SQL_LINES = """
    {name} as (
      select *, case when kind = 2 then null else key end as shown_key,
             '{{"key": ' || case when kind = 2 then 'null' else '"' || key || '"' end || ', "fieldvalues": ' ||
             case when kind = 1 then '"none"'
                  else '["merge_field\\t' || flag || '", "other\\t' || third || '", 7, "merge_field\\t' || l_linestatus ||
                       '", null, "merge_field\\t' || flag || '", "merge_field", "merge_field\\t' || third || '"]' end ||
             ', "n": ' || l_linenumber::varchar || '.50' ||
             case when kind = 0 then '' when kind = 3 then '}} x' else '}}' end as line,
             case when kind = 1 then []::varchar[]
                  else list_filter([flag, l_linestatus, third],
                                   lambda x, i: list_position([flag, l_linestatus, third], x) = i) end as members,
             kind not in (0, 3) as parse_ok
      from (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_linestatus,
                   l_partkey % 11 as kind, ['A', 'N', 'O'][l_linenumber % 3 + 1] as third,
                   {flag} as flag, {key} as key
            from lineitem))
"""
_KEY = "l_orderkey::varchar || '-' || l_linenumber::varchar"
PLAIN_SQL = _SQL_LINES.format(name="plain", flag="l_returnflag", key=_KEY)
CHANGED_SQL = _SQL_LINES.format(
    name="changed",
    flag="case when l_suppkey % 7 = 0 then '中' else l_returnflag end",
    key=f"case when l_suppkey % 13 = 0 then 'new-' else '' end || {_KEY}",
)


@query(
    f"""
    with {CHANGED_SQL}
    select l_orderkey, l_linenumber::bigint as l_linenumber, l_partkey, l_suppkey, l_extendedprice,
           case when not parse_ok then line
                else '{{"key": ' || case when shown_key is null then 'null' else '"' || shown_key || '"' end ||
                     ', "fieldvalues": ' ||
                     case when kind = 1 then '"none"'
                          else '[' || array_to_string(list_transform(members, lambda m: '"merge_field\\t' || m || '"'), ', ')
                               || ']' end ||
                     ', "n": ' || l_linenumber::varchar || '.5}}' end as value
    from changed
    """
)
def feature_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole lines rewritten with only their wanted members."""
    lines = feature_lines(spark, sf_dir, changed=True)
    return lines.select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), *IDENTITY[2:],
        rewrite_members(F.col("value")).alias("value"),
    )


@query(
    f"""
    with {PLAIN_SQL}
    select l_orderkey, l_linenumber::bigint as l_linenumber, l_partkey, l_suppkey, l_extendedprice,
           case when parse_ok then coalesce(shown_key, sha256(line)) end as key,
           case when parse_ok then array_to_string(list_transform(members, lambda m: 'merge_field' || chr(9) || m), '|')
                else '' end as merge_fields,
           parse_ok::integer::bigint as parse_ok
    from plain
    """
)
def feature_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key and wanted members of every line, with the lines that do not parse."""
    found = extract_features(feature_lines(spark, sf_dir))
    return found.select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), *IDENTITY[2:],
        "key",
        F.array_join("merge_fields", "|").alias("merge_fields"),
        F.col("parse_ok").cast("int").cast("long").alias("parse_ok"),
    )


@query(
    f"""
    with {PLAIN_SQL}
    select count(*) filter (where parse_ok) as valid_lines, count(*) filter (where not parse_ok) as failed_lines,
           count(*) filter (where parse_ok and kind <> 1) as member_lines
    from plain
    """
)
def feature_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that parse, that fail, and that have a wanted member; each line is parsed once."""
    features = extract_features(feature_lines(spark, sf_dir).select("value"))
    return parse_failures(features, member_lines=F.count_if(F.size("merge_fields") > 0))


DIFF_SQL = f"""
    with {PLAIN_SQL}, {CHANGED_SQL},
    b as (select coalesce(shown_key, sha256(line)) as key,
                 min(list_transform(members, lambda m: 'merge_field' || chr(9) || m)) as fields, count(*) as n
          from plain where parse_ok group by 1),
    d as (select coalesce(shown_key, sha256(line)) as key,
                 min(list_transform(members, lambda m: 'merge_field' || chr(9) || m)) as fields, count(*) as n
          from changed where parse_ok group by 1),
    diff as (
      select coalesce(b.key, d.key) as key, array_to_string(b.fields, '|') as backup_merge_fields,
             array_to_string(d.fields, '|') as data_merge_fields,
             coalesce(b.n, 0) as backup_rows, coalesce(d.n, 0) as data_rows,
             case when d.key is null then 'only_in_backup' when b.key is null then 'only_in_data'
                  when b.fields = d.fields then 'same' else 'diff' end as status
      from b full join d on b.key = d.key)
"""


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = extract_features(feature_lines(spark, sf_dir).select("value"))
    after = extract_features(feature_lines(spark, sf_dir, changed=True).select("value"))
    return feature_diff(before, after)


@query(DIFF_SQL + "select * from diff")
def feature_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of the feature lines compared key by key."""
    return _diff(spark, sf_dir).withColumns(
        {name: F.array_join(name, "|") for name in ("backup_merge_fields", "data_merge_fields")}
    )


@query(
    DIFF_SQL
    + """
    select key, backup_merge_fields, data_merge_fields from diff where status = 'diff' order by key limit 5
    """
)
def feature_diff_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five keys whose lists differ."""
    return diff_examples(_diff(spark, sf_dir)).select(
        "key", *[F.array_join(name, "|").alias(name) for name in ("backup_merge_fields", "data_merge_fields")]
    )


@query(
    DIFF_SQL
    + """
    select count(*) filter (where backup_rows > 0) as backup_keys, count(*) filter (where data_rows > 0) as data_keys,
           count(*) filter (where data_rows > 0) - count(*) filter (where backup_rows > 0) as key_difference,
           sum(greatest(backup_rows - 1, 0))::bigint as backup_repeats,
           sum(greatest(data_rows - 1, 0))::bigint as data_repeats,
           count(*) filter (where status = 'only_in_backup') as only_in_backup,
           count(*) filter (where status = 'only_in_data') as only_in_data,
           count(*) filter (where status = 'diff') as diff, count(*) filter (where status = 'same') as same
    from diff
    """
)
def feature_diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the key-by-key comparison."""
    return feature_diff_counts(_diff(spark, sf_dir))


LINE_SIDES_SQL = """
    with a as (select unnest(string_split(text, chr(10))) as value from documents),
    b as (select case when length(value) % 5 = 0 then value || '!' else value end as value from a),
    sides as (
      select coalesce(x.value, y.value) as value,
             case when y.value is null then 'only_in_1' when x.value is null then 'only_in_2' else 'in_both' end as side
      from (select distinct value from a) x full join (select distinct value from b) y on x.value = y.value)
"""


def _line_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = document_lines(spark, sf_dir).select("value")
    longer = F.concat("value", F.lit("!"))
    changed = lines.select(F.when(F.length("value") % 5 == 0, longer).otherwise(F.col("value")).alias("value"))
    return line_diff(lines, changed)


@query(LINE_SIDES_SQL + "select value, side from sides")
def line_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct lines of two versions of the documents, by side."""
    return _line_sides(spark, sf_dir)


@query(
    LINE_SIDES_SQL
    + """
    select count(*) filter (where side <> 'only_in_2') as distinct_1, count(*) filter (where side <> 'only_in_1') as distinct_2,
           count(*) filter (where side = 'only_in_1') as only_in_1, count(*) filter (where side = 'only_in_2') as only_in_2,
           count(*) filter (where side = 'in_both') as in_both
    from sides
    """
)
def line_diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five counts of a line comparison."""
    return line_diff_counts(_line_sides(spark, sf_dir))


_AUDIT_SQL = """
    with requested as (
      select distinct '/warehouse/' || source || '/data_backup' as path, source as task_name from documents
      union select '/warehouse/' || n_name || '/data_backup', n_name from nation),
    facts as (
      select '/warehouse/' || source || '/data_backup' as path, bool_or(lang = 'es' and n_chars > 9000) as has_field
      from documents group by source),
    audit as (
      select r.path, r.task_name, f.path is not null as path_exists, f.has_field
      from requested r left join facts f on r.path = f.path)
"""


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("source", "lang", "n_chars")

    def path(name: str):
        return F.concat(F.lit("/warehouse/"), F.col(name), F.lit("/data_backup")).alias("path")

    member = F.when((F.col("lang") == "es") & (F.col("n_chars") > 9000), F.lit('"merge_field\\tes"')).otherwise('"es"')
    lines = documents.select(path("source"), F.concat(F.lit('{"fieldvalues": ['), member, F.lit("]}")).alias("value"))
    requested = (
        documents.select(path("source")).distinct().unionAll(table(spark, sf_dir, "nation").select(path("n_name")))
    )
    return audit_paths(requested, member_facts(lines, "path"))


@query(
    _AUDIT_SQL
    + """
    select path, task_name, path_exists::integer::bigint as path_exists, has_field::integer::bigint as has_field from audit
    """
)
def path_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every requested path: does it exist, does it have a wanted member."""
    return _audit(spark, sf_dir).select(
        "path",
        parent_name(F.col("path")).alias("task_name"),
        *[F.col(name).cast("int").cast("long").alias(name) for name in ("path_exists", "has_field")],
    )


@query(_AUDIT_SQL + "select path from audit where path_exists and not has_field")
def path_lacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that exist without a wanted member."""
    return lacking_paths(_audit(spark, sf_dir))


@query(
    """
    with lines as (
      select doc_id, unnest(string_split(text, chr(10))) as value, generate_subscripts(string_split(text, chr(10)), 1) as n
      from documents)
    select doc_id, max(n) as line_no, arg_max(value, n) as value,
           case when contains(arg_max(value, n), 'the') then 'present' else 'absent' end as status
    from lines where n <= 5 group by doc_id
    """
)
def nth_line_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifth line of every document, its last line when it is shorter, tested for a marker."""
    lines = document_lines(spark, sf_dir).withColumnRenamed("line_no", "place")
    return probe_marker(nth_line(lines, ["doc_id"], ["place"], 5), "the")
