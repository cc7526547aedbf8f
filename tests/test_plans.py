"""What the physical plans must and must not hold."""

import pytest

from sparkweft.plans.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"kmeans_groups"}))
def test_no_cross_joins(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize(("name", "parsers"), [("feature_extract", 1), ("feature_reconcile", 2), ("token_totals", 1)])
def test_lines_are_parsed_once(spark, name, parsers):
    assert plan(QUERIES[name](spark, SF_DIR)).count("from_json(") == parsers


@pytest.mark.parametrize(
    ("name", "part"),
    [
        ("row_filter", "PushedFilters: [IsNotNull(c_acctbal), IsNotNull(c_mktsegment), GreaterThan(c_acctbal,5000.0)"),
        ("storage_estimate", "ReadSchema: struct<text:string>"),
        ("deviations", "ReadSchema: struct<event_id:bigint,value:double>"),
        ("keep_first_rows", "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>"),
    ],
)
def test_scans_read_what_is_needed(spark, name, part):
    assert part in plan(QUERIES[name](spark, SF_DIR))


@pytest.mark.parametrize("name", ["nth_line_probe", "series_signal", "vector_topk"])
def test_top_rows_are_cut_before_the_shuffle(spark, name):
    assert plan(QUERIES[name](spark, SF_DIR)).count("WindowGroupLimit") == 2


def test_line_diff_has_one_shuffle(spark):
    assert plan(QUERIES["line_reconcile"](spark, SF_DIR)).count("Exchange hashpartitioning") == 1


def test_stores_are_not_shuffled(spark):
    text = plan(QUERIES["key_lookup_stores"](spark, SF_DIR))
    shuffled = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert text.count("SortMergeJoin") >= 2 and text.count("Bucketed: true, ") == 2
    # distinct keys of the requests, and at most both sides of the last join
    assert len(shuffled) <= 3
