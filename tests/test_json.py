"""JSON rules against Python's json module."""

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweft.functions import json_text
from sparkweft.operators.diff import diff_examples, extract_features, feature_diff, feature_diff_counts, parse_failures
from sparkweft.operators.logs import params_records

M = "merge_field\t"
LINES = [
    json.dumps({"key": "a", "fieldvalues": [M + "x", "other", 1, None, {"z": 1}, M + "y", M + "x", "merge_field"], "n": 1.50}),
    '{"n": 1.50, "key": 7, "fieldvalues": "no list", "t": "中\\u00e9"}',
    json.dumps({"key": "q", "fieldvalues": json.dumps([M + "x"])}),
    '{"key": null, "fieldvalues": []}',
    '{"fieldvalues": ["merge_field\\tz"]}',
    '{"key": true}',
    '{"key": "a"} x',
    '{"key": "a"}{"key": "b"}',
    '{"key": "a"},{"key": "b"}',
    '{"key": "a"}]',
    '{"key": "a",}',
    "{'key': 'a'}",
    "[1, 2]",
    "5",
    "null",
    "bad{",
    "",
    "  ",
    ' {"key": "s", "fieldvalues": [[]]} ',
    '{"key": "d", "key": "e"}',
]


def valid(line):
    try:
        return isinstance(json.loads(line), dict)
    except ValueError:
        return False


def frame(spark, lines):
    return spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i int, value string")


def test_parse_ok_equals_python(spark):
    got = {r["i"]: r for r in extract_features(frame(spark, [*LINES, None])).collect()}
    for i, line in enumerate(LINES):
        assert got[i]["parse_ok"] == valid(line), line
    assert not got[len(LINES)]["parse_ok"]


def test_extracted_members_and_keys(spark):
    got = {r["i"]: r for r in extract_features(frame(spark, LINES)).collect()}
    for i, line in enumerate(LINES):
        if not valid(line):
            assert got[i]["key"] is None and got[i]["merge_fields"] == []
            continue
        record = json.loads(line)
        members = record.get("fieldvalues") if isinstance(record.get("fieldvalues"), list) else []
        wanted = list(dict.fromkeys(m for m in members if isinstance(m, str) and m.startswith(M)))
        assert got[i]["merge_fields"] == wanted
    assert [got[i]["key"] for i in (0, 1, 5, 18, 19)] == ["a", "7", "true", "s", "e"]
    assert len(got[3]["key"]) == len(got[4]["key"]) == 64 and got[3]["key"] != got[4]["key"]
    assert parse_failures(extract_features(frame(spark, LINES))).head()["valid_lines"] == sum(map(valid, LINES))


def test_has_wanted_member(spark):
    rows = frame(spark, LINES).select("i", json_text.has_wanted_member(F.col("value")).alias("h")).collect()
    assert {r["i"] for r in rows if r["h"]} == {0, 4}


def test_rewrite_keeps_other_fields(spark):
    rows = frame(spark, [*LINES, None]).select("i", json_text.rewrite_members(F.col("value")).alias("v")).collect()
    got = {r["i"]: r["v"] for r in rows}
    assert got[len(LINES)] is None
    for i, line in enumerate(LINES):
        if not valid(line):
            assert got[i] == line
        else:
            assert json.loads(got[i]) == {
                **json.loads(line),
                **({"fieldvalues": [m for m in dict.fromkeys(map(str, json.loads(line)["fieldvalues"])) if m.startswith(M)]}
                   if isinstance(json.loads(line).get("fieldvalues"), list) else {}),
            }
    assert got[1] == '{"n": 1.5, "key": 7, "fieldvalues": "no list", "t": "中é"}'


def test_rewrite_is_idempotent(spark):
    once = frame(spark, LINES).select(json_text.rewrite_members(F.col("value")).alias("value"))
    twice = once.select(json_text.rewrite_members(F.col("value")).alias("value"))
    assert once.collect() == twice.collect()


def features(spark, rows):
    schema = "key string, merge_fields array<string>, parse_ok boolean, n int"
    return spark.createDataFrame([(k, m, True, i) for i, (k, m) in enumerate(rows)], schema)


def test_diff_compares_lists_not_joined_text(spark):
    left = features(spark, [("a", ["x|y"]), ("b", []), ("c", ["1"]), ("c", ["0"]), ("only", [])])
    right = features(spark, [("a", ["x", "y"]), ("b", []), ("c", ["1"]), ("new", ["n"])])
    got = {r["key"]: r for r in feature_diff(left, right, order="n").collect()}
    assert {k: r["status"] for k, r in got.items()} == {
        "a": "diff", "b": "same", "c": "same", "only": "only_in_backup", "new": "only_in_data",
    }
    assert got["c"]["backup_rows"] == 2
    assert [r["key"] for r in diff_examples(feature_diff(left, right, order="n")).collect()] == ["a"]
    counts = feature_diff_counts(feature_diff(left, right, order="n")).head()
    assert (counts["backup_keys"], counts["data_keys"], counts["backup_repeats"]) == (4, 4, 1)


def test_diff_with_itself_is_all_same(spark):
    found = extract_features(frame(spark, LINES))
    assert {r["status"] for r in feature_diff(found, found).collect()} == {"same"}


def test_diff_with_an_empty_side(spark):
    left, empty = features(spark, [("a", [])]), features(spark, [("a", [])]).limit(0)
    assert [r["status"] for r in feature_diff(left, empty).collect()] == ["only_in_backup"]
    assert [r["status"] for r in feature_diff(empty, left).collect()] == ["only_in_data"]


PARAMS = [
    ('{"params": {"a": "1", "k": "x"}}', ("1", "x")),
    ('t {"z" "params": {"a": 2, "k": "y"}} tail', None),  # the greedy match takes the outer brace too
    ('t "params": {"a": 2, "k": "y"} tail', ("2", "y")),
    ("params={'a': '3', 'k': 'x'}", ("3", "x")),
    ('params: {"a": {"b": [1, {}]}, "k": null}', ('{"b":[1,{}]}', "")),
    ('{"params": {}}', None),
    ("params={}", None),
    ('{"params": "text"}', None),
    ('{"params": {"other": 1}}', ("", "")),
    ('{"params": [1], "x": 1} params={"a": "4"}', ("4", "")),
    ("xparams={1}", None),
    ("", None),
]


def test_params_of_mixed_lines(spark):
    for line, wanted in PARAMS:
        rows = params_records(frame(spark, [line]), "i", fields=("a", "k"), key="k").collect()
        assert [(r["a"], r["k"]) for r in rows] == ([] if wanted is None else [wanted]), line


def test_params_keep_last_in_first_place(spark):
    lines = ['{"params": {"k": "%s", "a": "%d"}}' % (k, i) for i, k in enumerate("xyxzy")]
    lines += ['{"params": {"a": "no key 1"}}', '{"params": {"a": "no key 2"}}']
    rows = params_records(frame(spark, lines), "i", fields=("a", "k"), key="k").orderBy("first_position").collect()
    assert [(r["a"], r["k"]) for r in rows] == [("2", "x"), ("4", "y"), ("3", "z"), ("no key 2", "")]


def test_answers(spark):
    body = '{"start_point": "s", "vehicles": [{"supplier": "v", "price": 3}]}'
    lines = [f"text\n```json\n{body}\n```\nmore", f"```{body}```", f"  {body}\n", "```json\n{bad\n```", " ", None]
    parsed = frame(spark, lines).select("i", json_text.parse_answer(F.col("value"), json_text.TRIP_ANSWER).alias("a"))
    got = {r["i"]: r["a"] for r in parsed.collect()}
    for i in range(3):
        assert got[i]["start_point"] == "s" and got[i]["vehicles"][0]["price"] == "3"
    assert got[3] is got[4] is got[5] is None


def test_answer_is_built_once_per_row(spark):
    body = '{"start_point": "s", "vehicles": [{"supplier": "v", "price": 3}]}'
    answer = F.format_string("```json\n%s\n```", F.col("value"))
    parsed = frame(spark, [body]).select(json_text.parse_answer(answer, json_text.TRIP_ANSWER).alias("a"))
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count("format_string(") == 1
    assert parsed.head()["a"]["vehicles"][0]["price"] == "3"


def test_parse_object_keeps_good_fields(spark):
    fields = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    row = frame(spark, ['{"a": "text", "b": "ok"}']).select(json_text.parse_object(F.col("value"), fields).alias("p")).head()
    assert row["p"]["a"] is None and row["p"]["b"] == "ok"


def test_forged_ends_are_refused(spark):
    fields = T.StructType([T.StructField("a", T.StringType())])
    forged = [
        '{"a":"1"},null,null,null] junk', '{"a":"1"} , null,null,{}]', '{"a":"1"},null,null,null],"end":1}', '{"a":"1"},"end":1} junk ]',
        '{"a":"1"},{"a":"2"},{"a":"3"},{"a":"4"}]\n', '{"a":"1"}]', '{"a":"1"}, "x": [1,2], "end": 1}',
    ]
    right = ['{"a":"1","b":[{"c":1},{"c":2}]}', ' {"a":"1","b":{"c":"},null,null,null]"},"d":[null,null]} ', '{"b":[{"a":2}, null], "a":"1"}', '{"a":"1","a":"1","b":[{},{}]}']
    frame = spark.createDataFrame([(i, line) for i, line in enumerate(forged + right)], "id long, value string")
    got = dict(frame.select("id", json_text.parse_object(F.col("value"), fields)["a"]).collect())
    assert [got[i] for i in range(len(forged))] == [None] * len(forged)
    assert [got[len(forged) + i] for i in range(len(right))] == ["1"] * len(right)


def test_feature_failures_parse_each_line_once(spark):
    from sparkweft.plans.catalog import QUERIES

    plan = QUERIES["feature_failures"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
