"""Text, format and CSV functions against plain Python."""

import csv
import io

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkweft.functions import formats, text

few = settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def apply(spark, values, function, kind="string"):
    rows = column(spark, values, kind).select("i", function(F.col("v")).alias("r")).collect()
    return [row["r"] for row in sorted(rows, key=lambda row: row["i"])]


def test_trim_equals_python_strip(spark):
    values = ["", " a ", "　\ta b ", "\x1c\x85x ", "​", "a", "\t 　"]
    assert apply(spark, values, text.trim_ws) == [v.strip() for v in values]


def test_split_keeps_trailing_cells(spark):
    assert apply(spark, ["a\tb\t\t", "", "a"], text.split_fields) == [["a", "b", "", ""], [""], ["a"]]


def test_split_pair(spark):
    got = apply(spark, [" a  b c ", "a", "x　y"], text.split_pair)
    assert got == [["a", "b c"], ["a"], ["x", "y"]]


def test_zero_pad_does_not_cut(spark):
    assert apply(spark, ["7", "1234567"], text.zero_pad) == ["00007", "1234567"]


def test_command_value(spark):
    values = ["x cmd=ab\tc", "cmd=", "cmd=a　b", "no", "cmd=1 cmd=2"]
    assert apply(spark, values, text.command_value) == ["ab", "", "a", "", "1"]
    assert apply(spark, values, text.has_command) == [True, False, True, False, True]


def test_path_functions(spark):
    paths = ["/w/t1/online/data_backup", "/data_backup_x/data_backup/data_backup/y/", "/w/none", "one"]
    swapped = apply(spark, paths, lambda c: text.swap_segment(c, "data_backup", "data"))
    assert swapped == ["/w/t1/online/data", "/data_backup_x/data/data_backup/y", None, None]
    assert apply(spark, paths, text.parent_name) == ["online", "data_backup", "w", "one"]
    assert apply(spark, ["/a/b", "a", "hdfs:///a", " /x "], text.with_scheme) == [
        "hdfs:///a/b", "hdfs:///a", "hdfs:///a", "hdfs:///x",
    ]
    between = apply(spark, ["/d/s/t9/online_res/b", "/x"], lambda c: text.segment_between(c, "s", "online_res"))
    assert between == ["t9", "/x"]


def test_corrections(spark):
    assert apply(spark, ["ab", "cd", None], lambda c: text.correct_text(c, {"ab": "x"})) == ["x", "cd", None]


def test_request_pairs(spark):
    value = 'a "keys":[{"key": "k1", "dict": "d1"}, {"key": "no", "dict": "no"}]\n"keys": [\n{ "key": "k2" , "dict": "d2"'
    assert [tuple(p) for p in apply(spark, [value], text.request_pairs)[0]] == [("d1", "k1"), ("d2", "k2")]


cells = st.lists(st.text(st.sampled_from(list('ab", \t　中')), max_size=6), min_size=1, max_size=5)


@few
@given(st.lists(cells, min_size=1, max_size=20))
def test_csv_line_and_cells_equal_python(spark, rows):
    rows = [row for row in rows if row != [""]]
    if not rows:
        return
    frame = spark.createDataFrame([(i, row) for i, row in enumerate(rows)], "i int, c array<string>")
    for length in {len(row) for row in rows}:
        same = frame.where(F.size("c") == length)
        line = text.csv_line([F.col("c")[i] for i in range(length)])
        for got in same.select("c", line.alias("line")).collect():
            out = io.StringIO()
            csv.writer(out, lineterminator="").writerow(got["c"])
            assert got["line"] == out.getvalue()
    lines = frame.select("i", "c", F.array_join(F.transform("c", lambda cell: text.csv_cell(cell)), ",").alias("v"))
    for got in lines.select("c", text.csv_cells(F.col("v")).alias("back")).collect():
        assert got["back"] == got["c"]


@few
@given(st.lists(st.text(st.sampled_from(list('a",')), min_size=1, max_size=8), min_size=1, max_size=20))
def test_csv_cells_of_any_text_equal_python(spark, lines):
    got = apply(spark, lines, text.csv_cells)
    assert got == [next(csv.reader([line])) for line in lines]


def test_csv_cells_of_long_quoted_cell(spark):
    body = 'x""y' * 20_000
    assert apply(spark, [f'"{body}",z'], text.csv_cells) == [[body.replace('""', '"'), "z"]]


@pytest.mark.parametrize(
    ("seconds", "wanted"),
    [(0.0, "0.00 秒"), (59.5, "59.50 秒"), (60.0, "1 分 0.00 秒"), (3599.25, "59 分 59.25 秒"), (3661.5, "1 小时 1 分 1.50 秒")],
)
def test_duration_text(spark, seconds, wanted):
    assert apply(spark, [seconds], formats.duration_text, "double") == [wanted]


def test_number_texts(spark):
    assert apply(spark, [1.5, -2.25, 0.0], formats.signed_percent, "double") == ["+1.50%", "-2.25%", "+0.00%"]
    assert apply(spark, [1234567], formats.grouped_text, "long") == ["1,234,567"]
    assert apply(spark, [0.0, 4.0], lambda c: formats.rate(F.lit(8.0), c), "double") == [0.0, 2.0]
