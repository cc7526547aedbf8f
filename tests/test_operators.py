"""Row, ordinal, skew, dedupe, sample, log and series operators."""

import random

import pytest
from pyspark.sql import functions as F

from sparkweft.functions import boxes, media, signals
from sparkweft.operators import audit, dedupe, diff, logs, lookup, ordinal, rows, sample, series, setops, stats


def test_ordinal_follows_order_whatever_the_partitions(spark):
    values = list(range(500))
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v, str(v)) for v in values], "v int, t string").repartition(7)
    got = {r["v"]: r["ordinal"] for r in ordinal.with_ordinal(df, ["v"]).collect()}
    assert got == {v: v + 1 for v in range(500)}


def test_ordinal_with_a_key_on_a_third_of_the_rows(spark):
    df = spark.createDataFrame([(0 if i % 3 == 0 else i, "same" if i % 3 == 0 else str(i)) for i in range(300)], "k int, t string")
    got = ordinal.with_ordinal(df, ["k"]).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in got] == list(range(1, 301))
    assert [r["k"] for r in got] == sorted(r["k"] for r in got)


def test_ordinal_of_maps_and_of_nothing(spark):
    df = spark.createDataFrame([(i, {"a": i}) for i in range(5)], "i int, m map<string,int>")
    assert [r["ordinal"] for r in ordinal.with_ordinal(df, ["i"]).orderBy("i").collect()] == [1, 2, 3, 4, 5]
    assert ordinal.with_ordinal(df.limit(0), ["i"]).count() == 0


def test_group_ordinal_with_null_and_hot_groups(spark):
    data = [("hot" if i % 2 else None if i % 4 else f"g{i % 5}", i) for i in range(400)]
    df = spark.createDataFrame(data, "g string, i int").repartition(6)
    wanted, counters = {}, {}
    for g, i in sorted(data, key=lambda row: row[1]):
        counters[g] = counters.get(g, -1) + 1
        wanted[i] = counters[g]
    got = {r["i"]: r["n"] for r in ordinal.with_group_ordinal(df, ["g"], ["i"], "n", start=0).collect()}
    assert got == wanted


@pytest.mark.parametrize("size", [1, 2, 5, 100])
def test_chunks(spark, size):
    df = spark.range(11)
    got = ordinal.with_chunk_id(df, ["id"], size).collect()
    assert {r["id"]: r["chunk_id"] for r in got} == {i: i // size for i in range(11)}


def test_work_on_chunks(spark):
    def total(rows):
        return rows.groupby("chunk_id", as_index=False)["id"].sum()

    chunks = ordinal.with_chunk_id(spark.range(5), ["id"], 2)
    got = ordinal.map_chunks(chunks, total, "chunk_id long, id long").collect()
    assert {r["chunk_id"]: r["id"] for r in got} == {0: 1, 1: 5, 2: 4}


def test_chunk_size_must_be_positive(spark):
    with pytest.raises(ValueError):
        ordinal.with_chunk_id(spark.range(3), ["id"], 0)


def test_member_lists_do_not_depend_on_other_groups(spark):
    df = spark.createDataFrame([("a" if i < 8 else "b", i) for i in range(12)], "g string, m int")
    got = ordinal.member_lists(df, "g", "m", list_rows=10).collect()
    assert sorted((r["g"], r["part"], r["members"]) for r in got) == [("a", 0, list(range(8))), ("b", 0, [8, 9, 10, 11])]


def test_member_lists_are_whole_and_bounded(spark):
    df = spark.createDataFrame([("hot" if i % 3 else "cold", i) for i in range(90)], "g string, m int")
    got = ordinal.member_lists(df, "g", "m", list_rows=7).orderBy("part", "g").collect()
    assert max(len(r["members"]) for r in got) <= 7
    for group in ("hot", "cold"):
        merged = [m for r in got if r["g"] == group for m in r["members"]]
        assert merged == [i for i in range(90) if (i % 3 != 0) == (group == "hot")]


def test_reorder_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert rows.reorder_columns(df, ["c", "zz", "a"]).columns == ["c", "a", "b"]
    with pytest.raises(ValueError):
        rows.reorder_columns(df, ["zz"], strict=True)


def test_positional_rows(spark):
    lines = spark.createDataFrame([("a\tb\tc\td\t",), ("a",), ("\t\t",), (" ",), ("",), ("x\t\tz",)], "value string")
    got = rows.split_positional(lines, ["p", "q", "r"]).collect()
    assert [tuple(r) for r in got] == [
        ("a", "b", "c", ["d", ""]), ("a", "", "", []), ("x", "", "z", []),
    ]


def test_filter_equal(spark):
    df = spark.createDataFrame([("x", 1), ("y", 2)], "city string, n int")
    assert rows.filter_equal(df, "city", "x").count() == 1
    assert rows.filter_equal(df, "city", "").count() == rows.filter_equal(df, "none", None).count() == 2
    with pytest.raises(ValueError):
        rows.filter_equal(df, "none", "x")
    with pytest.raises(ValueError):
        rows.filter_equal(df, "city", "z")


def test_filter_rows_by_column_and_by_function(spark):
    df = spark.createDataFrame([("a", "25"), ("b", "30"), ("c", "25")], "name string, age string")
    by_column = rows.filter_rows(df, F.col("age") == "25").collect()
    assert by_column == rows.filter_rows(df, lambda batch: batch["age"] == "25").collect()
    assert [r["name"] for r in by_column] == ["a", "c"]


def test_filter_status_with_dates(spark):
    df = spark.createDataFrame(
        [("n1", " yes ", "2026/02/07 x"), ("　n2", "yes", "2026/02/10"), ("", "yes", "2026/02/07"), ("n3", "no", "2026/02/07")],
        "name string, flag string, at string",
    )
    assert {r["name"] for r in rows.filter_status(df, "name", "flag", "yes").collect()} == {"n1", "n2"}
    dated = rows.filter_status(df, "name", "flag", "yes", "at", ["2026/02/07", "2026/02/08"])
    assert [r["name"] for r in dated.collect()] == ["n1"]


def test_keep_first_and_last(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "a", "z"), (4, None, "n"), (5, None, "m")], "n int, k string, v string")
    first = {r["k"]: (r["v"], r["c"]) for r in dedupe.keep_first(df, ["k"], ["n"], copies="c").collect()}
    assert first == {"a": ("x", 2), "b": ("y", 1), None: ("n", 2)}
    last = dedupe.keep_last(df, F.col("k"), "n").orderBy("first_position").collect()
    assert [(r["k"], r["v"]) for r in last] == [("a", "z"), ("b", "y"), (None, "m")]
    order = dedupe.ordered_distinct(df, ["k"], "n").orderBy("first_position").collect()
    assert [r["k"] for r in order] == ["a", "b", None]
    assert dedupe.distinct_rows(df.unionAll(df)).count() == 5


@pytest.mark.parametrize("n", [0, 1, 40, 199, 200, 500])
def test_sample_size_and_repeatability(spark, n):
    df = spark.range(200).withColumn("t", F.lit("x"))
    first = sorted(r["id"] for r in sample.sample_rows(df, n, ["id"], seed=1).collect())
    again = sorted(r["id"] for r in sample.sample_rows(df.repartition(5), n, ["id"], seed=1).collect())
    assert first == again and len(set(first)) == min(n, 200)


def test_sample_without_seed_and_with_bad_size(spark):
    assert sample.sample_rows(spark.range(30), 7).distinct().count() == 7
    with pytest.raises(ValueError):
        sample.sample_rows(spark.range(3), -1)


def test_line_diff_counts_add_up(spark):
    left = spark.createDataFrame([("a",), ("b",), ("b",), ("",)], "value string")
    right = spark.createDataFrame([("b",), ("c",), (" b",)], "value string")
    sides = {r["value"]: r["side"] for r in diff.line_diff(left, right).collect()}
    assert sides == {"a": "only_in_1", "": "only_in_1", "b": "in_both", "c": "only_in_2", " b": "only_in_2"}
    counts = diff.line_diff_counts(diff.line_diff(left, right)).head()
    assert counts["only_in_1"] + counts["in_both"] == counts["distinct_1"]
    assert counts["only_in_2"] + counts["in_both"] == counts["distinct_2"]
    assert {r["side"] for r in diff.line_diff(left, left).collect()} == {"in_both"}
    assert {r["side"] for r in diff.line_diff(left, left.limit(0)).collect()} == {"only_in_1"}


def test_set_operations(spark):
    a = spark.createDataFrame([(" x",), ("y",), ("",), ("x",)], "value string")
    b = spark.createDataFrame([("x　",), ("z",)], "value string")
    assert [r["value"] for r in setops.common_lines(a, b).collect()] == ["x"]
    assert [r["value"] for r in setops.missing_names(a, b).collect()] == ["", " x", "x", "y"]
    assert setops.union_names(a, b).count() == 6
    with pytest.raises(ValueError):
        setops.union_names()


def test_replicas(spark):
    requests = spark.createDataFrame([("d", "1"), ("d", "1"), ("d", "2"), ("e", "1")], "dict string, key string")
    a = spark.createDataFrame([("d", "1", "x"), ("d", "2", "y")], "dict string, key string, value string")
    b = spark.createDataFrame([("d", "1", "x"), ("d", "2", "z")], "dict string, key string, value string")
    got = sorted(tuple(r) for r in lookup.compare_replicas(requests, a, b, ["dict", "key"]).collect())
    assert [r[4] for r in got] == [True, True, False, True] and got[3][2] is None


def test_summary(spark):
    df = spark.createDataFrame([("x", "p", 1), ("x", "q", 2), (None, "p", 4)], "city string, supplier string, n int")
    got = stats.summary_by(df, ["city", "supplier"], {"total": F.sum("n")}).collect()
    assert {(r["level"], r["member"]): r["total"] for r in got} == {
        ("total", None): 7, ("city", "x"): 3, ("city", None): 4, ("supplier", "p"): 5, ("supplier", "q"): 2,
    }


def test_batch_records(spark):
    text = "并发调用ocr模型效率：{}张图片，耗时{}秒"
    lines = [text.format(4, "2.0"), text.format(3, "1.2.3"), "no", text.format(5, "0"), "x" + text.format(1, "0.5")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "i int, value string")
    numbered = logs.number_records(logs.batch_records(df), ["i"]).orderBy("record_no").collect()
    assert [(r["record_no"], r["images"], r["seconds"], r["images_per_second"]) for r in numbered] == [
        (1, 4, 2.0, 2.0), (2, 3, None, 0.0), (3, 5, 0.0, 0.0), (4, 1, 0.5, 2.0),
    ]
    total = logs.batch_statistics(logs.batch_records(df)).head()
    assert (total["records"], total["total_images"], total["total_seconds"], total["total_time"]) == (4, 13, 2.5, "2.50 秒")
    assert logs.batch_statistics(logs.batch_records(df.limit(0))).head()["records"] == 0


def test_fold_pieces(spark):
    pieces = [
        (1, 0, '{"response": "a", "done": false}'), (1, 1, "bad"), (1, 2, '{"message": {"content": "b"}}'),
        (1, 3, '{"response": "c", "done": true}'), (1, 4, '{"response": "late"}'), (2, 0, '{"response": "open"}'),
    ]
    df = spark.createDataFrame(pieces, "id int, n int, value string")
    got = {(r["id"], r["part"]): (r["text"], r["finished"]) for r in logs.fold_pieces(df, "id", "n").collect()}
    assert got == {(1, 0): ("abc", True), (2, 0): ("open", False)}
    parts = logs.fold_pieces(df, "id", "n", piece_rows=2).orderBy("id", "part").collect()
    assert [(r["id"], r["part"], r["text"]) for r in parts] == [(1, 0, "ab"), (1, 1, "c"), (2, 0, "open")]
    assert {(r["id"], r["pieces"], r["finished"]) for r in parts} == {(1, 3, True), (2, 1, False)}
    late = spark.createDataFrame([(7, 998 + i, '{"response": "x", "done": %s}' % str(i == 3).lower()) for i in range(4)], df.schema)
    assert [(r["part"], r["text"], r["finished"]) for r in logs.fold_pieces(late, "id", "n").collect()] == [(0, "xxxx", True)]


def test_fold_pieces_of_an_answer_without_name(spark):
    rows = [(None, 1, "a", True), (None, 2, "b", False), ("x", 1, "c", False)]
    lines = spark.createDataFrame(rows, "id string, n long, response string, done boolean")
    lines = lines.select("id", "n", F.to_json(F.struct("response", "done")).alias("value"))
    got = {(r["id"], r["text"], r["pieces"], r["finished"]) for r in logs.fold_pieces(lines, "id", "n").collect()}
    assert got == {(None, "a", 1, True), ("x", "c", 1, False)}


def test_token_usage(spark):
    documents = ['{"prompt_eval_count": 3, "eval_count": 5, "eval_duration": 1000000000, "total_duration": 2000000000}', '{"eval_count": 1}', "bad"]
    got = logs.token_usage(spark.createDataFrame([(d,) for d in documents], "value string")).head()
    assert (got["responses"], got["total_tokens"], got["output_seconds"]) == (2, 9, 1.0)
    assert (got["output_tokens_per_second"], got["input_tokens_per_second"]) == (6.0, 0.0)


def test_storage_estimate(spark):
    df = spark.createDataFrame([("中",), ("abcde",)], "t string")
    got = logs.estimate_storage(df, F.col("t"), items=1 << 30).head()
    assert (got["bytes_per_item"], got["plain_gb"], round(got["compressed_10pct_gb"], 9)) == (4.0, 4.0, 0.4)


@pytest.mark.parametrize(("points", "ok"), [(169, False), (170, True), (171, True)])
def test_signal_needs_enough_points(spark, points, ok):
    df = spark.range(points).select(F.lit("s").alias("s"), F.col("id").alias("w"), F.lit(2.0).alias("v"))
    df = df.unionAll(spark.range(5).select(F.lit("s"), F.col("id") + 1000, F.lit(None).cast("double")))
    row = series.series_signals(df, "s", "w", "v", price=F.lit(3.0)).head()
    assert row["status"] == ("ok" if ok else "short history")
    assert row["trailing_mean"] == (2.0 if ok else None) and row["relation"] == ("≥" if ok else None)
    assert row["advice"] == ("分批卖 1/3" if False else "分批再卖 1/3" if ok else None)


def test_trailing_mean_over_block_borders(spark):
    data = [("a" if i % 3 else "b", i, float(i * i % 17)) for i in range(120)]
    df = spark.createDataFrame(data, "s string, w int, v double")
    got = {r["w"]: r["trailing_mean"] for r in series.trailing_mean(df, "s", "w", "v", width=5, block_rows=8).collect()}
    for name in "ab":
        mine = [(w, v) for s, w, v in data if s == name]
        for i, (w, _) in enumerate(mine):
            wanted = sum(v for _, v in mine[i - 4 : i + 1]) / 5 if i >= 4 else None
            assert got[w] == (None if wanted is None else pytest.approx(wanted))


def test_trailing_mean_of_width_one_and_wider_than_the_series(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(4)], "s string, w int, v double")
    assert [r["trailing_mean"] for r in series.trailing_mean(df, "s", "w", "v", 1).orderBy("w").collect()] == [0, 1, 2, 3]
    assert {r["trailing_mean"] for r in series.trailing_mean(df, "s", "w", "v", 9, block_rows=2).collect()} == {None}


def test_chart_points(spark):
    charts = [
        ("adj", '{"chart":{"result":[{"meta":{"regularMarketPrice":9.5},"indicators":{"adjclose":[{"adjclose":[1,null,2.5]}],"quote":[{"close":[7,8,9]}]}}]}}'),
        ("raw", '{"chart":{"result":[{"meta":{"regularMarketPrice":4},"indicators":{"adjclose":[{"adjclose":[]}],"quote":[{"close":[7,null]}]}}]}}'),
        ("none", '{"chart":{"result":[]}}'),
    ]
    got = series.chart_points(spark.createDataFrame(charts, "ticker string, value string"), "ticker").collect()
    found = {}
    for r in got:
        found.setdefault(r["ticker"], []).append((r["price"], r["week"], r["close"]))
    assert found == {"adj": [(9.5, 0, 1.0), (9.5, 1, 2.5)], "raw": [(4.0, 0, 7.0)], "none": [(None, None, None)]}


@pytest.mark.parametrize(
    ("percent", "wanted"),
    [(-5.0, "考虑买入"), (0.0, "考虑买入"), (0.1, "持有观望"), (15.0, "持有观望"), (30.0, "分批卖 1/3"), (50.0, "分批再卖 1/3"), (50.1, "分批卖剩余")],
)
def test_advice(spark, percent, wanted):
    assert spark.range(1).select(signals.advice(F.lit(percent)).alias("a")).head()["a"] == wanted


@pytest.mark.parametrize(
    ("width", "height", "tier"),
    [(3840, 2160, "4K (2160p)"), (2160, 3840, "4K (2160p)"), (1440, 1440, "2K (1440p)"), (1920, 1080, "1080p"),
     (1079, 1920, "720p"), (480, 800, "480p"), (640, 360, "360p"), (240, 300, "240p"), (320, 239, "320x239 (低清)")],
)
def test_quality_tier(spark, width, height, tier):
    assert spark.range(1).select(media.quality_tier(F.lit(width), F.lit(height)).alias("t")).head()["t"] == tier


def test_probe_size(spark):
    probes = ['{"streams":[{"width":10,"height":20}]}', '{"streams":[]}', "{}", "bad", '{"streams":[{"width":10}]}']
    df = spark.createDataFrame([(i, p) for i, p in enumerate(probes)], "i int, p string")
    got = df.select("i", media.probe_size(F.col("p")).alias("s")).orderBy("i").collect()
    assert [r["s"]["status"] for r in got] == ["ok", "no stream", "no stream", "bad json", "bad size"]
    assert got[0]["s"]["height"] == 20 and got[4]["s"]["width"] is None


def test_boxes(spark):
    schema = "points array<struct<text:string,confidence:double,text_region:array<array<double>>>>"
    page = [("费操出行", 0.9921839, [[538.0, 7.0], [704.0, 10.0], [703.0, 53.0], [537.0, 50.0]]), ("b", None, [[0.0, 0.0]] * 4)]
    row = spark.createDataFrame([(page,)], schema).select(boxes.page_boxes(F.col("points")).alias("b"))
    first, second = row.head()["b"]
    assert first.asDict() == {"h": 51.5, "text": "曹操出行", "w": 703.5, "x": 537.5, "y": 8.5, "c": 0.992}
    assert second["c"] is None
    assert row.select(boxes.page_text(F.col("b")).alias("t")).head()["t"] == "曹操出行,b"


def test_nth_line(spark):
    lines = [("f", i, f"line {i}") for i in range(1, 8)] + [("g", 1, "short merge_field")]
    df = spark.createDataFrame(lines, "f string, n int, value string").repartition(3)
    got = {r["f"]: (r["line_no"], r["status"]) for r in audit.probe_marker(audit.nth_line(df, ["f"], ["n"], 5)).collect()}
    assert got == {"f": (5, "absent"), "g": (1, "present")}


def test_lookup_in_stores_equals_lookup_in_frames(spark):
    keys = "dict string, key int"
    a = spark.createDataFrame([("x", 1, "p"), ("x", 2, None), (None, 3, "q"), ('"', 4, "r"), ("y", 9, "s")], keys + ", value string")
    b = spark.createDataFrame([("x", 1, "p"), ("x", 2, "n"), ('"', 4, "t"), ("z", 1, "u")], keys + ", value string")
    asked = spark.createDataFrame(
        [("x", 1, 0), ("x", 1, 1), ("x", 2, 2), (None, 3, 3), ('"', 4, 4), ("y", 9, 5), ("x", None, 6), ("no", 1, 7)], keys + ", n int"
    )
    stores = [lookup.bucketed_store(replica, ["dict", "key"], 3) for replica in (a, b)]
    found = lookup.look_up_stores(asked, *stores, ["dict", "key"]).select("n", "dict", "key", "value_a", "value_b", "agree")
    wanted = lookup.compare_replicas(asked, a, b, ["dict", "key"]).select(*found.columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect())) and found.count() == 8
    nothing = [lookup.bucketed_store(replica.limit(0), ["dict", "key"], 3) for replica in (a, b)]
    assert {(r["value_a"], r["agree"]) for r in lookup.look_up_stores(asked, *nothing, ["dict", "key"]).collect()} == {(None, True)}
