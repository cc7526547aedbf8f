"""Readers, writers, jobs and streams on real files."""

import csv
import gzip
import io
import json
import os
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkweft.operators import audit
from sparkweft.operators.diff import BOTH, ONLY_LEFT, ONLY_RIGHT, line_diff
from sparkweft.plans import jobs
from sparkweft.plans.feature_queries import feature_lines
from sparkweft.plans.file_queries import feature_files_diff
from sparkweft.sinks import files as sinks
from sparkweft.sources import case_files, csv_files, inventory, paths, spread, text_files
from sparkweft.staging import recorded
from sparkweft.streaming import intake

M = "merge_field\t"


def write(path, content, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    if isinstance(content, bytes):
        path.write_bytes(content)
    else:
        path.write_bytes(content.encode(encoding))
    return str(path)


def read_all(directory):
    out = []
    for name in sorted(os.listdir(directory)):
        if name.startswith("part-"):
            opener = gzip.open if name.endswith(".gz") else open
            with opener(os.path.join(directory, name), "rt", encoding="utf-8", newline="") as f:
                out.append(f.read())
    return "".join(out)


# ---- delimited readers


def test_headed_csv_is_text(spark, tmp_path):
    path = write(tmp_path / "people.csv", "name,age,city\nAda,25,Paris\nBo,30,Rome\n")
    df = csv_files.read_csv(spark, path)
    assert [tuple(r) for r in df.collect()] == [("Ada", "25", "Paris"), ("Bo", "30", "Rome")]
    assert csv_files.headers(spark, path) == ["name", "age", "city"]
    assert csv_files.row_count(spark, path) == csv_files.row_count(spark, path, physical=True) == 2
    assert [r["name"] for r in csv_files.iterate(df)] == ["Ada", "Bo"]


def test_csv_quoting_line_breaks_blank_and_short_lines(spark, tmp_path):
    text = 'a,b,c\n"x,1","say ""hi""","two\nlines"\n\nshort\n1,2,3,4\n'
    path = write(tmp_path / "q.csv", text)
    got = [tuple(r) for r in csv_files.read_csv(spark, path).collect()]
    assert got == [("x,1", 'say "hi"', "two\nlines"), ("short", None, None), ("1", "2", "3")]
    assert csv_files.row_count(spark, path) == 3
    assert csv_files.row_count(spark, path, physical=True) == 5


def test_csv_records_keep_empty_missing_and_surplus_apart(spark, tmp_path):
    path = write(tmp_path / "r.csv", 'a,b,a\n1,,3\n\nx\n"q,q",2,3,4,5\n')
    got = csv_files.read_csv_records(spark, path)
    assert got.columns == ["a", "b", "overflow"]
    assert [(r["a"], r["b"], r["overflow"]) for r in got.collect()] == [
        ("3", "", None), (None, None, None), ("3", "2", ["4", "5"]),
    ]


def test_csv_arrays_equal_python(spark, tmp_path):
    text = 'a,b\n1\n"x,""y""",2,3\n'
    path = write(tmp_path / "ragged.csv", text)
    got = [r["cells"] for r in csv_files.read_csv_arrays(spark, path).collect()]
    assert got == list(csv.reader(io.StringIO(text)))


def test_csv_options_and_errors(spark, tmp_path):
    tabbed = write(tmp_path / "t.tsv", "n\tv\nä\t1\n", "latin-1")
    assert csv_files.read_csv(spark, tabbed, delimiter="\t", encoding="latin-1").head()["n"] == "ä"
    assert dict(csv_files.read_csv(spark, tabbed, "\t", infer_types=True).dtypes)["v"] == "int"
    chinese = write(tmp_path / "g.csv", "名,值\n中文,1\n", "gbk")
    assert csv_files.headers(spark, chinese, encoding="gbk") == ["名", "值"]
    assert csv_files.read_csv_records(spark, chinese, encoding="gbk").head()["名"] == "中文"
    with pytest.raises(FileNotFoundError):
        csv_files.read_csv(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError):
        csv_files.headers(spark, write(tmp_path / "empty.csv", ""))
    bom = write(tmp_path / "bom.csv", "﻿a,b\n1,2\n")
    assert csv_files.read_csv(spark, bom).columns == ["a", "b"]


def test_csv_chunks_follow_file_order(spark, tmp_path):
    path = write(tmp_path / "n.csv", "id,value\n" + "".join(f"{i},{10 * i}\n" for i in range(5)))
    got = csv_files.read_csv_chunks(spark, path, 2).collect()
    assert sorted((int(r["id"]), r["chunk_id"], r["ordinal"]) for r in got) == [(i, i // 2, i + 1) for i in range(5)]


def test_file_order_over_blocks(spark, tmp_path):
    path = write(tmp_path / "big.txt", "".join(f"line {i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        from sparkweft.operators.ordinal import with_ordinal

        lines = text_files.read_lines(spark, path, place=True)
        assert lines.rdd.getNumPartitions() > 3
        got = with_ordinal(lines, text_files.PLACE).select("value", "ordinal").collect()
        assert all(r["value"] == f"line {r['ordinal'] - 1}" for r in got) and len(got) == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_headed_tsv_with_required_columns(spark, tmp_path):
    path = write(tmp_path / "s.tsv", "name\tcreate_time\tflag\nn1\tt\tyes\nshort\n\tt\tyes\n")
    rows = csv_files.read_headed_tsv(spark, path, ["name", "create_time", "flag"]).collect()
    assert [(r["name"], r["flag"]) for r in rows] == [("n1", "yes"), ("", "yes")]
    with pytest.raises(ValueError):
        csv_files.read_headed_tsv(spark, path, ["name", "other"])


# ---- text readers


def test_plain_and_gzipped_lines(spark, tmp_path):
    write(tmp_path / "d" / "a.txt", "one\r\ntwo\n")
    write(tmp_path / "d" / "b.gz", gzip.compress(b"three\n"))
    lines = text_files.read_lines(spark, str(tmp_path / "d"), place=True)
    assert {r["value"] for r in lines.collect()} == {"one", "two", "three"}
    assert lines.select("src_file").distinct().count() == len(lines.inputFiles()) == 2
    whole = text_files.read_whole_texts(spark, str(tmp_path / "d" / "a.txt")).head()
    assert whole["value"] == "one\r\ntwo\n"


def test_name_lists(spark, tmp_path):
    text = '{"dict_list": ["a", "b"]}\n\n{"dict_list": ["b",\n "c"]}\n\n{broken}\n\n{"other": 1}\n\n{"dict_list": ["d"]}\n'
    got = text_files.read_name_lists(spark, write(tmp_path / "conf.log", text)).collect()
    assert {r["name"] for r in got} == {"a", "b", "c", "d"}


def test_request_keys_over_lines_and_blocks(spark, tmp_path):
    entry = 'curl "keys":[\n {"key": "k%d",\n "dict": "d%d"}, {"key": "no", "dict": "no"}]\n'
    path = write(tmp_path / "dump.txt", "".join(entry % (i, i % 7) for i in range(300)) + '"keys":[]\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = text_files.read_request_keys(spark, path)
        assert got.rdd.getNumPartitions() > 2
        assert sorted((r["key"], r["dict"]) for r in got.collect()) == sorted((f"k{i}", f"d{i % 7}") for i in range(300))
        ordered = got.orderBy(*text_files.PLACE).select("key").collect()
        assert [r["key"] for r in ordered] == [f"k{i}" for i in range(300)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_pairs_and_positional(spark, tmp_path):
    pairs = text_files.read_pairs(spark, write(tmp_path / "p.txt", " d1  k 1 \n\nlonely\nd2\tk2\n"))
    assert [(r["dict"], r["key"]) for r in pairs.collect()] == [("d1", "k 1"), ("d2", "k2")]
    rows = text_files.read_positional(spark, write(tmp_path / "p.tsv", "1\t2\t3\n4\n"), ["a", "b"])
    assert [tuple(r) for r in rows.collect()] == [("1", "2", ["3"]), ("4", "", [])]


def test_vectors_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, [1.0, i / 2]) for i in range(9)], "i long, embedding array<float>").coalesce(1)
    sinks.write_vectors(df, str(tmp_path / "v"))
    back = text_files.read_vectors(spark, str(tmp_path / "v"), others="i long")
    assert sorted((r["i"], r["dimension"], r["embedding"]) for r in back.collect()) == [(i, 2, [1.0, i / 2]) for i in range(9)]
    path = write(tmp_path / "one.json", json.dumps({"dimension": 2, "embedding": [1.0, 0.5]}, indent=2))
    assert text_files.read_vectors(spark, path, one_per_file=True).head()["embedding"] == [1.0, 0.5]


def test_library_in_both_layouts(spark, tmp_path):
    document = {
        "b": {"path": "p1", "embedding": [1.0], "description": "old"},
        "a": [{"path": "p2", "embedding": [0.5]}, {"path": "p3"}],
        "bad": {"path": "p4"},
    }
    library = case_files.read_library(spark, write(tmp_path / "lib.json", json.dumps(document, indent=2)))
    got = sorted((r["case_no"], r["case_name"], r["idx"], r["path"], r["embedding"]) for r in library.collect())
    assert got == [(0, "b", 0, "p1", [1.0]), (1, "a", 0, "p2", [0.5]), (1, "a", 1, "p3", None)]
    sinks.write_library(library, str(tmp_path / "out"))
    again = case_files.read_library(spark, str(tmp_path / "out"))
    assert again.columns == library.columns and sorted(again.collect(), key=str) == sorted(library.collect(), key=str)
    sinks.write_library(library.limit(0), str(tmp_path / "none"))
    assert case_files.read_library(spark, str(tmp_path / "none")).isEmpty()


# ---- inventory


def test_inventory(spark, tmp_path):
    write(tmp_path / "d" / "part-1.gz", b"12345")
    write(tmp_path / "d" / "part-2.gz", b"1")
    write(tmp_path / "d" / "README", b"123")
    listed = inventory.list_directory(spark, str(tmp_path / "d"))
    row = inventory.directory_summary(listed).head()
    assert (row["files"], row["total_bytes"], row["plain_files"]) == (3, 9, 1)
    assert row["last_file"].endswith("part-2.gz")
    assert [r["path"].rsplit("/", 1)[1] for r in inventory.plain_files(listed).collect()] == ["README"]


def test_pictures(spark, tmp_path):
    for name in ("b.JPG", "x/a.webp", "x/y/c.png", "no.txt"):
        write(tmp_path / "p" / name, b"\x01\x02")
    found = inventory.collect_pictures(spark, [str(tmp_path / "p"), str(tmp_path / "p" / "x")]).collect()
    assert [r["path"].split("/p/")[1] for r in found] == ["b.JPG", "x/a.webp", "x/y/c.png"]
    assert inventory.read_pictures(spark, [str(tmp_path / "p")]).count() == 3


def test_path_states(spark, tmp_path):
    write(tmp_path / "d" / "f", b"x")
    (tmp_path / "empty").mkdir()
    states = [paths.path_state(spark, str(tmp_path / p))[1] for p in ("d", "d/f", "empty", "none")]
    assert states == ["directory", "file", "empty", "missing"]


def test_spread_only_small_scans(spark, tmp_path):
    path = write(tmp_path / "a.txt", "x\n")
    assert spread.spread(spark.read.text(path)).rdd.getNumPartitions() == 4
    many = spark.range(10, numPartitions=6)
    assert spread.spread(many) is many


# ---- writers


def test_csv_sink_equals_python_csv(spark, tmp_path):
    rows = [("a,b", " sp ", 'q"q', ""), ("line\nbreak", None, "\ttab", "x")]
    df = spark.createDataFrame(rows, "p string, q string, r string, s string").coalesce(1)
    sinks.write_csv(df, str(tmp_path / "out"))
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([df.columns, *rows])
    assert read_all(tmp_path / "out") == out.getvalue()


def test_quoted_csv_sink(spark, tmp_path):
    df = spark.createDataFrame([("d", 'k"1')], "dict string, key string").coalesce(1)
    sinks.write_quoted_csv(df, str(tmp_path / "out"))
    assert read_all(tmp_path / "out") == '"dict","key"\n"d","k""1"\n'


@pytest.mark.parametrize("files", [1, 3, 6])
def test_gzip_text_with_stable_names(spark, tmp_path, files):
    df = spark.range(0, 40, numPartitions=3).select(F.col("id").cast("string").alias("value"))
    sinks.write_gzip_text(df, str(tmp_path / "out"), files)
    names = sinks.stable_part_names(spark, str(tmp_path / "out"))
    assert names == [f"part-{i:05d}.gz" for i in range(files)]
    assert sorted(read_all(tmp_path / "out").split()) == sorted(str(i) for i in range(40))
    assert sinks.stable_part_names(spark, str(tmp_path / "out")) == []


def test_line_diff_sink(spark, tmp_path):
    left = spark.createDataFrame([("a",), ("b",)], "value string")
    right = spark.createDataFrame([("b",)], "value string")
    sinks.write_line_diff(line_diff(left, right), str(tmp_path / "out"))
    got = {side: [r["value"] for r in df.collect()] for side, df in sinks.read_line_diff(spark, str(tmp_path / "out")).items()}
    assert got == {ONLY_LEFT: ["a"], ONLY_RIGHT: [], BOTH: ["b"]}


def test_group_documents(spark, tmp_path):
    df = spark.createDataFrame([(i % 2, i) for i in range(7)], "cluster int, member int")
    sinks.write_group_documents(df, "cluster", "member", str(tmp_path / "out"), list_rows=3)
    documents = [json.loads(line) for line in read_all(tmp_path / "out").splitlines()]
    totals = [d for d in documents if "num_groups" in d]
    assert totals == [{"num_groups": 2, "num_members": 7}]
    for cluster in (0, 1):
        parts = sorted((d["part"], d["members"]) for d in documents if d.get("cluster") == cluster)
        assert [m for _, part in parts for m in part] == [i for i in range(7) if i % 2 == cluster]
        assert all(len(part) <= 3 for _, part in parts)


# ---- jobs


def feature_line(key, members):
    return json.dumps({"key": key, "fieldvalues": members, "n": 1})


@pytest.fixture
def backup(tmp_path):
    root = tmp_path / "task1" / "data_backup"
    lines = [feature_line(f"k{i}", [M + "a", "x", M + "a"]) for i in range(10)] + ["broken"]
    write(root / "part-0.gz", gzip.compress("\n".join(lines[:6]).encode()))
    write(root / "part-1.gz", gzip.compress("\n".join(lines[6:]).encode()))
    return root


def test_filter_job_and_its_check(spark, backup):
    target = jobs.filter_features(spark, str(backup))
    assert target == str(backup.parent / "data")
    lines = read_all(target).splitlines()
    assert sorted(lines)[-1] == feature_line("k9", [M + "a"]) and "broken" in lines and len(lines) == 11
    assert all(name.startswith("part-0") and name.endswith(".gz") for name in os.listdir(target) if name.startswith("part"))
    diff = jobs.compare_features(spark, str(backup), target, str(backup.parent / "report"))
    assert {r["status"] for r in diff.collect()} == {"same"}
    sides = {r["side"] for r in jobs.compare_lines(spark, str(backup), target, str(backup.parent / "lines")).collect()}
    assert sides == {ONLY_LEFT, ONLY_RIGHT, BOTH}


def test_filter_job_stops_without_members(spark, tmp_path):
    source = tmp_path / "data_backup"
    write(source / "a.txt", feature_line("k", ["x"]) + "\n" + feature_line("k", [M + "late"]) + "\n")
    assert jobs.filter_features(spark, str(source), sample_lines=1) is None
    assert not (tmp_path / "data").exists()
    write(source / "a.txt", "".join(feature_line("k", ["x"]) + "\n" for _ in range(600)) + feature_line("k", [M + "late"]) + "\n")
    assert jobs.filter_features(spark, str(source)) == str(tmp_path / "data")


def test_output_directory(spark):
    assert jobs.output_directory(spark, "/a/data_backup/data_backup/") == "/a/data/data_backup"
    assert jobs.output_directory(spark, "/a", "/b") == "/b"
    with pytest.raises(ValueError):
        jobs.output_directory(spark, "/a/data_backup_2")
    with pytest.raises(ValueError):
        jobs.output_directory(spark, "/a/", "/a")


def test_feature_diff_report(spark, tmp_path):
    write(tmp_path / "b" / "f", feature_line("k1", [M + "a"]) + "\n" + feature_line("k2", [M + "a"]) + "\n")
    write(tmp_path / "d" / "f", feature_line("k1", [M + "b"]) + "\n" + feature_line("k3", []) + "\n")
    jobs.compare_features(spark, str(tmp_path / "b"), str(tmp_path / "d"), str(tmp_path / "out"))
    got = {r["key"]: r["status"] for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert got == {"k1": "diff", "k2": "only_in_backup", "k3": "only_in_data"}


def test_audit_job(spark, backup, tmp_path):
    plain = tmp_path / "task2" / "data_backup"
    write(plain / "f", feature_line("k", ["x"]) + "\n")
    (tmp_path / "task3" / "data_backup").mkdir(parents=True)
    requested = [str(backup), str(plain), str(tmp_path / "task3" / "data_backup"), str(tmp_path / "no" / "data_backup"), str(plain / "f")]
    audited = jobs.audit_directories(spark, requested)
    got = {r["path"]: (r["task_name"], r["path_exists"], r["has_field"]) for r in audited.collect()}
    assert [got[p] for p in requested] == [
        ("task1", True, True), ("task2", True, False), ("task3", True, None), ("no", False, None), ("data_backup", True, None),
    ]
    assert [r["path"] for r in audit.lacking_paths(audited).collect()] == [str(plain)]
    assert jobs.audit_directories(spark, requested[3:4]).head()["path_exists"] is False


def test_audit_of_many_directories_takes_few_jobs(spark, tmp_path):
    wanted = {}
    for i in range(200):
        place = tmp_path / f"d {i}%41+"
        member = feature_line("k", ["merge_field\tx" if i % 3 == 0 else "other\tx"]) + "\n"
        write(place / "a", "plain\n" if i % 2 else member)
        write(place / "b=1" / "b", member)
        write(place / "_c", feature_line("k", ["merge_field\tx"]) + "\n")
        wanted[str(place)] = i % 3 == 0
    broken = str(tmp_path / "d 100%41+")
    write(tmp_path / "d 100%41+" / "z.gz", b"no gzip file")
    wanted[broken] = None
    spark.sparkContext.setJobGroup("audit-many", "")
    try:
        rows = jobs.audit_directories(spark, list(wanted)).collect()
    finally:
        ran = len(spark.sparkContext.statusTracker().getJobIdsForGroup("audit-many"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r["path"]: r["has_field"] for r in rows} == wanted
    assert 0 < ran < 100


def test_probe_job(spark, tmp_path):
    write(tmp_path / "t" / "a", "merge_field\n")
    write(tmp_path / "t" / "b", "".join(f"{i}\n" for i in range(1, 150)).replace("100\n", "100 merge_field\n", 1))
    write(tmp_path / "u" / "a", "one\ntwo\n")
    got = {
        r["path"].rsplit("/", 1)[1]: (r["line_no"], r["status"])
        for r in jobs.probe_last_files(spark, [str(tmp_path / n) for n in "tun"]).collect()
    }
    assert got == {"t": (100, "present"), "u": (2, "absent"), "n": (None, "failed")}
    assert jobs.probe_last_files(spark, [str(tmp_path / "n")]).head()["status"] == "failed"


def test_one_unreadable_file_fails_alone(spark, tmp_path):
    whole = gzip.compress(("".join(f"line {i} {i * i}\n" for i in range(50_000))).encode())
    write(tmp_path / "cut" / "a.gz", whole[: len(whole) // 2])
    write(tmp_path / "no" / "a.gz", b"no gzip file")
    write(tmp_path / "fine" / "a", feature_line("k", ["merge_field\tx"]) + "\n")
    paths = [str(tmp_path / name) for name in ("cut", "no", "fine")]
    assert [r["has_field"] for r in jobs.audit_directories(spark, paths).orderBy("path").collect()] == [None, True, None]
    probed = {r["path"].rsplit("/", 1)[1]: (r["line_no"], r["status"]) for r in jobs.probe_last_files(spark, paths).collect()}
    assert probed["no"] == (None, "failed") and probed["fine"] == (1, "present")
    assert probed["cut"] in ((None, "failed"), (100, "absent"))  # the line may come before the cut


def test_params_job(spark, tmp_path):
    line = '{"params": {"image_url": "%s", "activity_detail_image_urls": "%s"}}\n'
    path = write(tmp_path / "a.log", "".join(line % (i, key) for i, key in enumerate(["z", "a", "z"])))
    jobs.export_params(spark, path, str(tmp_path / "out"))
    rows = list(csv.DictReader(io.StringIO(read_all(tmp_path / "out"))))
    assert [(r["image_url"], r["activity_detail_image_urls"]) for r in rows] == [("2", "z"), ("1", "a")]
    assert len(rows[0]) == 28 and rows[0]["est_price"] == ""


def test_params_job_keeps_the_order_of_files_and_lines(spark, tmp_path):
    line = '{"params": {"image_url": "%s", "activity_detail_image_urls": "%s"}}\n'
    for name, start in (("b.log", 50), ("a.log", 0), ("a.log.1", 20)):
        write(tmp_path / "logs" / name, "".join(line % (f"{name}{i}", f"k{i}") for i in reversed(range(start, start + 60))))
    jobs.export_params(spark, str(tmp_path / "logs"), str(tmp_path / "out"))
    rows = list(csv.DictReader(io.StringIO(read_all(tmp_path / "out"))))
    seen = {}
    for name, start in (("a.log", 0), ("a.log.1", 20), ("b.log", 50)):
        for i in reversed(range(start, start + 60)):
            seen[f"k{i}"] = f"{name}{i}"
    assert [(r["activity_detail_image_urls"], r["image_url"]) for r in rows] == list(seen.items())


def test_reorder_job(spark, tmp_path):
    path = write(tmp_path / "in.tsv", '1\t2,2\t3\t4\t"5" \\\n\n6\n')
    jobs.reorder_positional(spark, path, str(tmp_path / "out"), ["a", "b", "c"], ["c", "a"])
    assert read_all(tmp_path / "out") == 'c,a,b\n3,1,"2,2",4,"""5"" \\"\n,6,\n'
    jobs.reorder_positional(spark, path, str(tmp_path / "full"))
    header, first = read_all(tmp_path / "full").splitlines()[:2]
    assert header.startswith("images,estimate_id,supplier_name") and header.endswith(",channel_reward,placeholder")
    assert len(next(csv.reader([first]))) == 31


def test_picture_jobs(spark, tmp_path):
    def make_size_model():
        def predict(contents):
            return np.array([[len(c), 1.0] for c in contents], dtype=np.float32)

        return predict

    for name, size in (("a.png", 1), ("b.png", 1), ("c.png", 40)):
        write(tmp_path / "p" / name, b"x" * size)
    clusters = jobs.cluster_pictures(spark, [str(tmp_path / "p")], make_size_model, 0.9).collect()
    assert {r["path"][-5:]: r["cluster_id"] for r in clusters} == {"a.png": 0, "b.png": 0, "c.png": 1}
    library = spark.createDataFrame(
        [(0, "wide", 0, "w", [1.0, 0.0], "")],
        "case_no long, case_name string, idx long, path string, embedding array<float>, description string",
    )
    found = jobs.classify_pictures(spark, [str(tmp_path / "p")], library, make_size_model, 0.9).collect()
    assert {r["path"][-5:]: r["case_name"] for r in found} == {"a.png": "未分类", "b.png": "未分类", "c.png": "wide"}


# ---- streams


def test_files_are_handled_once(spark, tmp_path):
    seen = []

    def handle(rows, number):
        seen.append(sorted(r["id"] for r in rows.collect()))

    def run():
        query = intake.process_files(spark, str(tmp_path / "in"), ["id"], handle, str(tmp_path / "state"))
        query.awaitTermination(60)

    write(tmp_path / "in" / "a.csv", "id\n1\n2\n")
    write(tmp_path / "in" / "b.csv", "id\n3\n")
    run()
    assert sorted(seen) == [["1", "2"], ["3"]]
    write(tmp_path / "in" / "c.csv", "id\n4\n")
    run()
    assert seen[2:] == [["4"]]


def test_log_statistics_of_a_stream(spark, tmp_path):
    write(tmp_path / "in" / "a.log", "并发调用ocr模型效率：4张图片，耗时2.0秒\nother\n")
    write(tmp_path / "in" / "b.log", "并发调用ocr模型效率：2张图片，耗时1.0秒\n")
    intake.follow_log(spark, str(tmp_path / "in"), "log_totals", str(tmp_path / "state")).awaitTermination(60)
    row = spark.table("log_totals").head()
    assert (row["records"], row["total_images"], row["images_per_second"]) == (2, 6, 2.0)


def test_diff_job_writes_its_versions_compressed(spark, tmp_path):
    """Both versions of the feature lines are read back whole from small files."""
    items = spark.range(400).selectExpr(
        "id div 4 as l_orderkey", "(id % 4)::int as l_linenumber", "id * 7 as l_partkey", "id as l_suppkey", "1.5 as l_extendedprice", "'R' as l_returnflag", "'F' as l_linestatus"
    )
    items.write.parquet(f"{tmp_path}/lineitem.parquet")
    with recorded(made := []):
        found = {r["key"]: r["status"] for r in feature_files_diff(spark, str(tmp_path)).collect()}
    valid = [i for i in range(400) if i * 7 % 11 not in (0, 2, 3)]  # the others are broken or have no key
    renamed, altered = [i for i in valid if i % 13 == 0], [i for i in valid if i % 13 and i % 7 == 0 and i * 7 % 11 != 1]
    name = lambda i: f"{i // 4}-{i % 4}"
    assert {k for k, v in found.items() if v == "only_in_backup"} >= {name(i) for i in renamed}
    assert {k for k, v in found.items() if v == "only_in_data"} >= {f"new-{name(i)}" for i in renamed}
    assert {k for k, v in found.items() if v == "diff"} == {name(i) for i in altered}
    size = lambda path: sum(f.stat().st_size for f in Path(path.removeprefix("file:")).rglob("part-*"))
    lines = feature_lines(spark, str(tmp_path)).selectExpr("sum(octet_length(value) + 1)").head()[0]
    assert sum(lines * 0.5 < size(path) for path in made[:2]) == 0
