"""Quoted CSV read in blocks against Spark's reader of whole files."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sparkweft.operators import ordinal
from sparkweft.sources import csv_files


def write(path, header, rows, end):
    def cell(text):
        return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\n\r') or text.startswith(" ") else text

    lines = [",".join(header), *[",".join(cell(c) for c in row) for row in rows]]
    path.write_bytes(end.join(lines).encode() + (end.encode() if len(rows) % 2 else b""))


@pytest.fixture
def small_blocks(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "301")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def random_rows(seed, count):
    rng = random.Random(seed)
    pieces = ["a", "bc", '"', "\n", "\n\n", ",", " ", "é", "1", '""', '",', "\n,\n"]
    rows = [[str(i), "".join(rng.choices(pieces, k=rng.randint(0, 9))), rng.choice(["x", "", "y z"])] for i in range(count)]
    rows[count // 2][1] = "long\n" * 400  # over several blocks
    return rows


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("seed", range(4))
def test_blocks_give_the_records_of_whole_files(spark, tmp_path, small_blocks, seed, end):
    folder = tmp_path / "in"
    folder.mkdir()
    for number in range(2):
        write(folder / f"{number}.csv", ["id", "label", "kind"], random_rows(10 * seed + number, 60), end)
    key = lambda row: tuple((c is None, c or "") for c in row)
    wanted = sorted((tuple(r) for r in csv_files._spark_csv(spark, str(folder), ",", "utf-8", True, False).collect()), key=key)
    got = sorted((tuple(r) for r in csv_files.read_csv(spark, str(folder)).collect()), key=key)
    assert got == wanted and len(got) == 120
    records = csv_files.quoted_records(spark, str(folder))
    assert records.select("src_file", "src_block").distinct().count() > 6  # one file is read by several tasks


def test_rows_keep_their_order_over_blocks(spark, tmp_path, small_blocks):
    path = tmp_path / "one.csv"
    write(path, ["id", "label", "kind"], random_rows(77, 90), "\n")
    chunks = csv_files.read_csv_chunks(spark, str(path), 40).orderBy("ordinal").collect()
    assert [int(r["id"]) for r in chunks] == list(range(90)) and [r["chunk_id"] for r in chunks][::40] == [0, 1, 2]


def test_odd_files(spark, tmp_path, small_blocks):
    cases = {
        "empty": ("a,b\n", []), "blank": ("a,b\n\n1,2\n  \n\n3\n4,5,6\n", [("1", "2"), ("3", None), ("4", "5")]),
        "open": ('a,b\n1,2\n3,"x\ny\n', [("1", "2"), ("3", "x\ny\n")]), "mark": ("﻿a,b\n1,\n", [("1", None)]),
        "latin": ("a,b\nä,\"ö\nü\"\n", [("ä", "ö\nü")]),
    }
    for name, (text, rows) in cases.items():
        path = tmp_path / f"{name}.csv"
        encoding = "latin-1" if name == "latin" else "utf-8"
        path.write_bytes(text.encode(encoding))
        found = csv_files.read_csv(spark, str(path), encoding=encoding)
        got = sorted(tuple(r) for r in found.collect())
        assert found.columns == ["a", "b"]
        assert [(a, b.rstrip("\n") if name == "open" and b else b) for a, b in got] == [(a, b.rstrip("\n") if b else b) for a, b in rows], name


def test_pages_read_their_range_only(spark):
    index = ordinal.paged(spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(5), ["k"])
    found = [[(r["ordinal"], r["k"]) for r in rows] for rows in ordinal.iterate_pages(index, 901, 40)]
    assert found == [[(n + 1, n) for n in range(first, min(first + 40, 1000))] for first in (900, 940, 980)]
    assert list(ordinal.iterate_pages(index, 1001)) == [] and list(ordinal.iterate_pages(index.limit(0))) == []
    plan = ordinal.page(index, 901, 40)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ordinal,901)" in plan and "LessThanOrEqual(ordinal,940)" in plan
    files = index.select(F.input_file_name().alias("f"), "ordinal").groupBy("f").agg(F.min("ordinal").alias("a"), F.max("ordinal").alias("b"), F.count("*").alias("n")).collect()
    assert all(row["b"] - row["a"] + 1 == row["n"] for row in files)
