"""Complete license texts as files, headers over several lines, and inheritance over deep trees."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkweft.llm import licenses

SHARED = Path("/usr/share/common-licenses")  # complete texts, where the system has them
LONG_TEXTS = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0", "GPL-2": "GPL-2.0", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "BSD": "BSD-3-Clause"}
MIT = "MIT License\n\nCopyright (c) 2019 Some Person\n\n" + dict(licenses.FILE_TEMPLATES)["MIT"]
HEADER = """#!/bin/sh
#
# Licensed under the Apache License, Version 2.0
# (the "License"); you may not use this file except
# in compliance with the License.
#
for name in one two three; do
  mkdir -p "$target/$name" && cp -r "$source/$name" "$target/$name"
done
echo "copied everything below $source, see the log of today for details"
"""


def scan(spark, rows):
    frame = spark.createDataFrame(rows, "at string, text string")
    found = licenses.scan_licenses(frame, F.col("at")).collect()
    return {r["path"]: (r["license"], r["evidence"], r["origin"]) for r in found}


@pytest.mark.parametrize("name", sorted(LONG_TEXTS))
def test_complete_texts_are_files(spark, name):
    if not (SHARED / name).exists():
        pytest.skip("no such text here")
    got = scan(spark, [("p/q/terms.txt", (SHARED / name).read_text()), ("p/q/r/s/t/code.c", "int x;"), ("p/other.c", "int y;")])
    assert got["p/q/terms.txt"] == (LONG_TEXTS[name], "file", None)
    assert got["p/q/r/s/t/code.c"] == (LONG_TEXTS[name], "inherited", "p/q")
    assert got["p/other.c"] == (None, "none", None)


def test_nearest_directory_over_a_deep_tree(spark):
    deep = "/".join("abcdefghij")
    rows = [
        ("a/x", MIT), (f"{deep}/code", None), ("a/b/c/NOTICE.txt", "Some product\nLicensed under the Apache License, Version 2.0.\nand more text on it"),
        ("a/b/code", "int x;"), ("a/z.sh", HEADER), ("a/b/notes.txt", "Some product\nReleased under the BSD 3-Clause License.\nand more text on it"),
        ("top", "x"), ("a/b/k/code", ""),
    ]
    got = scan(spark, rows)
    assert got["a/x"] == ("MIT", "file", None) and got["a/b/c/NOTICE.txt"] == ("Apache-2.0", "file", None)
    assert got[f"{deep}/code"] == ("Apache-2.0", "inherited", "a/b/c") and got["a/b/code"] == ("MIT", "inherited", "a")
    assert got["a/z.sh"] == ("Apache-2.0", "header", None) and got["a/b/notes.txt"] == ("BSD-3-Clause", "header", None)
    assert got["a/b/k/code"] == ("MIT", "inherited", "a") and got["top"] == (None, "none", None)


def test_several_files_in_a_directory_and_odd_rows(spark):
    rows = [
        ("d/1", MIT), ("d/2", dict(licenses.FILE_TEMPLATES)["BSD-3-Clause"]), ("d/3", "code"), (None, MIT), (None, None),
        ("e/very", "long text " * 200_000 + "\n\n" + "Licensed under CC BY 4.0."),
    ]
    frame = spark.createDataFrame([(*r, "kept", 1, 2) for r in rows], "at string, text string, license string, id long, whole long")
    found = licenses.scan_licenses(frame, F.col("at")).collect()
    by = {(r["at"], r["text"][:3] if r["text"] else None): r for r in found}
    assert len(found) == len(rows) and {r["id"] for r in found} == {1} and {r["whole"] for r in found} == {2}
    assert by["d/3", "cod"]["license"] == "BSD-3-Clause" and by["d/3", "cod"]["evidence"] == "inherited"  # cosine 1
    assert by[None, "MIT"]["evidence"] == "file" and by[None, None]["evidence"] == "none"
    assert by["e/very", "lon"]["license"] == "CC-BY-4.0" and by["e/very", "lon"]["evidence"] == "header"
    assert licenses.scan_licenses(frame.limit(0), F.col("at")).count() == 0
