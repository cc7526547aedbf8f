"""Operators on streams, batch by batch."""

import json

import pytest
from pyspark.sql import functions as F

from sparkweft.streaming import answers


class Stream:
    """A folded stream over a folder that rows are added to between runs."""

    def __init__(self, spark, folder, **options):
        self.spark, self.folder, self.options = spark, folder, options
        (folder / "in").mkdir()

    def add(self, *rows):
        """Rows of (answer, order, text, done), or with None for a text that does not parse; then one run."""
        data = [(a, n, "{broken" if t is None else json.dumps({"response": t, "done": d})) for a, n, t, d in rows]
        frame = self.spark.createDataFrame(data, "id long, n long, value string")
        if data:
            frame.coalesce(1).write.mode("append").parquet(str(self.folder / "in"))
        lines = self.spark.readStream.schema(frame.schema).parquet(str(self.folder / "in"))
        folded = answers.fold_stream(lines, "id", "n", **self.options)
        self.schema = folded.schema
        folded.writeStream.format("parquet").option("checkpointLocation", str(self.folder / "state")).outputMode("append").trigger(
            availableNow=True
        ).start(str(self.folder / "out")).awaitTermination(120)
        return self

    def given(self):
        rows = self.spark.read.schema(self.schema).parquet(str(self.folder / "out")).collect()
        return sorted((tuple(r) for r in rows), key=str)

    def held(self):
        return sorted((tuple(r) for r in answers.open_answers(self.spark, str(self.folder / "state"), "id").collect()), key=str)


def test_answers_over_batches(spark, tmp_path):
    stream = Stream(spark, tmp_path, piece_rows=2)
    stream.add((1, 2, "b", False), (1, 1, "a", False), (2, 1, "x", False), (None, 1, "n", False), (1, 3, None, False))
    assert stream.given() == [(1, 0, "ab", 2, False, False)]
    assert stream.held() == [(2, 0, "x", 1, False, False), (None, 0, "n", 1, False, False)]
    stream.add((1, 4, "c", True), (1, 5, "behind the end", False), (2, 2, "", True), (None, 2, "m", False), (3, 1, "", False))
    assert stream.given() == [
        (1, 0, "ab", 2, False, False), (1, 1, "c", 3, True, False), (2, 0, "x", 2, True, False), (None, 0, "nm", 2, False, False),
    ]
    assert stream.held() == [(3, 0, "", 1, False, False)]
    stream.add((1, 6, "behind", False), (1, 3, "late", False), (None, 3, "o", True))
    assert stream.given()[2:] == [
        (1, 2, "late", 4, True, True), (2, 0, "x", 2, True, False), (None, 0, "nm", 2, False, False), (None, 1, "o", 3, True, False),
    ]
    assert stream.held() == [(3, 0, "", 1, False, False)]


def test_a_later_batch_goes_behind(spark, tmp_path):
    stream = Stream(spark, tmp_path)
    stream.add((1, 5, "e", False)).add((1, 2, "b", False)).add((1, 9, "z", True))
    assert stream.given() == [(1, 0, "ebz", 3, True, False)] and stream.held() == []


def test_last_rows_over_batches(spark, tmp_path):
    schema = "k string, n long, v string"

    def run(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        answers.follow_last(stream, F.col("k"), "n", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
        return sorted((tuple(r) for r in answers.last_version(spark, str(tmp_path / "out")).collect()), key=str)

    assert run(("a", 1, "x"), (None, 2, "y"), ("a", 3, None)) == [("a", 3, None, 1), (None, 2, "y", 2)]
    assert run(("a", 0, "early"), (None, 9, "z")) == [("a", 3, None, 0), (None, 9, "z", 2)]
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        answers.last_version(spark, str(tmp_path / "none"))
