"""Answers that arrive in pieces, and last rows by key, on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkweft.operators.dedupe import keep_last
from sparkweft.operators.logs import answer_pieces
from sparkweft.sources.paths import list_folders, path_state, remove_folder

_STATE = "last long, pieces long, part long, text string, filled long, finished boolean"


def fold_stream(
    lines: DataFrame, answer: str, order: str, value: str = "value", piece_rows: int = 1000, idle_ms: int | None = None
) -> DataFrame:
    """Answers of a stream put together from pieces as :func:`sparkweft.operators.logs.fold_pieces` does; write it in
    ``append`` mode.

    A ``part`` is given as soon as it has ``piece_rows`` pieces, the last one when the piece that is ``done`` comes, or, if
    ``idle_ms`` is given, once the answer has had no piece for that time; otherwise :func:`open_answers` reads it from the
    state. ``pieces`` counts those up to the end of the part, and only the last part of an ended answer is ``finished``.

    State per answer is the text of its open part, so it is bounded however long the answer is; an answer that has ended
    leaves a few numbers, until it is idle for ``idle_ms``. Pieces that come in one batch are put in order, so a task holds
    the pieces that one batch has of an answer, which the source's batch size bounds. A piece that comes in a later batch
    than one with a higher ``order`` is put behind that. Once an answer has ended,
    pieces behind the end are skipped, and those at or before its place make a ``late`` part of their own. Pieces without an answer's name (NULL) are one
    answer; ``order`` must be a long without NULLs.
    """
    pieces = answer_pieces(lines, answer, order, value).withColumn(order, F.col(order).cast("long"))
    named = pieces.select(F.col(answer).alias("name"), F.col(order).alias("at"), "text", "done")

    def folded(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, count, part, text, filled, finished = state.get if state.exists else (None, 0, 0, "", 0, False)
        rows: list[tuple] = []
        name = None if pd.isna(key[0]) else key[0]
        if state.hasTimedOut:
            if filled:
                rows.append((name, part, text, count, finished, False))
            state.remove()
        else:
            came = pd.concat([b[["at", "text", "done"]] for b in batches], ignore_index=True).sort_values(["at", "text"], kind="stable")
            texts, late = [text], []
            for at, piece, done in came.itertuples(index=False):
                if finished:
                    if at <= last:
                        late.append(piece)
                    continue
                texts.append(piece)
                last, count, filled, finished = int(at) if last is None else max(last, int(at)), count + 1, filled + 1, bool(done)
                if finished or filled == piece_rows:
                    rows.append((name, part, "".join(texts), count, finished, False))
                    part, texts, filled = part + 1, [], 0
            if late:
                count += len(late)
                rows.append((name, part, "".join(late), count, True, True))
                part += 1
            state.update((last, count, part, "".join(texts), filled, finished))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=["name", "part", "text", "pieces", "finished", "late"])

    kind = lines.schema[answer].dataType
    given = T.StructType([
        T.StructField("name", kind), T.StructField("part", T.LongType()), T.StructField("text", T.StringType()),
        T.StructField("pieces", T.LongType()), T.StructField("finished", T.BooleanType()), T.StructField("late", T.BooleanType()),
    ])
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return named.groupBy("name").applyInPandasWithState(folded, given, _STATE, "append", timeout).withColumnRenamed("name", answer)


def open_answers(spark: SparkSession, checkpoint: str, answer: str) -> DataFrame:
    """Open parts of the answers that a stopped :func:`fold_stream` still holds, read from its state."""
    held = spark.read.format("statestore").load(checkpoint).select(F.col("key.name").alias(answer), "value.groupState.*")
    return held.where("filled > 0").select(
        answer, "part", "text", "pieces", "finished", F.lit(False).alias("late")
    )


def _versions(spark: SparkSession, table: str) -> list[tuple[int, str]]:
    folders = [(path.rsplit("/version=", 1)[-1], path) for path in list_folders(spark, table)]
    return [(int(number), path) for number, path in folders if number.isdigit()]


def follow_last(
    rows: DataFrame, key: Column, order: str, table: str, checkpoint: str, position: str = "first_position"
) -> StreamingQuery:
    """Keep the last row of each key of a stream, with the order value of its first row, in the files below ``table``.

    The state is one row per key, kept by Spark's own aggregation. Each batch writes the whole result to a new folder
    ``version=<batch>``, again if it is repeated; :func:`last_version` reads the newest. The one before it stays for those
    who still read it, older ones are deleted.
    """

    def write(found: DataFrame, batch: int) -> None:
        found.write.mode("overwrite").parquet(f"{table}/version={batch}")
        for number, path in _versions(found.sparkSession, table):
            if number < batch - 1:
                remove_folder(found.sparkSession, path)

    return (
        keep_last(rows, key, order, position)
        .writeStream.outputMode("complete")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def last_version(spark: SparkSession, table: str) -> DataFrame:
    """The newest complete result of :func:`follow_last`."""
    complete = [n for n, path in _versions(spark, table) if path_state(spark, f"{path}/_SUCCESS")[1] == "file"]
    if not complete:
        raise FileNotFoundError(f"no complete version below {table}")
    return spark.read.parquet(f"{table}/version={max(complete)}")
