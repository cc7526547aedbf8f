"""Files and log lines as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sparkweft.operators.logs import batch_records, batch_statistics


def process_files(
    spark: SparkSession,
    directory: str,
    columns: list[str],
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    files_per_batch: int = 1,
    delimiter: str = ",",
) -> StreamingQuery:
    """Hand headed CSV files to ``handle(rows, batch number)``, a few at a time, each file once across restarts.

    Handles all files present and stops.
    """
    schema = T.StructType([T.StructField(name, T.StringType()) for name in columns])
    rows = (
        spark.readStream.schema(schema)
        .options(header=True, sep=delimiter, quote='"', escape='"', multiLine=True, maxFilesPerTrigger=files_per_batch)
        .csv(directory)
    )
    return (
        rows.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def running_statistics(lines: DataFrame) -> DataFrame:
    """Batch statistics over a stream of log lines; write it in ``complete`` or ``update`` mode."""
    return batch_statistics(batch_records(lines))


def follow_log(spark: SparkSession, directory: str, table: str, checkpoint: str) -> StreamingQuery:
    """Keep the statistics of a log directory up to date in an in-memory table of the session."""
    lines = spark.readStream.text(directory)
    return (
        running_statistics(lines)
        .writeStream.outputMode("complete")
        .format("memory")
        .queryName(table)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
