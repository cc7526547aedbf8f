"""Written tables that cut lineage.

A stage is a parquet table in the shared checkpoint folder. Unlike ``checkpoint()`` it computes its input once,
and unlike a cached frame it is still there when an executor is lost.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            named = tempfile.mkdtemp(prefix="sparkweft-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


_recorders: list[list[str]] = []


def stage_path(spark: SparkSession) -> str:
    """A new, unused path below the checkpoint folder."""
    path = f"{checkpoint_root(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    for recorder in _recorders:
        recorder.append(path)
    return path


@contextmanager
def recorded(paths: list[str]) -> Iterator[None]:
    """Adds the paths of all stages that are made meanwhile to ``paths``."""
    _recorders.append(paths)
    try:
        yield
    finally:
        _recorders.pop()


def release(spark: SparkSession, paths: list[str], needed_by: DataFrame) -> list[str]:
    """Delete stages that ``needed_by`` does not read; returns those it does. Frames that read a deleted stage are void."""
    read = needed_by.inputFiles()
    kept = []
    for path in paths:
        if any(path.rsplit("/", 1)[1] in file for file in read):
            kept.append(path)
            continue
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return kept


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once and return the frame that reads it back."""
    spark = df.sparkSession
    path = stage_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
