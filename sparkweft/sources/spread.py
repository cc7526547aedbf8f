"""Using all cores on inputs of few blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan of fewer tasks than cores over all cores; larger scans stay as they are.

    A file of one row group is read by one task, which then also does all work on its rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
