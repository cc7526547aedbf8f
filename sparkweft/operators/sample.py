"""Exact-size sampling."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_SIZE = 50
_PREFIX = 4  # hex digits of the hash that choose the cut: 65,536 buckets


def sample_rows(df: DataFrame, n: int = DEFAULT_SIZE, key: list[str] | None = None, seed: int | None = None) -> DataFrame:
    """Exactly ``n`` rows without replacement, or all rows when there are no more than ``n``.

    With a seed the rows with the lowest ``md5(key|…|seed)`` are taken, so the sample depends on the data only; the
    key must be unique. Without a seed the sample differs from run to run.

    Counts per hash prefix find the one bucket the cut falls into. Rows of lower buckets are taken as they are and
    only the cut bucket is sorted, so ``n`` may be large.
    """
    if n < 0:
        raise ValueError("n must not be negative")
    if seed is None:
        seed = random.randrange(2**31)
    keys = [F.col(c).cast("string") for c in key or df.columns]
    hashed = df.withColumn("__h", F.md5(F.concat_ws("|", *keys, F.lit(str(seed)))))
    bucket = F.substring("__h", 1, _PREFIX)
    counts = hashed.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
    taken = 0
    for found in sorted(counts, key=lambda row: row["b"]):
        if taken + found["n"] > n:
            cut = found["b"]
            below = hashed.where(bucket < cut)
            at_cut = hashed.where(bucket == cut).orderBy("__h", *(key or df.columns)).limit(n - taken)
            return below.unionAll(at_cut).drop("__h")
        taken += found["n"]
    return df
