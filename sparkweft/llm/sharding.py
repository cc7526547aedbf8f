"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

How many rows each input partition sends to each shard is drawn exactly: the counts of a uniformly random permutation
that is cut into shards. Rows are permuted inside their partition, sent by those counts, and permuted again where they
arrive. Rows move by DataFrame operations only; the driver sees one count per partition and draws the matrix.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweft.llm.columns import others, packed, unpacked
from sparkweft.staging import stage

MAX_PARTITIONS = 8192  # input partitions are merged beyond this; the matrix has one row for each
MATRIX_CELLS = 4_000_000  # most counts drawn; beyond this, blocks inside a shard grow instead
BLOCK_ROWS = 1_000_000  # rows permuted together after the exchange
_NUMPY_TOTAL = 10**9  # numpy draws from fewer items than this
_POSITION_BITS = (1 << 33) - 1  # monotonically_increasing_id keeps the place in the partition in its low 33 bits


def draw_count(good: int, bad: int, draws: int, rng: np.random.Generator) -> int:
    """One hypergeometric count for totals that numpy refuses: inversion over all counts within 40 deviations."""
    total = good + bad
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mean = draws * (good / total)
    deviation = (mean * (bad / total) * ((total - draws) / max(total - 1, 1))) ** 0.5
    low, high = max(low, int(mean - 40 * deviation - 20)), min(high, int(mean + 40 * deviation + 20))
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    weights = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.cumsum(np.exp(weights - weights.max()))
    return low + int(np.searchsorted(weights, rng.random() * weights[-1], side="right"))


def communication_matrix(rows: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """Rows that each partition sends to each cell: ``rows`` are the sums of its lines, ``sizes`` of its columns."""
    rng = np.random.default_rng(seed)

    def draw(lines: list[int], left: np.ndarray) -> list[np.ndarray]:
        if len(lines) == 1:
            return [left]
        if int(left.sum()) < _NUMPY_TOTAL:
            drawn = []
            for count in lines[:-1]:
                drawn.append(rng.multivariate_hypergeometric(left, count, method="marginals"))
                left = left - drawn[-1]
            return [*drawn, left]
        half = len(lines) // 2  # halves are drawn first until they are small enough
        wanted, rest, first = sum(lines[:half]), int(left.sum()), []
        for size in left.tolist():
            rest -= size
            first.append(draw_count(size, rest, wanted, rng))
            wanted -= first[-1]
        taken = np.array(first, dtype=np.int64)
        return draw(lines[:half], taken) + draw(lines[half:], left - taken)

    return np.array(draw(rows, np.array(sizes, dtype=np.int64)), dtype=np.int64).reshape(len(rows), len(sizes))


def even_sizes(total: int, parts: int) -> list[int]:
    return [total // parts + (i < total % parts) for i in range(parts)]


def shuffle_shards(df: DataFrame, shards: int = 40, seed: int = 17, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All rows with ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 in each shard), uniformly shuffled.

    Shard sizes differ by one row at most. Values never matter: nulls, empty or long texts, ties and repeated rows are
    rows like others, and each keeps its own slot. An empty frame gives an empty result. Columns named ``shard`` or
    ``slot`` are replaced, others kept. The permuted rows are written once, so lost executors change nothing later.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    names = others(df, "shard", "slot")
    permuted = stage(
        df.coalesce(MAX_PARTITIONS)
        .select(packed(df), F.rand(seed).alias("draw"))
        .sortWithinPartitions("draw")
        .select(
            "row",
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_BITS)).alias("pos"),
        )
    )
    counts = sorted(tuple(r) for r in permuted.groupBy("part").agg(F.count(F.lit(1))).collect())
    total = sum(count for _, count in counts)
    spare = max(1, MATRIX_CELLS // (shards * max(len(counts), 1)))
    blocks = min(spare, max(1, -(-total // (shards * block_rows))))
    sizes = [size for shard in even_sizes(total, shards) for size in even_sizes(shard, blocks)]
    sent = communication_matrix([n for _, n in counts], sizes, seed) if counts else np.zeros((0, len(sizes)))
    ends = np.cumsum(sent, axis=1).astype(np.int64)
    table = [
        (part, line[blocks - 1 :: blocks].tolist(), line.tolist())
        for (part, _), line in zip(counts, ends, strict=True)
    ]
    longs = T.ArrayType(T.LongType())
    schema = T.StructType(
        [T.StructField("part", T.IntegerType()), T.StructField("shard_ends", longs), T.StructField("ends", longs)]
    )
    matrix = permuted.sparkSession.createDataFrame(table, schema)  # at most MATRIX_CELLS counts or one per shard
    passed = lambda bounds: F.size(F.filter(bounds, lambda end: end <= F.col("pos")))
    placed = permuted.join(F.broadcast(matrix), "part").withColumn("to_shard", passed(F.col("shard_ends")))
    placed = placed.select(
        "row", "part", "pos", "to_shard",
        passed(F.slice("ends", F.col("to_shard") * blocks + 1, blocks)).alias("block"),
        F.xxhash64(F.lit(seed), "part", "pos").alias("draw"),
    )
    size = F.lit(total // shards) + (F.col("to_shard") < total % shards).cast("long")
    each, longer = F.floor(size / blocks), size % blocks
    before = F.col("block") * each + F.least(F.col("block").cast("long"), longer)
    place = F.row_number().over(W.partitionBy("to_shard", "block").orderBy("draw", "part", "pos"))
    return placed.select(
        *unpacked(names), F.col("to_shard").cast("int").alias("shard"), (before + place - 1).cast("long").alias("slot")
    )
