"""Vector blocks: Arrow list columns as numpy matrices, and bounded blocks for broadcast."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweft.staging import stage_path

# Most components a block sent to every executor may have (double precision: 128 MB).
BLOCK_VALUES = 16_000_000

# Most scores a task holds at once (double precision: 32 MB).
SCORE_VALUES = 4_000_000

# Times a set of rows is dealt out anew before its keys count as equal.
MOST_CUTS = 20

# Scores are compared after rounding to this many decimals, so equal vectors tie wherever they are computed.
SCORE_DIGITS = 9


class VectorBlock(NamedTuple):
    """Rows held as arrays: the columns that are not the vector, and the vectors as one matrix."""

    columns: dict[str, np.ndarray]
    vectors: np.ndarray


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column without NULLs as a (rows, dimension) matrix in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(column) == 0:
        return values.reshape(0, 0)
    if len(values) % len(column) or np.any(np.diff(column.offsets.to_numpy()) != len(values) // len(column)):
        raise ValueError("vectors differ in dimension")
    return values.reshape(len(column), -1)


def take_block(df: DataFrame, vector: str, max_rows: int) -> VectorBlock | None:
    """All rows of a small frame, or None when it has more than ``max_rows`` rows or too many components. Rows and
    components are counted before any vector reaches the driver."""
    counts = df.select(F.size(vector).alias("n")).limit(max_rows + 1).agg(F.count("n").alias("rows"), F.sum("n").alias("values"))
    found = counts.head()
    if found["rows"] > max_rows or (found["values"] or 0) > BLOCK_VALUES:
        return None
    table = df.toArrow()
    vectors = matrix(table.column(vector))
    others = {name: key_array(table.column(name)) for name in table.column_names if name != vector}
    return VectorBlock(others, vectors)


def check_dimension(left: np.ndarray, right: np.ndarray) -> None:
    if left.size and right.size and left.shape[1] != right.shape[1]:
        raise ValueError(f"vectors differ in dimension: {left.shape[1]} and {right.shape[1]}")


def raw_score(left: np.ndarray, right: np.ndarray, method: str) -> np.ndarray:
    """Scores of every left row against every right row, higher is closer (euclidean distance is negated)."""
    check_dimension(left, right)
    products = left @ right.T
    if method == "euclidean":
        products *= -2
        products += (left * left).sum(1)[:, None]
        products += (right * right).sum(1)[None, :]
        np.sqrt(np.maximum(products, 0.0, out=products), out=products)
        np.negative(products, out=products)
    return products


def score(left: np.ndarray, right: np.ndarray, method: str) -> np.ndarray:
    """:func:`raw_score` rounded for comparison."""
    products = raw_score(left, right, method)
    return np.round(products, SCORE_DIGITS, out=products)


def row_slices(rows: int, width: int) -> Iterator[slice]:
    """Slices of the rows so that a score matrix of that width stays within ``SCORE_VALUES``."""
    step = max(1, SCORE_VALUES // max(width, 1))
    for start in range(0, rows, step):
        yield slice(start, min(start + step, rows))


def key_array(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Key column as an array that sorts in key order."""
    if pa.types.is_integer(column.type):
        return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)
    return np.array(column.to_pylist(), dtype=object)


def vector_blocks(df: DataFrame, key: str, vector: str, max_rows: int, cuts: int = 0) -> Iterator[VectorBlock]:
    """All rows of a frame of any size as blocks of at most ``max_rows`` rows, one at a time on the driver.

    A frame that fits is one block. Otherwise rows are dealt to folders of a written table by a hash of their unique
    key, about half a block to each, so that a block is read without its neighbours; a folder that is still too large is
    cut again by another hash.
    """
    whole = take_block(df, vector, max_rows)
    if whole is not None:
        yield whole
        return
    total = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size(vector)).alias("values")).head()
    if total["rows"] == 1:
        raise ValueError("one vector has more components than a block may hold")
    if cuts == MOST_CUTS:
        raise ValueError(f"{key} is shared by more rows than a block may hold")
    blocks = max(2, -(-2 * total["rows"] // max_rows), -(-2 * total["values"] // BLOCK_VALUES))
    path = stage_path(df.sparkSession)
    hashed = F.pmod(F.xxhash64(key, F.lit(cuts)), F.lit(blocks)).cast("int")
    df.withColumn("__block", hashed).repartition("__block").write.partitionBy("__block").parquet(path)
    dealt = df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField("__block", T.IntegerType())])).parquet(path)
    for block in range(blocks):
        yield from vector_blocks(dealt.where(F.col("__block") == block).drop("__block"), key, vector, max_rows, cuts + 1)
