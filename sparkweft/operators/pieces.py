"""Metric partitioning: vectors in pieces around pivots, and the pairs of pieces that can hold close vectors.

Every vector belongs to its nearest pivot. Sorted by distance to it, the vectors of each pivot are cut into pieces of bounded
size, and each piece keeps the least and largest distance of its vectors to every pivot. By the triangle inequality two vectors are
at least as far apart as their distances to any pivot differ, so the intervals of two pieces bound every score between them
without reading a vector. Pairs of pieces that may matter meet in one shuffle and are scored there as two matrices.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkweft.operators.blocks import matrix
from sparkweft.operators.ordinal import with_ordinal
from sparkweft.staging import stage

PIVOTS = 24
PIVOT_SAMPLE = 2_000  # vectors that pivots are chosen from
PIECE_ROWS = 16_384
PIECE_VALUES = 2_000_000  # components of a piece (16 MB)
LEAST_ROWS = 512
HEADS_AT_ONCE = 4_096  # intervals of pieces sent to all tasks at a time

_SLACK = 1e-8  # above the rounding of scores

PIECE = "__piece"


def choose_pivots(df: DataFrame, vector: str, count: int = PIVOTS) -> np.ndarray:
    """Vectors far from each other, of a bounded sample: each next one is the farthest from those chosen before."""
    sample = matrix(df.select(vector).orderBy(F.xxhash64(vector)).limit(PIVOT_SAMPLE).toArrow().column(vector))
    if not len(sample):
        return sample
    chosen, nearest = [0], _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(count, len(sample)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, _distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots, from differences, so that near ones are exact."""
    found = np.empty((len(rows), len(pivots)))
    for i, pivot in enumerate(pivots):
        difference = rows - pivot
        found[:, i] = np.sqrt(np.einsum("ij,ij->i", difference, difference))
    return found


def piece_size(df: DataFrame, vector: str, most: int = PIECE_ROWS) -> int:
    """Rows of a piece: few enough for a task to hold, and for some pairs of pieces on every core."""
    counts = df.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size(vector)).alias("width")).head()
    wanted = math.ceil(counts["rows"] / math.sqrt(2 * df.sparkSession.sparkContext.defaultParallelism))
    return max(1, min(most, PIECE_VALUES // max(counts["width"] or 1, 1), max(wanted, LEAST_ROWS)))


def cut(df: DataFrame, vector: str, pivots: np.ndarray, key: str, rows: int) -> DataFrame:
    """``df``, written, with the number of each row's piece in ``PIECE``. ``key`` is unique. Only so many pivots get rows of
    their own that a piece can fill up."""
    held = df.sparkSession.sparkContext.broadcast(pivots[: max(1, df.count() // rows)])

    @F.arrow_udf("struct<home:int,near:double>")
    def home(vectors: pa.Array) -> pa.Array:
        near = _distances(matrix(vectors), held.value)
        least = near.argmin(axis=1) if near.size else np.zeros(len(near), dtype=np.int64)
        return pa.array(
            [{"home": int(i), "near": float(d)} for i, d in zip(least, near.min(axis=1, initial=np.inf), strict=True)],
            pa.struct([("home", pa.int32()), ("near", pa.float64())]),
        )

    placed = df.withColumn("__at", home(vector))
    numbered = with_ordinal(placed, [F.col("__at.home"), F.col("__at.near"), key], "__n", start=0)
    homes = numbered.groupBy(F.col("__at.home").alias("__home")).agg(F.min("__n").alias("first"), F.count(F.lit(1)).alias("n"))
    begin, pieces = [], 0
    for row in sorted(homes.collect(), key=lambda row: row["first"]):  # a row per pivot; no piece has rows of two pivots
        begin.append((row["__home"], row["first"], pieces))
        pieces += -(-row["n"] // rows)
    begins = df.sparkSession.createDataFrame(begin, "__home int, __first long, __begin long")
    found = numbered.withColumn("__home", F.col("__at.home")).join(F.broadcast(begins), "__home")
    piece = F.col("__begin") + F.floor((F.col("__n") - F.col("__first")) / rows)
    return stage(found.withColumn(PIECE, piece).select(*df.columns, PIECE))


def heads(pieces: DataFrame, vector: str, pivots: np.ndarray) -> DataFrame:
    """A row per piece: its ``rows``, the intervals of distances ``lo`` and ``hi`` and the largest squared length ``sq``."""
    held = pieces.sparkSession.sparkContext.broadcast(pivots)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = matrix(batch.column(vector))
            near, sq = _distances(vectors, held.value), np.einsum("ij,ij->i", vectors, vectors)
            of = batch.column(PIECE).to_numpy()
            rows = [
                {PIECE: piece, "rows": int(own.sum()), "lo": near[own].min(axis=0), "hi": near[own].max(axis=0), "sq": sq[own].max()}
                for piece in np.unique(of).tolist()
                for own in [of == piece]
            ]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([(PIECE, pa.int64()), ("rows", pa.int64()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("sq", pa.float64())]))

    def join(parts: pd.DataFrame) -> pd.DataFrame:
        lo, hi = np.stack(parts["lo"].to_numpy()).min(axis=0), np.stack(parts["hi"].to_numpy()).max(axis=0)
        return pd.DataFrame({PIECE: parts[PIECE].iloc[:1], "rows": parts["rows"].sum(), "lo": [lo], "hi": [hi], "sq": parts["sq"].max()})

    schema = f"{PIECE} long, rows long, lo array<double>, hi array<double>, sq double"
    measured = pieces.select(PIECE, vector).mapInArrow(measure, schema)
    return stage(measured.groupBy(PIECE).applyInPandas(join, schema))


def _highest(one: pd.Series, others: pd.DataFrame, method: str) -> np.ndarray:
    """The highest score that a vector of ``one`` can have with one of each of ``others``."""
    lo, hi = np.stack(others["lo"].to_numpy()), np.stack(others["hi"].to_numpy())
    apart = np.maximum(np.maximum(lo - one["hi"], one["lo"] - hi), 0.0).max(axis=1, initial=0.0)
    if method == "euclidean":
        return -apart + _SLACK * (1 + apart)
    size = one["sq"] + others["sq"].to_numpy()
    return (size - apart * apart) / 2 + _SLACK * (1 + size)


def partners(left: DataFrame, right: DataFrame, method: str, wanted: Column | float) -> DataFrame:
    """Pairs (``p``, ``q``, ``highest``) of a left and a right piece whose vectors can reach the score ``wanted``, a number or
    a column of ``left``. All right heads go to all tasks, a bounded number at a time."""
    spark = left.sparkSession
    asked = left.withColumn("wanted", wanted if isinstance(wanted, Column) else F.lit(float(wanted)))
    last = right.agg(F.max(PIECE)).head()[0]
    parts = []
    for first in range(0, (-1 if last is None else last) + 1, HEADS_AT_ONCE):
        some = right.where(F.col(PIECE).between(first, first + HEADS_AT_ONCE - 1)).toPandas()
        held = spark.sparkContext.broadcast(some)

        def meet(batches: Iterable[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            others = held.value
            for batch in batches:
                for _, one in batch.iterrows():
                    highest = _highest(one, others, method)
                    yes = highest >= one["wanted"]
                    yield pd.DataFrame({"p": one[PIECE], "q": others[PIECE][yes], "rows": others["rows"][yes], "highest": highest[yes]})

        if len(some):
            parts.append(asked.mapInPandas(meet, "p long, q long, rows long, highest double"))
    if not parts:
        return spark.createDataFrame([], "p long, q long, rows long, highest double")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    return stage(found)


def compare(
    left: DataFrame, right: DataFrame, pairs: DataFrame, work: Callable[[int, int, pa.Table, pa.Table], pa.Table], schema: str,
    group: int = 1, right_group: int = 1,
) -> DataFrame:
    """``work`` on the rows of both pieces of every pair where both have rows. Both frames have ``PIECE`` and, but for it, may
    differ in columns. ``group`` consecutive left pieces and ``right_group`` consecutive right pieces meet in one task, so
    that a piece is shuffled once for all pairs of the two groups; ``work`` still runs on each listed pair on its own."""
    meets = pairs.select(
        "p", "q", F.floor(F.col("p") / group).cast("long").alias("gp"), F.floor(F.col("q") / right_group).cast("long").alias("gq")
    )
    left_rows = F.struct(*[F.col(c) for c in left.columns if c != PIECE]).alias("p_row")
    right_rows = F.struct(*[F.col(c) for c in right.columns if c != PIECE]).alias("q_row")
    sides = [
        left.select(F.col(PIECE).alias("p"), left_rows).join(meets.select("p", "gp", "gq").distinct(), "p"),
        right.select(F.col(PIECE).alias("q"), right_rows).join(meets.select("q", "gp", "gq").distinct(), "q"),
        meets,
    ]
    empty = to_arrow_schema(T.StructType.fromDDL(schema)).empty_table()
    both = sides[0].unionByName(sides[1], allowMissingColumns=True).unionByName(sides[2], allowMissingColumns=True)

    def rows_of(table: pa.Table, name: str) -> pa.Table:
        rows = table.column(name).combine_chunks()
        return pa.Table.from_arrays(rows.flatten(), names=[f.name for f in rows.type])

    def meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        own, others = table.filter(table.column("p_row").is_valid()), table.filter(table.column("q_row").is_valid())
        listed = table.filter(pc.and_(table.column("p_row").is_null(), table.column("q_row").is_null()))
        if not own.num_rows or not others.num_rows:
            return empty
        of, at = own.column("p").to_numpy(), others.column("q").to_numpy()
        found = []
        for p, q in sorted(set(zip(listed.column("p").to_pylist(), listed.column("q").to_pylist(), strict=True))):
            mine, theirs = of == p, at == q
            if mine.any() and theirs.any():
                found.append(work(p, q, rows_of(own.filter(pa.array(mine)), "p_row"), rows_of(others.filter(pa.array(theirs)), "q_row")))
        return pa.concat_tables(found) if found else empty

    return both.groupBy("gp", "gq").applyInArrow(meet, schema)
