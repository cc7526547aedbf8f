"""Hard negatives by angular triangle filtering.

Every row stores its angles to a few reference directions. For an anchor and a row with angles a and b to a reference, the
angle between the two lies from |a - b| to min(a + b, 2 pi - a - b), so all references together give an interval of the
cosine; times both norms, and rounded outwards, it bounds the whole-number score. Only where these bounds overlap the window
of scores that is still wanted is the score itself computed, in whole numbers.

Anchors are a stated query set: they go to all tasks in blocks of bounded size, and each block scans the written rows twice,
first for the positives, then for rows of another label within the windows that the positives open. A task returns at most
as many rows as an anchor, or an anchor's positive, can use, so nothing else is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweft.llm.columns import column
from sparkweft.staging import stage

SCALE = 256
REFERENCES = 24
REFERENCE_SAMPLE = 2_000  # rows that the reference directions are chosen from
ANCHOR_ROWS = 2_048  # anchors sent to all tasks at once
ANCHOR_VALUES = 8_000_000  # and their components
MOST_COMPONENT = 1 << 24
LEAST_PART, WHOLE = 80, 100  # a negative's score is 80 to 100 hundredths of the positive's
MOST = 5
_PAIRS = 500_000  # pairs of anchors and rows that a task holds at once
_PRODUCTS = 4_000_000  # components multiplied at once
_SAFE = 1e-9  # of the norms' product: above the error of angles and cosines in double precision
_NONE = np.iinfo(np.int64).min


class Rows(NamedTuple):
    """Rows as arrays: ``label`` numbers equal labels alike."""

    key: np.ndarray
    label: np.ndarray
    vector: np.ndarray
    norm: np.ndarray
    angles: np.ndarray


def usable(vector: Column) -> Column:
    """Whether a vector takes part: no component is null, not finite or, scaled, beyond 2^24."""
    fits = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) <= MOST_COMPONENT / SCALE - 1)
    return F.coalesce(F.forall(vector, fits), F.lit(False))


def reference_directions(vectors: np.ndarray, count: int = REFERENCES) -> np.ndarray:
    """Directions far from each other: each next one has the largest angle to those chosen before."""
    lengths = np.linalg.norm(vectors, axis=1)
    units = vectors[lengths > 0] / lengths[lengths > 0, None]
    if not len(units):
        return np.zeros((0, vectors.shape[1]))
    chosen, nearest = [0], np.abs(units @ units[0])
    while len(chosen) < min(count, len(units)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, np.abs(units @ units[chosen[-1]]))
    return units[chosen]


def angles_to(vectors: np.ndarray, norms: np.ndarray, references: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ references.T / np.where(norms > 0, norms, 1.0)[:, None], -1.0, 1.0))


def score_bounds(left: Rows, right: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest whole-number score of every left row with every right row."""
    apart = np.zeros((len(left.norm), len(right.norm)))
    along = np.full(apart.shape, math.pi)
    for a, b in zip(left.angles.T, right.angles.T, strict=True):
        np.maximum(apart, np.abs(a[:, None] - b[None, :]), out=apart)
        both = a[:, None] + b[None, :]
        np.minimum(along, np.minimum(both, 2 * math.pi - both, out=both), out=along)
    size = left.norm[:, None] * right.norm[None, :]
    room = size * _SAFE + 1e-6
    low = np.ceil(np.cos(along, out=along) * size - room).astype(np.int64)
    high = np.floor(np.cos(apart, out=apart) * size + room).astype(np.int64)
    return low, high


def products(left: np.ndarray, right: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Inner products of the pairs (rows, cols) in whole numbers."""
    step = max(1, _PRODUCTS // max(left.shape[1], 1))
    parts = [
        np.einsum("ij,ij->i", left[rows[i : i + step]], right[cols[i : i + step]]) for i in range(0, len(rows), step)
    ]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def _rows_of(batch: pa.RecordBatch, width: int) -> Rows:
    """A vector shorter than ``width`` ends in zeros."""
    lists = batch.column("vector")
    values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
    vector = np.zeros((len(lists), width), dtype=np.int64)
    sizes = np.diff(offsets)
    at = np.arange(offsets[0], offsets[-1])
    row = np.repeat(np.arange(len(lists)), sizes)
    vector[row, at - np.repeat(offsets[:-1], sizes)] = values[offsets[0] : offsets[-1]]
    angles = batch.column("angles").values.to_numpy()[batch.column("angles").offsets[0].as_py() :]
    return Rows(
        batch.column("key").to_numpy(), batch.column("label").to_numpy(), vector, batch.column("norm").to_numpy(),
        angles.reshape(len(lists), -1) if len(lists) else angles.reshape(0, 0),
    )


def _parts(rows: Rows, anchors: int) -> Iterator[Rows]:
    step = max(1, _PAIRS // max(anchors, 1))
    for first in range(0, len(rows.key), step):
        yield Rows(*[values[first : first + step] for values in rows])


class _Best:
    """The best rows of each of several lists within one task: higher scores first, then lower keys."""

    def __init__(self, lists: int, most: int) -> None:
        self.most = most
        self.of = np.zeros(0, dtype=np.int64)
        self.key = np.zeros(0, dtype=np.int64)
        self.score = np.zeros(0, dtype=np.int64)
        self.floor = np.full(lists, _NONE)  # the last score of a full list

    def add(self, of: np.ndarray, key: np.ndarray, score: np.ndarray) -> None:
        if not len(of):
            return
        of, key, score = (np.concatenate(x) for x in ((self.of, of), (self.key, key), (self.score, score)))
        order = np.lexsort((key, -score, of))
        of, key, score = of[order], key[order], score[order]
        rank = np.arange(len(of)) - np.searchsorted(of, of, side="left")
        keep = rank < self.most
        self.of, self.key, self.score = of[keep], key[keep], score[keep]
        last = rank == self.most - 1
        self.floor[of[last]] = score[last]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.of), pa.array(self.key), pa.array(self.score)], ["list", "key", "score"])


_FOUND = "list long, key long, score long"


def _positives(rows: DataFrame, anchors: Rows, most: int) -> DataFrame:
    """``list`` (place of the anchor), ``key``, ``score`` and ``rank`` of each anchor's positives."""
    held = rows.sparkSession.sparkContext.broadcast(anchors)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        best = _Best(len(own.key), most)
        for batch in batches:
            for part in _parts(_rows_of(batch, own.vector.shape[1]), len(own.key)):
                _, high = score_bounds(own, part)
                meets = (own.label[:, None] == part.label[None, :]) & (own.key[:, None] != part.key[None, :])
                at, col = np.nonzero(meets & (high >= best.floor[:, None]))
                best.add(at, part.key[col], products(own.vector, part.vector, at, col))
        yield best.batch()

    return _ranked(rows.mapInArrow(search, _FOUND), most)


def _negatives(rows: DataFrame, anchors: Rows, windows: np.ndarray, most: int) -> DataFrame:
    """``list`` (place of the window), ``key``, ``score`` and ``rank``; a window is anchor, least and largest score."""
    held = rows.sparkSession.sparkContext.broadcast((anchors, windows))

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (anchor, least, largest) = held.value[0], held.value[1]
        best = _Best(len(anchor), most)
        starts = np.searchsorted(anchor, np.arange(len(own.key) + 1))
        for batch in batches:
            for part in _parts(_rows_of(batch, own.vector.shape[1]), len(own.key)):
                low, high = score_bounds(own, part)
                other = own.label[:, None] != part.label[None, :]
                from_score = np.maximum(least, best.floor)
                wanted = np.zeros(low.shape, dtype=bool)
                for w, a in enumerate(anchor):
                    wanted[a] |= (high[a] >= from_score[w]) & (low[a] <= largest[w])
                at, col = np.nonzero(wanted & other)
                score = products(own.vector, part.vector, at, col)
                counts = starts[at + 1] - starts[at]
                pair = np.repeat(np.arange(len(at)), counts)
                window = np.repeat(starts[at] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
                inside = (score[pair] >= from_score[window]) & (score[pair] <= largest[window])
                best.add(window[inside], part.key[col[pair[inside]]], score[pair[inside]])
        yield best.batch()

    return _ranked(rows.mapInArrow(search, _FOUND), most)


def _ranked(found: DataFrame, most: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("list").orderBy(F.desc("score"), "key"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most)


def _prepared(df: DataFrame, key: str, vector: str, label: str, anchor: Column) -> tuple[DataFrame, int]:
    """Rows that take part with norm and angles, written, and the largest length of a vector."""
    spark = df.sparkSession
    rows = df.select(
        column(key).cast("long").alias("key"), column(label).alias("name"), column(vector).alias("vector"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
    )
    rows = rows.where(F.col("key").isNotNull() & F.col("name").isNotNull() & usable(F.col("vector")))
    whole = F.transform("vector", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    number = F.col("name").cast("long") if isinstance(rows.schema["name"].dataType, T.IntegralType) else F.xxhash64("name")
    rows = rows.select("key", number.alias("label"), "anchor", whole.alias("vector"))
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    sample = rows.orderBy(F.xxhash64("key"), "key").limit(max(1, min(REFERENCE_SAMPLE, ANCHOR_VALUES // max(width, 1)))).select("vector").collect()
    if width * MOST_COMPONENT**2 >= 1 << 62:
        raise ValueError("scores of such long vectors may leave 64 bits")
    dense = np.zeros((len(sample), width))
    for i, row in enumerate(sample):
        dense[i, : len(row["vector"])] = row["vector"]
    held = spark.sparkContext.broadcast(reference_directions(dense))

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        references = held.value
        for batch in batches:
            lists = batch.column("vector")
            values, offsets = lists.values.to_numpy().astype(np.float64), lists.offsets.to_numpy()
            norms, angles = [], []
            for i in range(len(lists)):
                own = values[offsets[i] : offsets[i + 1]]
                norms.append(math.sqrt(own @ own))
                angles.append(angles_to(own[None, :], np.array(norms[-1:]), references[:, : len(own)])[0])
            arrays = [pa.array(norms, pa.float64()), pa.array(angles, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, "norm", "angles"])

    schema = "key long, label long, anchor boolean, vector array<long>, norm double, angles array<double>"
    return stage(rows.mapInArrow(measure, schema)), width


def _anchor_blocks(rows: DataFrame, width: int) -> Iterator[Rows]:
    """Anchors, a block of bounded size at a time on the driver, in the order of their keys."""
    most = max(1, min(ANCHOR_ROWS, ANCHOR_VALUES // max(width, 1)))
    anchors = rows.where("anchor")
    last = None
    while True:
        left = anchors if last is None else anchors.where(F.col("key") > last)
        keys = [r["key"] for r in left.select("key").orderBy("key").limit(most).collect()]
        if not keys:
            return
        table = left.where(F.col("key") <= keys[-1]).orderBy("key").toArrow()  # repeats of the last key come along
        last = keys[-1]
        yield _rows_of(table.combine_chunks().to_batches()[0], width)


def hard_negatives(
    df: DataFrame,
    anchor: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positives: int = MOST,
    negatives: int = MOST,
) -> DataFrame:
    """For each row that ``anchor`` marks and each of its positives, the first ``positives`` other rows of its label, the first
    ``negatives`` rows of another label whose score is 80 to 100 hundredths of the positive's: ``anchor_id``,
    ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score`` and ``negative_score``.

    Components become ``floor(256 * x)``; a score is the inner product of two rows in whole numbers. Higher scores come first,
    equal ones by smaller key. ``key`` is a whole number and a row's name: rows that share one are not each other's positives,
    and each of them is searched with. Labels other than whole numbers are told apart by a 64-bit hash. Rows with a null key, label or vector take no part, nor do those with a component that
    is null, not finite or, scaled, beyond 2^24. A vector shorter than another counts as ending in zeros; one without length
    has score 0 with all. A positive with a negative score has no negatives. No rows or no anchors give no rows. Other columns
    are left out.
    """
    spark = df.sparkSession
    rows, width = _prepared(df, key, vector, label, anchor)
    out = T.StructType(
        [
            T.StructField("anchor_id", T.LongType()), T.StructField("positive_id", T.LongType()), T.StructField("rank", T.IntegerType()),
            T.StructField("negative_id", T.LongType()), T.StructField("positive_score", T.LongType()), T.StructField("negative_score", T.LongType()),
        ]
    )
    parts = []
    for anchors in _anchor_blocks(rows, width):
        found = _positives(rows, anchors, positives).orderBy("list", "rank").collect()  # a few for each anchor of the block
        windows = [(r["list"], -(-LEAST_PART * r["score"] // WHOLE), r["score"], r["key"]) for r in found if r["score"] >= 0]
        if not windows:
            continue
        bounds = np.array([w[:3] for w in windows], dtype=np.int64).T
        near = _negatives(rows, anchors, bounds, negatives)
        named = [(w, int(anchors.key[a]), key_, score) for w, (a, _, score, key_) in enumerate(windows)]
        names = spark.createDataFrame(named, "list long, anchor_id long, positive_id long, positive_score long")
        parts.append(
            stage(
                near.join(F.broadcast(names), "list").select(
                    "anchor_id", "positive_id", "rank", F.col("key").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
                )
            )
        )
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], out)
