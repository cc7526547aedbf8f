"""Top-k search over vectors.

A query set of bounded size goes to every executor; each task keeps its best k candidates per query, so only those are
shuffled, and the candidates never move. A larger query set is cut into pieces around pivots, as are the candidates. Each
piece of queries first meets the nearest pieces of candidates, which gives every query a bound, and then only those pieces
that can still hold a candidate above the least bound of its queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkweft.functions.vectors import check_method
from sparkweft.operators.blocks import SCORE_DIGITS, VectorBlock, check_dimension, key_array, matrix, raw_score, row_slices, score, take_block
from sparkweft.operators.pieces import PIECE, choose_pivots, compare, cut, heads, partners, piece_size
from sparkweft.staging import stage

MAX_QUERY_BLOCK = 4096

_FLOOR_SLACK = 1e-8  # above the rounding of scores and products
_REACH_COLUMNS = 2_048
_FEW = 4  # times k: more hits per query than this are cut to k before they are sorted


def best_per_row(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k best columns of each row; ties go to the lowest column."""
    width = scores.shape[1]
    if width > k:
        floor = np.partition(scores, width - k, axis=1)[:, width - k, None]
        above, level = scores > floor, scores == floor
        room = k - above.sum(axis=1, keepdims=True)
        rows, cols = np.nonzero(above | (level & (np.cumsum(level, axis=1) <= room)))
    else:
        rows, cols = np.nonzero(np.ones(scores.shape, dtype=bool))
    sort = np.lexsort((cols, -scores[rows, cols], rows))
    return rows[sort], cols[sort]


def _reaching(left: np.ndarray, right: np.ndarray, floor: np.ndarray, method: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Row and column numbers of all pairs that can reach the row's floor, and few others; None where single precision may
    overflow."""
    own, sq = np.einsum("ij,ij->i", left, left), np.einsum("ij,ij->i", right, right)
    least, half, size = floor - _FLOOR_SLACK, np.zeros(len(sq)), own + sq.max()
    if method == "euclidean":  # a distance is r at most where 2 ab - bb >= aa - rr
        size = size + least * least
        least, half = (own - least * least) / 2, sq / 2
    if not max(size.max(), np.abs(least).max()) < 1e30:
        return None
    least = least - (left.shape[1] + 16) * 2.0**-22 * size - _FLOOR_SLACK
    a = np.concatenate([left, np.ones((len(left), 1))], axis=1).astype(np.float32)
    b = np.concatenate([right, -half[:, None]], axis=1).astype(np.float32)
    least, rows, cols = least.astype(np.float32)[:, None], [], []
    for first in range(0, len(b), _REACH_COLUMNS):
        part = b[first : first + _REACH_COLUMNS]
        row, col = np.divmod(np.flatnonzero(a @ part.T >= least), len(part))
        rows.append(row)
        cols.append(col + first)
    return np.concatenate(rows), np.concatenate(cols)


def best_above(left: np.ndarray, right: np.ndarray, floor: np.ndarray, k: int, method: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and column numbers and scores of the k best columns of each row, less those under the row's ``floor``.

    Where every row has a floor, products in single precision tell the few columns that can reach it, with room for their
    rounding, and only these are scored, rounded and sorted."""
    check_dimension(left, right)
    found = _reaching(left, right, floor, method) if left.size and right.size and np.isfinite(floor).all() else None
    if found is not None and len(found[0]) <= _FEW * k * len(left):
        rows, cols = found
        scores = np.einsum("ij,ij->i", left[rows], right[cols])
        if method == "euclidean":  # the same steps as in raw_score
            scores = scores * -2 + (left * left).sum(1)[rows] + (right * right).sum(1)[cols]
            scores = -np.sqrt(np.maximum(scores, 0.0))
        scores = np.round(scores, SCORE_DIGITS)
        good = scores >= floor[rows]
        rows, cols, scores = rows[good], cols[good], scores[good]
        order = np.lexsort((cols, -scores, rows))
        rows, cols, scores = rows[order], cols[order], scores[order]
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
        return rows[keep], cols[keep], scores[keep]
    scores = score(left, right, method)
    rows, cols = best_per_row(scores, k)
    good = scores[rows, cols] >= floor[rows]
    return rows[good], cols[good], scores[rows, cols][good]


class _Best:
    """Running best k candidates of each query within one task."""

    def __init__(self, queries: tuple[np.ndarray, np.ndarray], k: int, method: str) -> None:
        self.keys, self.vectors = queries
        self.k, self.method = k, method
        self.query = np.empty(0, dtype=np.int64)
        self.candidate: np.ndarray | None = None
        self.scores = np.empty(0)
        self.floor = np.full(len(self.keys), -np.inf)  # score of the k-th best so far
        self.last = np.empty(0)  # and its key

    def add(self, keys: np.ndarray, vectors: np.ndarray) -> None:
        for part in row_slices(len(keys), len(self.keys)):
            order = part.start + np.argsort(keys[part], kind="stable")
            found = raw_score(self.vectors, vectors[order], self.method)
            rows, cols = np.nonzero(found >= self.floor[:, None] - 10.0**-SCORE_DIGITS)
            if len(self.last):  # a tie with the k-th best counts only for a lower key
                lower = np.searchsorted(keys[order], self.last)
                better = np.round(found[rows, cols], SCORE_DIGITS) > self.floor[rows]
                better |= cols < lower[rows]
                rows, cols = rows[better], cols[better]
            if len(rows) > _FEW * self.k * len(self.keys):
                rows, cols = best_per_row(np.round(found, SCORE_DIGITS, out=found), self.k)
            self._merge(rows, keys[order][cols], np.round(found[rows, cols], SCORE_DIGITS))

    def _merge(self, rows: np.ndarray, keys: np.ndarray, scores: np.ndarray) -> None:
        query = np.concatenate([self.query, rows])
        candidate = keys if self.candidate is None else np.concatenate([self.candidate, keys])
        value = np.concatenate([self.scores, scores])
        place = np.argsort(np.argsort(candidate, kind="stable"), kind="stable")
        sort = np.lexsort((place, -value, query))
        query, candidate, value = query[sort], candidate[sort], value[sort]
        rank = np.arange(len(query)) - np.searchsorted(query, query, side="left")
        keep = rank < self.k
        self.query, self.candidate, self.scores = query[keep], candidate[keep], value[keep]
        last = rank == self.k - 1
        self.floor[query[last]] = value[last]
        if not len(self.last) and len(candidate):
            self.last = np.full(len(self.keys), candidate[0], dtype=candidate.dtype)
        self.last[query[last]] = candidate[last]

    def arrays(self, schema: pa.Schema) -> list[pa.Array]:
        if self.candidate is None:
            return [pa.array([], type=field.type) for field in schema]
        return [
            pa.array(self.keys[self.query].tolist(), type=schema.field(0).type),
            pa.array(self.candidate.tolist(), type=schema.field(1).type),
            pa.array(self.scores),
        ]


def top_k(
    queries: DataFrame,
    candidates: DataFrame,
    k: int = 5,
    method: str = "cosine",
    query: str = "query_id",
    candidate: str = "candidate_id",
    vector: str = "embedding",
    max_query_block: int = MAX_QUERY_BLOCK,
) -> DataFrame:
    """The k closest candidates of every query: ``query``, ``candidate``, ``score`` and ``rank``.

    Scores of ``euclidean`` are negated distances. Equal scores go to the lowest candidate id. NULL vectors take no
    part. Both ids must be unique; ``queries`` and ``candidates`` may be the same rows under two names. More queries than
    ``max_query_block`` are searched piece by piece, all in one pass of the candidates.
    """
    check_method(method)
    queries = queries.where(F.col(vector).isNotNull()).select(query, vector)
    candidates = candidates.where(F.col(vector).isNotNull()).select(candidate, vector)
    schema = T.StructType(
        [queries.schema[query], candidates.schema[candidate], T.StructField("score", T.DoubleType())]
    )
    arrow_schema = to_arrow_schema(schema)

    def searched(block: VectorBlock) -> tuple[DataFrame, Broadcast]:
        held = queries.sparkSession.sparkContext.broadcast((block.columns[query], block.vectors))

        def search(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            best = _Best(held.value, k, method)
            for batch in batches:
                if batch.num_rows and len(best.keys):
                    best.add(key_array(batch.column(candidate)), matrix(batch.column(vector)))
            yield pa.RecordBatch.from_arrays(best.arrays(arrow_schema), schema=arrow_schema)

        found = rank_top(candidates.mapInArrow(search, schema), [query], ["score desc", candidate], k)
        return found, held

    whole = take_block(queries, vector, max_query_block)
    if whole is not None:
        return searched(whole)[0]
    return _pruned(queries, candidates, k, method, query, candidate, vector, schema, max_query_block)


def _pruned(
    queries: DataFrame, candidates: DataFrame, k: int, method: str, query: str, candidate: str, vector: str,
    schema: T.StructType, piece_rows: int,
) -> DataFrame:
    """:func:`top_k` for query sets of any size."""
    metric = "euclidean" if method == "euclidean" else "cosine"
    arrow_schema = to_arrow_schema(schema)
    asked = queries.select(F.col(query).alias("id"), F.col(vector).alias("vector"))
    held = candidates.select(F.col(candidate).alias("id"), F.col(vector).alias("vector"))
    pivots = choose_pivots(held, "vector")
    if not len(pivots):
        return queries.sparkSession.createDataFrame([], schema.add("rank", T.LongType()))
    size = piece_size(asked, "vector")
    left = cut(asked, "vector", pivots, "id", min(piece_rows, size))
    group = max(1, size // piece_rows)  # small pieces of queries meet a candidate piece together
    right = cut(held, "vector", pivots, "id", piece_size(held, "vector"))
    left_heads, right_heads = heads(left, "vector", pivots), heads(right, "vector", pivots)

    def best(p: int, q: int, own: pa.Table, others: pa.Table) -> pa.Table:
        a, b = matrix(own.column("vector")), matrix(others.column("vector"))
        ids, floor = key_array(own.column("id")), own.column("floor").to_numpy()
        keys = key_array(others.column("id"))
        order = np.argsort(keys, kind="stable")
        b, keys, parts = b[order], keys[order], []
        for part in row_slices(len(a), len(b)):
            rows, cols, scores = best_above(a[part], b, floor[part], k, method)
            parts.append((ids[part][rows], keys[cols], scores))
        columns = [np.concatenate(x).tolist() for x in zip(*parts, strict=True)]
        return pa.table([pa.array(x, type=field.type) for x, field in zip(columns, arrow_schema, strict=True)], schema=arrow_schema)

    everything = partners(left_heads, right_heads, metric, float("-inf"))
    before = W.partitionBy("p").orderBy(F.desc("highest"), "q").rowsBetween(W.unboundedPreceding, -1)
    nearest = everything.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    nearest = stage(nearest.where(F.col("before") < k).select("p", "q"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    near = stage(compare(left.withColumn("floor", F.lit(float("-inf"))), right, nearest, best, ddl, group))
    ranked = rank_top(near, [query], ["score desc", candidate], k)
    bounds = ranked.where(F.col("rank") == k).select(F.col(query).alias("id"), F.col("score").alias("floor"))
    bounded = left.join(bounds, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    bounded = stage(bounded)
    least = bounded.groupBy(PIECE).agg(F.min("floor").alias("least")).withColumnRenamed(PIECE, "p")
    rest = everything.join(least, "p").where(F.col("highest") >= F.col("least")).join(nearest, ["p", "q"], "left_anti")
    far = compare(bounded, right, stage(rest.select("p", "q")), best, ddl, group)
    return rank_top(near.unionAll(far), [query], ["score desc", candidate], k)


def each_block(blocks: Iterable[VectorBlock], work: Callable[[VectorBlock], tuple[DataFrame, Broadcast]]) -> DataFrame:
    """Union of ``work`` over all blocks. Of several blocks each result is written before the next block is sent, so that
    one block at a time is held by the executors."""
    blocks = iter(blocks)
    first = next(blocks)
    frame, held = work(first)
    second = next(blocks, None)
    if second is None:
        return frame
    written = []
    while True:
        written.append(stage(frame))
        held.destroy()
        if second is None:
            return reduce(DataFrame.unionAll, written)
        frame, held = work(second)
        second = next(blocks, None)


def rank_top(df: DataFrame, group: list[str], order: list[str], k: int, name: str = "rank") -> DataFrame:
    """First k rows of each group; tasks cut their rows to k per group before the shuffle."""
    ordering = [F.col(c.removesuffix(" desc")).desc() if c.endswith(" desc") else F.col(c) for c in order]
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(*ordering)).cast("int"))
    return ranked.where(F.col(name) <= k).withColumn(name, F.col(name).cast("long"))
