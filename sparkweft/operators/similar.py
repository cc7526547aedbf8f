"""Rows with similar vectors: an exact self join that gives links per row, never a list of pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweft.functions.vectors import check_method
from sparkweft.operators.blocks import matrix, row_slices, score
from sparkweft.operators.ordinal import with_ordinal
from sparkweft.operators.pieces import PIECE_ROWS, choose_pivots, compare, cut, heads, partners, piece_size
from sparkweft.staging import stage

DEFAULT_THRESHOLD = 0.85

_NONE = np.iinfo(np.int64).max


def similar_rows(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    threshold: float = DEFAULT_THRESHOLD,
    method: str = "cosine",
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """All pairs i < j whose score reaches the threshold, as links per row: ``key``, ``links`` (other rows that it is similar
    to) and ``first``, the lowest key among them that is below its own, NULL if there is none. A row without ``first``
    represents the rows that name it.

    Scores are rounded to nine decimals before they are compared; those of ``euclidean`` are negated distances. NULL vectors
    take no part; keys are unique. Equal vectors are one class, compared once, so a large group of copies costs no more than
    one vector. Classes are cut into pieces around pivots, and only pairs of pieces whose distances to the pivots allow such a
    score are scored. Each pair of pieces gives sums per class, so what leaves a task never exceeds the rows it was given.
    """
    check_method(method)
    usable = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    grouped = usable.groupBy("vector").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = stage(with_ordinal(grouped, ["least"], "place"))
    pivots = choose_pivots(classes, "vector")
    pieces = cut(classes.select("place", "n", "vector"), "vector", pivots, "place", piece_size(classes, "vector", piece_rows))
    ends = heads(pieces, "vector", pivots)
    pairs = partners(ends, ends, method, threshold).where("p <= q")

    def link(p: int, q: int, left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = matrix(left.column("vector")), matrix(right.column("vector"))
        (place_a, n_a), (place_b, n_b) = ((t.column("place").to_numpy(), t.column("n").to_numpy()) for t in (left, right))
        links_a, links_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        first_a, first_b = np.full(len(a), _NONE), np.full(len(b), _NONE)
        for part in row_slices(len(a), len(b)):
            hits = score(a[part], b, method) >= threshold
            own = place_a[part, None] == place_b[None, :]  # a class is similar to itself if its copies are
            links_a[part] = hits @ n_b - (hits & own).any(axis=1)
            first_a[part] = np.where(hits, place_b[None, :], _NONE).min(axis=1, initial=_NONE)
            links_b += n_a[part] @ hits
            np.minimum(first_b, np.where(hits, place_a[part, None], _NONE).min(axis=0, initial=_NONE), out=first_b)
        place, links, first = (place_a, links_a, first_a) if p == q else map(np.concatenate, ((place_a, place_b), (links_a, links_b), (first_a, first_b)))
        found = links > 0
        return pa.table({"place": place[found], "links": links[found], "first": first[found]})

    rows = pieces.select(*pieces.columns)
    linked = compare(rows, rows, pairs, link, "place long, links long, first long")
    sums = stage(linked.groupBy("place").agg(F.sum("links").alias("links"), F.min("first").alias("first_place")))
    names = classes.select(F.col("place").alias("first_place"), F.col("least").alias("first"))
    named = sums.join(names, "first_place").select("place", "links", "first")
    answers = classes.select("vector", "place").join(named, "place", "left")
    found = usable.join(answers.select("vector", "links", "first"), "vector")
    return found.select(
        F.col("key").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("links"),
        F.when(F.col("first") < F.col("key"), F.col("first")).alias("first"),
    )
