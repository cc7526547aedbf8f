"""Leader clusters of vectors; k-means is in ``kmeans``."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweft.operators.blocks import SCORE_DIGITS, matrix, row_slices, score
from sparkweft.operators.ordinal import with_ordinal
from sparkweft.operators.pieces import PIECE_ROWS, PIECE_VALUES, choose_pivots, compare, cut, heads, partners, piece_size
from sparkweft.staging import recorded, release, stage

DEFAULT_THRESHOLD = 0.85
LAST_ROWS = 8_192  # undecided rows and leaders that one task scans to the end
LEAST_SWEPT = 8  # a sweep that closes less than one row of so many is the last

_CUT_BINS = 4_096

_OPEN, _WAITING, _LEADER, _CLOSED = range(4)


def leader_clusters(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    threshold: float = DEFAULT_THRESHOLD,
    block_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Leader clustering in key order: the first free row opens a cluster and takes every later free row whose cosine
    with it reaches the threshold. Gives ``key``, ``cluster_id`` (from 0), ``leader`` and ``similarity`` to it.

    The leaders are the lexicographically first maximal independent set of the rows, found by peeling: a row that no earlier
    row matches is a leader at once, wherever it stands. Every other row waits for the earliest row that it matches. If that
    is a leader, the row is its member, since nothing earlier can be its leader; if that belongs to another leader, the row
    looks for the next one. So the rounds follow the longest chain of rows that wait for each other, not the number of rows.

    Of more than ``LAST_ROWS`` classes most are settled before that by sweeps: one task scans the first rows that are left, and
    all later rows are compared with the leaders among them only, not with each other. What matches none is left for the
    next sweep. Sweeps end when one closes less than an eighth of the rows it looks at, as rows without clusters are all
    leaders.

    Rows whose vector matches itself are one class with their copies, compared once. Classes are cut into pieces of
    ``block_rows`` at most around pivots, and only pairs of pieces that can hold a match are scored (see
    :mod:`sparkweft.operators.pieces`); rows that belong to a leader are compared no more. Once no more rows are left than a
    pair of pieces has, and ``LAST_ROWS`` at most, one task scans them. Every step is written, and deleted at the end.
    """
    spark = vectors.sparkSession
    with recorded(made := []):
        result = _peeled(vectors, key, vector, threshold, block_rows)
    release(spark, made, result)
    return result


def _peeled(vectors: DataFrame, key: str, vector: str, threshold: float, block_rows: int) -> DataFrame:
    usable = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    itself = F.round(F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x), SCORE_DIGITS)
    usable = usable.withColumn("sole", F.when(itself >= threshold, None).otherwise(F.col("key")))
    classes = stage(with_ordinal(usable.groupBy("vector", "sole").agg(F.min("key").alias("least")), ["least"], "place"))
    size = classes.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("vector")).alias("width")).head()
    few = min(2 * block_rows, LAST_ROWS, 2 * PIECE_VALUES // max(size["width"] or 1, 1))
    head = max(1, min(LAST_ROWS, 2 * PIECE_VALUES // max(size["width"] or 1, 1)))
    swept, rest, undecided = _swept(classes.select("place", "vector"), size["rows"], threshold, head)
    if swept and undecided <= head:
        few = head
    state = rest.select("place", F.lit(_OPEN).alias("status"), F.lit(None).cast("long").alias("met"), F.lit(None).cast("double").alias("near"))
    if undecided > few:
        state, undecided = _rounds(rest, state, threshold, block_rows, few)
    if undecided:
        state = stage(_settled(state, _last_scan(rest, state, threshold)))
    for found in swept:
        state = state.unionByName(found)
    leaders = with_ordinal(state.where(F.col("status") == _LEADER).select("place"), ["place"], "cluster_id", start=0)
    names = leaders.join(classes, "place").select(F.col("place").alias("met"), "cluster_id", F.col("least").alias("leader"))
    of = state.select("place", F.when(F.col("status") == _LEADER, F.col("place")).otherwise(F.col("met")).alias("met"), F.when(F.col("status") == _CLOSED, F.col("near")).alias("near"))
    members = classes.join(of, "place").join(names, "met").select("vector", "sole", "cluster_id", "leader", "near")
    same = (F.col("u.vector") == F.col("m.vector")) & F.col("u.sole").eqNullSafe(F.col("m.sole"))
    rows = usable.withColumn("itself", itself).alias("u").join(members.alias("m"), same)
    return stage(
        rows.select(F.col("u.key").alias(key), "cluster_id", "leader", F.coalesce("near", "itself").alias("similarity"))
    )


def _settled(state: DataFrame, found: DataFrame) -> DataFrame:
    """Rows that ``found`` (place, status, met, near) names are as it says."""
    new = found.select("place", F.struct("status", "met", "near").alias("f"))
    pick = lambda name: F.when(F.col("f").isNotNull(), F.col("f")[name]).otherwise(F.col(name)).alias(name)
    return state.join(new, "place", "left").select("place", pick("status"), pick("met"), pick("near"))


def _cut(rows: DataFrame, most: int) -> int:
    """The place that at most ``most`` of the rows, and some, come before. Rows are counted by ranges of places."""
    ends = rows.agg(F.min("place").alias("low"), F.max("place").alias("high")).head()
    low, high = ends["low"], ends["high"] + 1
    while True:
        width = -(-(high - low) // _CUT_BINS)
        bins = rows.where(F.col("place").between(low, high - 1)).groupBy(F.floor((F.col("place") - low) / width).alias("bin")).count()
        taken, end = 0, low
        for row in sorted(bins.collect(), key=lambda row: row["bin"]):
            if taken + row["count"] > most:
                break
            taken, end = taken + row["count"], low + (row["bin"] + 1) * width
        if taken:
            return end
        low, high = low + row["bin"] * width, low + (row["bin"] + 1) * width  # this range alone has too many


def _earliest(leaders: Broadcast, threshold: float) -> Callable[[str], Column]:
    """The first of the leaders (places and vectors) that a vector matches, and the score."""
    kind = pa.struct([("met", pa.int64()), ("near", pa.float64())])

    @F.arrow_udf("struct<met:long,near:double>")
    def earliest(vectors: pa.Array) -> pa.Array:
        places, leading = leaders.value
        rows, met, near = matrix(vectors), np.zeros(len(vectors), dtype=np.int64), np.full(len(vectors), np.nan)
        for part in row_slices(len(rows), len(places)):
            scores = score(rows[part], leading, "cosine")
            hits = scores >= threshold
            at = hits.argmax(axis=1)[:, None]
            found = np.take_along_axis(hits, at, 1)[:, 0]
            met[part], near[part] = places[at[:, 0]], np.where(found, np.take_along_axis(scores, at, 1)[:, 0], np.nan)
        none = np.isnan(near)
        return pa.StructArray.from_arrays([pa.array(met, mask=none), pa.array(near, mask=none)], fields=list(kind))

    return earliest.asNondeterministic()


def _swept(rest: DataFrame, undecided: int, threshold: float, head: int) -> tuple[list[DataFrame], DataFrame, int]:
    """Settles the first ``head`` rows and whatever matches their leaders, again and again. Gives what was settled (place,
    status, met, near), the rows that match none of the leaders so far, and how many these are."""
    spark, swept, written = rest.sparkSession, [], []
    while undecided > head:
        end = _cut(rest, head)
        first = rest.where(F.col("place") < end)
        scanned = stage(_scan(first.withColumn("status", F.lit(_OPEN)), threshold))
        leaders = first.join(scanned.where(F.col("status") == _LEADER).select("place"), "place").toArrow().sort_by("place")
        held = spark.sparkContext.broadcast((leaders.column("place").to_numpy(), matrix(leaders.column("vector"))))

        with recorded(made := []):
            later = rest.where(F.col("place") >= end).withColumn("f", _earliest(held, threshold)("vector"))
            later = stage(later.select("place", F.when(F.col("f.met").isNull(), F.col("vector")).alias("vector"), F.col("f.met"), F.col("f.near")))
            closed = later.where(F.col("met").isNotNull()).select("place", F.lit(_CLOSED).alias("status"), "met", "near")
            counts = later.agg(F.count(F.lit(1)).alias("rows"), F.count("met").alias("closed")).head()
            swept += [scanned, stage(closed)]
            rest = stage(later.where(F.col("met").isNull()).select("place", "vector"))
        held.destroy()
        written = release(spark, [*written, *made], reduce(DataFrame.unionAll, [rest.select("place"), *[x.select("place") for x in swept]]))
        undecided = counts["rows"] - counts["closed"]
        if counts["closed"] * LEAST_SWEPT < counts["rows"]:
            break
    return swept, rest, undecided


def _last_scan(classes: DataFrame, state: DataFrame, threshold: float) -> DataFrame:
    """What becomes of open and waiting rows, once so few rows are left that one task can scan them in order."""
    active = classes.select("place", "vector").join(state.where(F.col("status") != _CLOSED).select("place", "status"), "place")
    return _scan(active, threshold)


def _scan(active: DataFrame, threshold: float) -> DataFrame:
    """What becomes of rows (place, vector, status), all held by one task, in their order."""

    def scan(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        vectors, places, status = matrix(table.column("vector")), table.column("place").to_numpy(), table.column("status").to_numpy()
        taken = np.full(len(places), -1)
        near = np.zeros(len(places))
        free = status != _LEADER
        for row in range(len(places)):
            if status[row] == _LEADER or free[row]:
                later = row + 1 + np.flatnonzero(free[row + 1 :])
                scores = score(vectors[row : row + 1], vectors[later], "cosine")[0] if len(later) else np.zeros(0)
                hits = later[scores >= threshold]
                taken[hits], near[hits], free[hits] = row, scores[scores >= threshold], False
        rows = np.flatnonzero(status != _LEADER)
        member = taken[rows] >= 0
        return pa.table(
            {
                "place": places[rows], "status": pa.array(np.where(member, _CLOSED, _LEADER), pa.int32()),
                "met": pa.array(places[taken[rows]], mask=~member), "near": pa.array(near[rows], mask=~member),
            }
        )

    return active.withColumn("all", F.lit(True)).groupBy("all").applyInArrow(scan, "place long, status int, met long, near double")


def _rounds(classes: DataFrame, state: DataFrame, threshold: float, block_rows: int, few: int) -> tuple[DataFrame, int]:
    """Peels until no row is undecided, or few rows are undecided or leaders; gives the state and how many are undecided."""
    pivots = choose_pivots(classes, "vector")
    pieces = cut(classes.select("place", "vector"), "vector", pivots, "place", piece_size(classes, "vector", block_rows))
    group = max(1, piece_size(classes, "vector") // block_rows)  # pieces meet in groups, each shuffled once for a group pair
    ends = heads(pieces, "vector", pivots)
    pairs = partners(ends, ends, "cosine", threshold)

    def earliest(p: int, q: int, left: pa.Table, right: pa.Table) -> pa.Table:
        a, b, after = matrix(left.column("vector")), matrix(right.column("vector")), left.column("after").to_numpy()
        own, places = left.column("place").to_numpy(), right.column("place").to_numpy()
        order = np.argsort(places)
        b, places = b[order], places[order]
        found = []
        for part in row_slices(len(a), len(b)):
            scores = score(a[part], b, "cosine")
            hits = (scores >= threshold) & (places[None, :] < own[part, None]) & (places[None, :] > after[part, None])
            rows = np.flatnonzero(hits.any(axis=1))
            first = hits[rows].argmax(axis=1)
            found.append((own[part][rows], places[first], scores[rows, first]))
        place, met, near = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (own[:0], places[:0], np.zeros(0))
        return pa.table({"place": place, "met": met, "near": near})

    def search(state: DataFrame) -> DataFrame:
        """Earliest open, waiting or leading row behind the one that an open row met last."""
        asking = state.where(F.col("status") == _OPEN).select("place", F.coalesce("met", F.lit(0)).alias("after"))
        left = pieces.join(asking, "place")
        right = pieces.join(state.where(F.col("status") != _CLOSED).select("place"), "place", "left_semi")
        found = compare(left, right, pairs, earliest, "place long, met long, near double", group, group)
        return found.groupBy("place").agg(F.min(F.struct("met", "near")).alias("f")).select("place", F.col("f.met").alias("new"), F.col("f.near").alias("new_near"))

    while True:
        found = state.where(F.col("status") == _OPEN).select("place").join(search(state), "place", "left")
        placed = F.when(F.col("new").isNull(), _LEADER).otherwise(_WAITING).alias("status")
        state = stage(_settled(state, found.select("place", placed, F.col("new").alias("met"), F.col("new_near").alias("near"))))
        while True:  # what rows wait for may be settled by now; whole chains are, before rows are compared again
            there = state.select(F.col("place").alias("met"), F.col("status").alias("theirs"))
            waits = F.col("status") == _WAITING
            told = F.when(waits & (F.col("theirs") == _LEADER), _CLOSED).when(waits & (F.col("theirs") == _CLOSED), _OPEN)
            state = stage(
                state.join(there, "met", "left").select("place", F.coalesce(told, "status").alias("status"), "met", "near", told.isNotNull().alias("told"))
            )
            n = lambda status: F.count_if(F.col("status") == status)
            counts = state.agg(n(_OPEN).alias("open"), n(_WAITING).alias("waiting"), n(_LEADER).alias("leaders"), F.count_if("told").alias("told")).head()
            if not counts["told"] or not counts["waiting"]:
                break
        undecided = counts["open"] + counts["waiting"]
        if not undecided or undecided + counts["leaders"] <= few:
            return state.drop("told"), undecided


def cluster_sizes(clusters: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Members per cluster."""
    return clusters.groupBy(cluster).agg(F.count(F.lit(1)).alias("members"))
