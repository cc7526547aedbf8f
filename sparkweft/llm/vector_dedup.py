"""Near-duplicate vectors: spherical k-means cells, blocked cosine products in them, one representative per group.

Equal vectors are one class, compared once. Each class has its home in the cell of the nearest centre, and is also sent to
every other cell in which a vector close enough to link with it could be at home: with centres a and b, a vector at home in b
lies on b's side of the plane between them, so only vectors within the linking distance of that plane can have a neighbour
across it. A cell's home rows are compared with all its rows in blocks of bounded size, so no link is lost and no pair is
written: tasks return counts per class, and edges that only span the groups they have found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweft.llm.columns import column
from sparkweft.llm.components import components
from sparkweft.staging import stage

LEAST_COSINE = 0.98
CELL_ROWS = 1000  # aimed at; a larger cell is compared in blocks
BLOCK_ROWS = 2048
SAMPLE_PER_CELL = 24  # classes per cell that centres are fitted on, about
MOST_CENTRES = 4096  # over all labels, as they are sent to every task; with more rows cells get larger
KMEANS_STEPS = 8
_SLICE = 512  # rows of a block multiplied at once


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows in double precision, scaled to length one; scaled by their largest component first, so squares stay finite."""
    rows = np.asarray(rows, dtype=np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def spherical_kmeans(rows: np.ndarray, cells: int, steps: int = KMEANS_STEPS) -> np.ndarray:
    """Centres of length one, starting from rows spread evenly over the sample."""
    cells = min(cells, len(rows))
    centres = rows[np.linspace(0, len(rows) - 1, cells).astype(np.int64)].copy()
    for _ in range(steps):
        nearest = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        lengths = np.linalg.norm(sums, axis=1)
        filled = lengths > 0  # an empty cell keeps its centre
        centres[filled] = sums[filled] / lengths[filled, None]
    return centres


def usable(vector: Column) -> Column:
    """Whether a vector can link: not null, without null or non-finite components, and not zero."""
    values = F.transform(vector, lambda v: v.cast("double"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.coalesce(F.forall(values, finite) & F.exists(values, lambda v: v != 0), F.lit(False))


def _centres(classes: DataFrame, cell_rows: int) -> dict[tuple, np.ndarray]:
    """Centres of the labels that need more than one cell, fitted on a bounded sample of classes by a task per label."""
    counts = classes.groupBy("label", "size").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell_rows)
    total = counts.agg(F.sum(F.ceil(F.col("n") / cell_rows))).first()[0]
    if not total:
        return {}
    scale = min(1.0, MOST_CENTRES / total)
    wanted = F.greatest(F.floor(F.ceil(F.col("n") / cell_rows) * scale), F.lit(1))
    share = counts.withColumn("cells", wanted.cast("int")).withColumn("rate", F.col("cells") * SAMPLE_PER_CELL / F.col("n"))
    share = stage(share.where(F.col("cells") > 1))
    draw = F.pmod(F.xxhash64("cls", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    sample = classes.join(share.drop("n"), ["label", "size"]).where(draw < F.col("rate"))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("cls")
        centres = spherical_kmeans(unit(np.stack(group["vector"].to_numpy())), int(group["cells"].iloc[0]))
        return pd.DataFrame({"label": group["label"].iloc[0], "size": group["size"].iloc[0], "centre": list(centres)})

    schema = f"label {classes.schema['label'].dataType.simpleString()}, size int, centre array<double>"
    fitted = sample.select("label", "size", "cells", "cls", "vector").groupBy("label", "size").applyInPandas(fit, schema)
    found: dict[tuple, list] = {}
    for row in fitted.collect():
        found.setdefault((row["label"], row["size"]), []).append(row["centre"])
    return {key: np.array(rows) for key, rows in found.items()}


def _in_cells(classes: DataFrame, centres: dict[tuple, np.ndarray], reach: float) -> DataFrame:
    """A row for each cell that a class has to be in, ``home`` in one of them."""
    held = classes.sparkSession.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, group in batch.groupby(["label", "size"], sort=False):
                own = held.value.get(key)
                if own is None:
                    yield group.assign(cell=0, home=True)
                    continue
                rows = unit(np.stack(group["vector"].to_numpy()))
                near = rows @ own.T
                home = near.argmax(axis=1)
                apart = np.sqrt(np.maximum(2 - 2 * own @ own.T, 0.0))
                behind = near[np.arange(len(rows)), home][:, None] - near
                met = behind <= apart[home] * reach
                met[np.arange(len(rows)), home] = True
                at, cell = np.nonzero(met)
                yield group.iloc[at].assign(cell=cell, home=cell == home[at])

    schema = f"label {classes.schema['label'].dataType.simpleString()}, size int, cls long, n long, vector {classes.schema['vector'].dataType.simpleString()}, cell int, home boolean"
    return classes.select("label", "size", "cls", "n", "vector").mapInPandas(assign, schema)


def _spanning(adjacent: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Edges (class, class) that connect what the links of a block connect: each row of the left with its least partner, and
    each partner with the least row, which leaves one edge per row; then groups that still are apart are joined."""
    from_rows, from_columns = adjacent.argmax(axis=1), adjacent.argmax(axis=0)
    rows, columns = np.flatnonzero(adjacent.any(axis=1)), np.flatnonzero(adjacent.any(axis=0))
    parent = {("l", int(r)): ("l", int(r)) for r in rows} | {("r", int(c)): ("r", int(c)) for c in columns}

    def top(node: tuple[str, int]) -> tuple[str, int]:
        while parent[node] != node:
            parent[node] = node = parent[parent[node]]
        return node

    edges: list[tuple[int, int]] = []

    def join(row: int, col: int) -> None:
        a, b = top(("l", row)), top(("r", col))
        if a != b:
            parent[a] = b
            edges.append((int(left[row]), int(right[col])))

    for r in rows.tolist():
        join(r, int(from_rows[r]))
    for c in columns.tolist():
        join(int(from_columns[c]), c)
    tops = {node: top(node) for node in parent}
    if len(set(tops.values())) > 1:
        numbers = {t: i for i, t in enumerate(dict.fromkeys(tops.values()))}
        of_rows = np.array([numbers[tops["l", int(r)]] for r in rows])
        of_columns = np.array([numbers[tops["r", int(c)]] for c in columns])
        for i, r in enumerate(rows.tolist()):
            across = adjacent[r, columns] & (of_columns != of_rows[i])
            if across.any():
                other, first = np.unique(of_columns[across], return_index=True)
                for c in columns[across][first].tolist():
                    join(r, c)
                del other
    return np.array(edges, dtype=np.int64).reshape(-1, 2)


def _compare(cells: DataFrame, least: float) -> DataFrame:
    """Per class at home in a block: links to other classes, weighted by their rows (``links``), or edges (``other``)."""
    sizes = stage(
        cells.groupBy("label", "size", "cell").agg(F.count_if("home").alias("homes"), F.count(F.lit(1)).alias("all"))
    )
    blocks = lambda name: F.greatest(F.ceil(F.col(name) / BLOCK_ROWS), F.lit(1)).cast("int")
    cut = cells.join(sizes, ["label", "size", "cell"]).withColumns({"bi": blocks("homes"), "bj": blocks("all")})
    own = F.pmod(F.xxhash64("cls"), F.col("bi")).cast("int")
    met = F.pmod(F.xxhash64("cls"), F.col("bj")).cast("int")
    as_left = cut.where("home").select("label", "size", "cell", own.alias("i"), F.explode(F.sequence(F.lit(0), F.col("bj") - 1)).alias("j"), "cls", F.lit(True).alias("left"), "n", "vector")
    as_right = cut.select("label", "size", "cell", F.explode(F.sequence(F.lit(0), F.col("bi") - 1)).alias("i"), met.alias("j"), "cls", F.lit(False).alias("left"), "n", "vector")

    def links(group: pd.DataFrame) -> pd.DataFrame:
        home, all_rows = group[group["left"]], group[~group["left"]]
        none = pd.DataFrame({"cls": pd.Series(dtype="int64"), "other": pd.Series(dtype="Int64"), "links": pd.Series(dtype="int64")})
        if home.empty or all_rows.empty:
            return none
        left, right = home["cls"].to_numpy(), all_rows["cls"].to_numpy()
        a, b, weight = unit(np.stack(home["vector"].to_numpy())), unit(np.stack(all_rows["vector"].to_numpy())), all_rows["n"].to_numpy()
        adjacent = np.zeros((len(a), len(b)), dtype=bool)
        for first in range(0, len(a), _SLICE):
            adjacent[first : first + _SLICE] = a[first : first + _SLICE] @ b.T >= least
        adjacent &= left[:, None] != right[None, :]
        counts = adjacent @ weight.astype(np.float64)
        found = counts > 0
        if not found.any():
            return none
        edges = _spanning(adjacent, left, right)
        return pd.concat(
            [
                pd.DataFrame({"cls": left[found], "other": pd.array([pd.NA] * int(found.sum()), dtype="Int64"), "links": counts[found].astype(np.int64)}),
                pd.DataFrame({"cls": edges[:, 0], "other": pd.array(edges[:, 1], dtype="Int64"), "links": 0}),
            ]
        )

    tasks = as_left.unionByName(as_right).groupBy("label", "size", "cell", "i", "j")
    return tasks.applyInPandas(links, "cls long, other long, links long")


def near_vectors(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    least: float = LEAST_COSINE,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """``key`` of every row with ``n_links`` (other rows of the same label whose cosine is ``least`` or more),
    ``component_id`` (the least key reachable over links, the row's own included) and ``kept`` (whether it is the row's own).

    Rows with a null label link with nothing, nor do vectors that are null, zero or hold a null or non-finite component;
    they stay alone. Vectors of different length never link. Repeated rows link with each other. A null key stands behind all
    others, and a row with one in a group of such has no component id and is not kept. No rows give no rows. Other columns
    are left out.
    """
    rows = df.select(column(key).alias("key"), column(vector).alias("vector"), column(label).alias("label"))
    rows = rows.withColumn("ok", usable(F.col("vector")) & F.col("label").isNotNull())
    rows = stage(rows.withColumn("size", F.size("vector")))
    good = rows.where("ok")
    classes = good.groupBy("label", "size", "vector").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first"))
    classes = stage(classes.withColumn("cls", F.monotonically_increasing_id()))
    reach = math.sqrt(max(0.0, 2 - 2 * least)) * (1 + 1e-9) + 1e-9
    cells = stage(_in_cells(classes, _centres(classes, cell_rows), reach))
    found = stage(_compare(cells, least))
    counts = found.groupBy("cls").agg(F.sum("links").alias("far"))
    edges = found.where(F.col("other").isNotNull()).select(F.col("cls").alias("u"), F.col("other").alias("v"))
    roots = components(edges).withColumnRenamed("node", "cls")
    named = classes.drop("vector").join(counts, "cls", "left").join(roots, "cls", "left")
    named = stage(named.withColumn("root", F.coalesce("root", "cls")))
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(ids, "root").select("cls", "n", F.coalesce("far", F.lit(0)).alias("far"), "component_id")
    of = stage(classes.select("cls", "label", "size", "vector").join(named, "cls").drop("cls"))
    linked = good.join(of, ["label", "size", "vector"]).select(
        "key", (F.col("far") + F.col("n") - 1).cast("long").alias("n_links"), "component_id"
    )
    alone = rows.where("not ok").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    result = linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)))
    return result.withColumnRenamed("key", key)
