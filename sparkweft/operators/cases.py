"""Case libraries: nearest-case classification and changes to the library table."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from sparkweft.operators.blocks import matrix, row_slices, score
from sparkweft.operators.ordinal import with_group_ordinal, with_ordinal
from sparkweft.operators.similarity import best_per_row, rank_top

# Fixed value: the class of items no case is close enough to.
UNCLASSIFIED = "未分类"
EMPTY_CLASS_SCORE = -1.0
MAX_LIBRARY_BLOCK = 50_000
ITEM_BLOCK = 8192
SAMPLE_BLOCKS_PER_TASK = 64
MERGE_EVERY = 16


def _block_count(rows: int, max_rows: int) -> int:
    """Hash buckets of about four fifths of a block each."""
    return max(1, -(-5 * rows // (4 * max_rows)))


def _packed(df: DataFrame, key: str, columns: list[str], max_rows: int, name: str) -> tuple[DataFrame, int]:
    """Rows as blocks of at most ``max_rows``: one row per block with column ``block`` and the rows as list ``name``.
    Rows go to hash buckets by ``key``; a bucket that is too full is cut in numbered pieces."""
    rows = df.count()
    bucket = F.pmod(F.xxhash64(key), F.lit(_block_count(rows, max_rows)))
    numbered = df.withColumn("__bucket", bucket).withColumn(
        "__piece", F.floor((F.row_number().over(W.partitionBy("__bucket").orderBy(key)) - 1) / max_rows)
    )
    packed = numbered.groupBy("__bucket", "__piece").agg(F.collect_list(F.struct(*columns)).alias(name))
    return packed.select(F.concat_ws("-", "__bucket", "__piece").alias("block"), name), rows


def _class_scores(vectors: np.ndarray, samples: np.ndarray, owner: np.ndarray, classes: int) -> np.ndarray:
    """Best score of each row per class, starting at ``EMPTY_CLASS_SCORE``."""
    best = np.full((len(vectors), classes), EMPTY_CLASS_SCORE)
    if len(samples):
        order = np.argsort(owner, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(owner[order]) != 0])
        scores = score(vectors, samples[order], "cosine")
        found = np.maximum.reduceat(scores, starts, axis=1)
        best[:, owner[order][starts]] = np.maximum(found, EMPTY_CLASS_SCORE)
    return best


def _block_best(
    vectors: np.ndarray, case_no: pa.Array, samples: np.ndarray, top_k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item rows, case numbers and scores of the ``top_k`` best classes of each item within one block of samples."""
    cases, owner = np.unique(case_no.to_numpy(zero_copy_only=False).astype(np.int64), return_inverse=True)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for part in row_slices(len(vectors), max(len(samples), len(cases))):
        scores = _class_scores(vectors[part], samples, owner, len(cases))
        rows, cols = best_per_row(scores, top_k)
        found.append((rows + part.start, cases[cols], scores[rows, cols]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(column) for column in zip(*found))  # type: ignore[return-value]


def _merged(
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], top_k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best score of each item and class over several blocks, cut to the ``top_k`` best classes of each item (ties to
    the lower ``case_no``), with their ranks."""
    rows, cases, scores = (np.concatenate(column) for column in zip(*found))
    order = np.lexsort((-scores, cases, rows))
    rows, cases, scores = rows[order], cases[order], scores[order]
    first = np.r_[True, (np.diff(rows) != 0) | (np.diff(cases) != 0)]
    rows, cases, scores = rows[first], cases[first], scores[first]
    order = np.lexsort((cases, -scores, rows))
    rows, cases, scores = rows[order], cases[order], scores[order]
    ranks = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") + 1
    keep = ranks <= top_k
    return rows[keep], cases[keep], scores[keep], ranks[keep]


def _batch(
    ids: pa.Array, rows: np.ndarray, cases: np.ndarray, scores: np.ndarray, ranks: np.ndarray, schema: pa.Schema
) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(rows)), pa.array(cases), pa.array(scores), pa.array(ranks)], schema=schema
    )


def nearest_classes(
    items: DataFrame,
    library: DataFrame,
    top_k: int = 1,
    item: str = "item_id",
    vector: str = "embedding",
    max_library_block: int = MAX_LIBRARY_BLOCK,
) -> DataFrame:
    """The ``top_k`` best classes of every item: ``item``, ``case_no``, ``case_name``, ``similarity``, ``rank``.

    A class scores its best sample; a class without vectors scores -1. Ties go to the lower ``case_no``. Items
    without vector are left out. Items and samples are met block by block in Spark tasks, at most ``max_library_block``
    samples at a time; nothing of the library passes through the driver.
    """
    items = items.where(F.col(vector).isNotNull()).select(item, vector)
    names = library.select("case_no", "case_name").distinct()
    samples = library.where("embedding is not null").select(
        F.concat_ws("-", "case_no", "idx").alias("sample"), "case_no", "embedding"
    )
    schema = T.StructType(
        [
            items.schema[item],
            T.StructField("case_no", T.LongType()),
            T.StructField("similarity", T.DoubleType()),
            T.StructField("rank", T.LongType()),
        ]
    )
    arrow_schema = to_arrow_schema(schema)

    def nearest(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        # A task meets one item block after another, each with all sample blocks of the task; the best classes of
        # every sample block are merged before the item block is left, so a task emits at most top_k rows per item.
        held, ids, vectors, found = None, None, None, []
        for batch in batches:
            for row in range(batch.num_rows):
                block = batch.column("item_block")[row].as_py()
                if block != held:
                    if found:
                        yield _batch(ids, *_merged(found, top_k), arrow_schema)
                    mine = batch.column("items")[row].values
                    held, ids, vectors, found = block, mine.field(item), matrix(mine.field(vector)), []
                theirs = batch.column("samples")[row].values
                found.append(_block_best(vectors, theirs.field("case_no"), matrix(theirs.field("embedding")), top_k))
                if len(found) >= MERGE_EVERY:
                    found = [_merged(found, top_k)[:3]]
        if found:
            yield _batch(ids, *_merged(found, top_k), arrow_schema)

    # Items and samples are packed into blocks of bounded rows. Item blocks fall into parts i and sample blocks into a
    # few parts j; each block is copied to every part of the other side, and a join on (i, j) pairs every item block
    # with every sample block, no broadcast. The block that holds a class's best sample ranks the class at least as high
    # as it ranks overall, so the best classes of each block are enough. Of classes without vectors, all of which score
    # the same, the first few are.
    item_blocks, item_count = _packed(items, item, [item, vector], ITEM_BLOCK, "items")
    sample_blocks, sample_count = _packed(samples, "sample", ["case_no", "embedding"], max_library_block, "samples")
    item_parts = _block_count(item_count, ITEM_BLOCK)
    sample_parts = max(1, -(-_block_count(sample_count, max_library_block) // SAMPLE_BLOCKS_PER_TASK))
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    part = lambda parts: F.pmod(F.xxhash64("block"), F.lit(parts))
    item_blocks = item_blocks.select(part(item_parts).alias("i"), every(sample_parts).alias("j"), F.col("block").alias("item_block"), "items")
    sample_blocks = sample_blocks.select(every(item_parts).alias("i"), part(sample_parts).alias("j"), "samples")
    pairs = item_blocks.join(sample_blocks.hint("merge"), ["i", "j"])
    partial = pairs.mapInArrow(nearest, schema).select(item, "case_no", "similarity")
    bare = names.select("case_no").join(samples, "case_no", "left_anti").distinct().orderBy("case_no").limit(top_k)
    empty = [row["case_no"] for row in bare.collect()]
    if empty:
        without = F.explode(F.array(*[F.lit(case).cast("long") for case in empty])).alias("case_no")
        partial = partial.unionAll(items.select(item, without).withColumn("similarity", F.lit(EMPTY_CLASS_SCORE)))
    scored = partial.groupBy(item, "case_no").agg(F.max("similarity").alias("similarity"))
    best = rank_top(scored, [item], ["similarity desc", "case_no"], top_k)
    return best.join(names, "case_no", "left").select(item, "case_no", "case_name", "similarity", "rank")


def classify(
    items: DataFrame, library: DataFrame, threshold: float = 0.0, item: str = "item_id", vector: str = "embedding"
) -> DataFrame:
    """``item`` and ``case_name``: the nearest class, or ``UNCLASSIFIED`` below the threshold, without a vector or
    with an empty library."""
    nearest = nearest_classes(items, library, 1, item, vector)
    close = F.when(F.col("similarity") >= threshold, F.col("case_name")).otherwise(UNCLASSIFIED)
    without = items if library.isEmpty() else items.where(F.col(vector).isNull())
    return nearest.select(item, close.alias("case_name"), "similarity").unionAll(
        without.select(item, F.lit(UNCLASSIFIED), F.lit(None).cast("double"))
    )


def add_cases(library: DataFrame, samples: DataFrame, order_by: str = "path") -> DataFrame:
    """Append samples (``case_name, path, embedding, description``) to their classes, in ``order_by`` order.

    Samples without vector are refused. New classes come after the known ones, by name.
    """
    known = library.groupBy("case_name").agg(
        F.first("case_no").alias("case_no"), (F.max("idx") + 1).alias("next_idx")
    )
    last = library.agg(F.coalesce(F.max("case_no"), F.lit(-1)).alias("last")).head()["last"]
    usable = samples.where("embedding is not null")
    numbered = with_group_ordinal(usable, ["case_name"], [order_by], "__n", start=0)
    fresh = usable.select("case_name").distinct().join(known, "case_name", "left_anti")
    fresh = with_ordinal(fresh, ["case_name"], "__m", start=0).select("case_name", (F.col("__m") + F.lit(last + 1)).alias("case_no"), F.lit(0).alias("next_idx"))
    places = known.select("case_name", "case_no", "next_idx").unionByName(fresh)
    added = numbered.join(places, "case_name", "left").select(
        "case_no", "case_name", (F.col("next_idx") + F.col("__n")).cast("long").alias("idx"), "path", "embedding",
        "description",
    )
    return library.select(*added.columns).unionByName(added)


def remove_class(library: DataFrame, case_name: str) -> DataFrame:
    """Library without a class."""
    return library.where(~F.col("case_name").eqNullSafe(F.lit(case_name)))


def has_case(library: DataFrame, case_name: str, idx: int | None = None) -> bool:
    """Whether the class, or the sample of it, exists: the answer a removal gives."""
    found = library.where(F.col("case_name") == case_name)
    return not (found if idx is None else found.where(F.col("idx") == idx)).isEmpty()


def remove_sample(library: DataFrame, case_name: str, idx: int) -> DataFrame:
    """Library without one sample; later samples of the class move up. A class without samples is gone."""
    mine = F.col("case_name").eqNullSafe(F.lit(case_name))
    moved: Column = F.when(mine & (F.col("idx") > idx), F.col("idx") - 1).otherwise(F.col("idx"))
    return library.where(~(mine & F.col("idx").eqNullSafe(F.lit(idx)))).withColumn("idx", moved)


def list_classes(library: DataFrame) -> DataFrame:
    """Classes in library order with their number of samples."""
    return (
        library.groupBy("case_no", "case_name").agg(F.count(F.lit(1)).alias("samples")).orderBy("case_no")
    )


def get_sample(library: DataFrame, case_name: str, idx: int = 0) -> DataFrame:
    """One sample, the first by default; empty when there is none."""
    return library.where((F.col("case_name") == case_name) & (F.col("idx") == idx))
