"""Ranked lexical search the other way round: the items' terms are an inverted index that goes to all tasks, and documents
stream through it.

The documents' texts are read once. Each is reduced to its number of terms and its counts of those terms that any item has,
and these rows are written. The corpus statistics are sums over them. Then every document's counts run through the index,
which gives its scores with all items that share a term with it, and each task keeps a heap of the best documents per item.
Heaps are merged in two steps, so what one task gets per item is bounded by the tasks of a bucket, not by the documents.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweft.llm.columns import column
from sparkweft.staging import stage

BEST = 20
BLOCK_BYTES = 16_000_000  # of item texts whose index is sent to all tasks at once; more items take another pass
MERGE_BUCKETS = 64
_SCORES = 1_000_000  # scores of a slice of documents that a task holds at once

# Term bytes: digits, letters, which become lower case, and every byte of a character beyond ASCII.
_TERM_BYTES = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def terms(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text in their order."""
    return text.translate(_TERM_BYTES).split()


class Index(NamedTuple):
    """Postings of a block of items: term ``t`` has the items ``items[starts[t]:starts[t + 1]]``, so often as ``times`` says."""

    vocabulary: dict[bytes, int]
    starts: np.ndarray
    items: np.ndarray
    times: np.ndarray
    size: int


def inverted(texts: list[bytes]) -> Index:
    vocabulary: dict[bytes, int] = {}
    found = []
    for item, text in enumerate(texts):
        for term, times in Counter(terms(text)).items():
            found.append((vocabulary.setdefault(term, len(vocabulary)), item, times))
    rows = np.array(sorted(found), dtype=np.int64).reshape(-1, 3)
    starts = np.searchsorted(rows[:, 0], np.arange(len(vocabulary) + 1))
    return Index(vocabulary, starts, rows[:, 1], rows[:, 2], len(texts))


def _counted(documents: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``key``, ``n`` (all terms), ``term`` and ``tf`` (counts of the vocabulary's terms) of documents with a term."""
    held = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            rows, sizes, found, times = [], [], [], []
            for row, text in enumerate(batch.column("text")):
                words = terms(text.as_buffer().to_pybytes()) if text.is_valid else []
                if words:
                    counts = Counter(filter(known.__contains__, words))
                    rows.append(row)
                    sizes.append(len(words))
                    found.append([known[word] for word in counts])
                    times.append(list(counts.values()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()),
                    pa.array(found, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64())),
                ],
                ["key", "n", "term", "tf"],
            )

    return documents.mapInArrow(count, "key long, n long, term array<int>, tf array<long>")


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class _Heaps:
    """The best documents of each item within one task, worst first."""

    def __init__(self, items: int, k: int) -> None:
        self.k = k
        self.heaps: list[list[tuple[int, int, int]]] = [[] for _ in range(items)]
        self.floor = np.zeros(items, dtype=np.int64)  # the least score that may still enter, less one until a heap is full

    def add(self, keys: list[int | None], scores: np.ndarray) -> None:
        rows, items = np.nonzero((scores > 0) & (scores >= self.floor[None, :]))
        for row, item, score in zip(rows.tolist(), items.tolist(), scores[rows, items].tolist(), strict=True):
            key, heap = keys[row], self.heaps[item]
            entry = (score, 0, 0) if key is None else (score, 1, -key)  # of equal scores the least key is best, null is worst
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.floor[item] = heap[0][0]

    def batch(self) -> pa.RecordBatch:
        rows = [(item, -key if known else None, score) for item, heap in enumerate(self.heaps) for score, known, key in heap]
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        kinds = [pa.int32(), pa.int64(), pa.int64()]
        arrays = [pa.array(list(values), kind) for values, kind in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, ["item", "key", "score"])


def _slices(starts: np.ndarray, items: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents with so few counts and scores that a task can hold them."""
    first, rows = 0, len(starts) - 1
    while first < rows:
        most = min(rows, first + max(1, _SCORES // max(items, 1)))
        last = max(first + 1, min(most, int(np.searchsorted(starts, starts[first] + _SCORES // 8, side="right")) - 1))
        yield first, last
        first = last


def _scored(index: Index, weights: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray, rows: int) -> np.ndarray:
    """Scores (document, item), in whole numbers. Postings are walked in runs of bounded length."""
    scores = np.zeros(rows * index.size, dtype=np.int64)
    gain = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
    fan = index.starts[term + 1] - index.starts[term]
    ends = np.cumsum(fan)
    first = 0
    while first < len(fan):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + _SCORES, side="right")))
        n = fan[first:last]
        at = np.repeat(index.starts[term[first:last]] - (ends[first:last] - n - before), n) + np.arange(n.sum())
        place = np.repeat(doc[first:last] * index.size, n) + index.items[at]
        np.add.at(scores, place, np.repeat(gain[first:last], n) * index.times[at])
        first = last
    return scores.reshape(rows, index.size)


def _searched(counts: DataFrame, index: Index, k: int) -> DataFrame:
    """``item`` (its place in the block), ``key``, ``score`` and ``rank`` of the best documents; ``counts`` is written."""
    spark = counts.sparkSession
    total = counts.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    n_docs, n_terms = total["n"], total["l"] or 0
    holding = np.zeros(len(index.vocabulary), dtype=np.int64)
    for row in counts.select(F.explode("term").alias("t")).groupBy("t").count().toLocalIterator():  # a row per item term
        holding[row["t"]] = row["count"]
    weights = np.array([term_weight(n_docs, int(df)) for df in holding], dtype=np.int64)
    held = spark.sparkContext.broadcast((index, weights))

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, own_weights = held.value
        heaps = _Heaps(own.size, k)
        for batch in batches:
            starts = batch.column("term").offsets.to_numpy()
            term, tf = (batch.column(c).values.to_numpy().astype(np.int64) for c in ("term", "tf"))
            keys = batch.column("key").to_pylist()
            sizes = [int(n) for n in batch.column("n").to_pylist()]
            m = np.array([75 + (25 * n * n_docs) // n_terms for n in sizes], dtype=np.int64)
            for first, last in _slices(starts, own.size):
                part = slice(starts[first], starts[last])
                doc = np.repeat(np.arange(last - first), np.diff(starts[first : last + 1]))
                heaps.add(keys[first:last], _scored(own, own_weights, doc, term[part], tf[part], m[first:last], last - first))
        yield heaps.batch()

    best = counts.mapInArrow(search, "item int, key long, score long")
    order = [F.desc("score"), F.asc_nulls_last("key")]
    merged = best.withColumn("b", F.pmod(F.spark_partition_id(), F.lit(MERGE_BUCKETS)))
    merged = merged.withColumn("rank", F.row_number().over(W.partitionBy("item", "b").orderBy(*order))).where(F.col("rank") <= k)
    merged = merged.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return merged.select("item", "key", "score", "rank")


def _item_blocks(items: DataFrame, block_bytes: int) -> Iterator[list[Row]]:
    """All items, with texts of about ``block_bytes`` at a time on the driver."""
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 64
    total = items.agg(F.sum(size)).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("text", "id"), F.lit(blocks)) == block)
        if rows := part.collect():
            yield rows


def best_documents(
    items: DataFrame,
    documents: DataFrame,
    item: str = "item_id",
    key: str = "doc_id",
    text: str = "text",
    k: int = BEST,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``item``, ``rank`` (from 1), ``key`` and ``score`` of the ``k`` best documents of each item, those with a score above 0.

    Both frames have a ``text``. Terms are runs of ASCII letters, lower-cased, ASCII digits and characters beyond ASCII, in
    whole texts. A document's score sums the weights of the item's terms, repeats included, times how far the document's count
    of the term is from saturation, a long document saturating later; all in whole numbers but for the logarithm. Equal scores
    go to the least key. ``key`` has to be of a whole number type.

    Null and empty texts have no term, so such documents count nowhere and such items find nothing, as do items whose terms no
    document has. Each row of ``items`` is searched for by itself, also if its id is null or repeated; each row of
    ``documents`` is a document of its own, and one with a null key comes last among equals. No rows give no rows. Other
    columns are left out. Items are taken in blocks of ``block_bytes`` of text; each block is a pass over the documents.
    """
    if not isinstance(documents.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} has to be a whole number")
    spark = items.sparkSession
    wanted = items.select(column(item).alias("id"), column(text).alias("text"))
    rows = documents.select(column(key).cast("long").alias("key"), column(text).cast("binary").alias("text"))
    out = T.StructType(
        [T.StructField("id", wanted.schema["id"].dataType), T.StructField("rank", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("score", T.LongType())]
    )
    parts = []
    for block in _item_blocks(wanted, block_bytes):
        index = inverted([(row["text"] or "").encode("utf-8", "surrogatepass") for row in block])
        best = _searched(stage(_counted(rows, index.vocabulary)), index, k)
        names = spark.createDataFrame([(place, row["id"]) for place, row in enumerate(block)], T.StructType([T.StructField("item", T.IntegerType()), out["id"]]))
        found = best.join(F.broadcast(names), "item").select("id", "rank", "key", "score")
        parts.append(stage(found))
    result = reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], out)
    named: list[Column] = [F.col("id").alias(item), "rank", F.col("key").cast(documents.schema[key].dataType).alias(key), "score"]
    return result.select(*named)
