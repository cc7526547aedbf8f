"""Row numbers without a one-task window.

Rows are range-partitioned and sorted by the order key, written once with their partition and position, and numbered
by adding the row counts of the partitions before. The only data outside the distributed rows is one count per
partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweft.staging import stage

_PART, _POS, _TIE, _SEQ, _BEFORE, _COUNT, _GROUP, _FIRST = (
    "__part", "__pos", "__tie", "__seq", "__before", "__count", "__group", "__first",
)
_POSITION_BITS = (1 << 33) - 1  # monotonically_increasing_id keeps the row number in its low 33 bits


def _hashable(data_type: T.DataType) -> bool:
    text = data_type.simpleString()
    return "map<" not in text and "variant" not in text


def _place(df: DataFrame, order_by: Sequence[str | Column]) -> DataFrame:
    """Rows in range-partitioned order, written with their partition and their position in it.

    Rows that tie on the order key are told apart by a hash of the row and equal rows by their place in the task, so
    a key shared by a large part of the rows still spreads over many partitions. The place is taken after a local
    sort: a task that runs again, with its rows in another order, then sends equal rows to the same partitions.
    """
    hashed = [F.col(f.name) for f in df.schema.fields if _hashable(f.dataType)]
    keys = [F.col(c) if isinstance(c, str) else c for c in order_by] + [F.col(_TIE)]
    tied = df.withColumn(_TIE, F.xxhash64(*hashed) if hashed else F.lit(0))
    order = [*keys, F.col(_SEQ)]
    return stage(
        tied.sortWithinPartitions(*keys)
        .withColumn(_SEQ, F.monotonically_increasing_id())
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(
            *df.columns,
            F.spark_partition_id().alias(_PART),
            F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_BITS)).alias(_POS),
        )
    )


def with_ordinal(
    df: DataFrame, order_by: Sequence[str | Column], name: str = "ordinal", start: int = 1
) -> DataFrame:
    """Number all rows ``start, start+1, …`` in the order of ``order_by``."""
    placed = _place(df, order_by)
    before = W.orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    offsets = (
        placed.groupBy(_PART)
        .agg(F.count(F.lit(1)).alias(_COUNT))
        .select(_PART, F.coalesce(F.sum(_COUNT).over(before), F.lit(0)).alias(_BEFORE))
    )
    return placed.join(F.broadcast(offsets), _PART).select(
        *df.columns, (F.col(_BEFORE) + F.col(_POS) + F.lit(start)).cast("long").alias(name)
    )


def with_group_ordinal(
    df: DataFrame, group: Sequence[str], order_by: Sequence[str], name: str = "ordinal", start: int = 1
) -> DataFrame:
    """Number the rows of each group.

    A group may lie in many partitions. Each of its pieces is numbered from the piece's first position and the sizes
    of the pieces before, so rows are joined to pieces, which are never larger than a partition.
    """
    placed = _place(df, [*group, *order_by]).withColumn(_GROUP, F.struct(*group))  # as a struct, NULL equals NULL
    before = W.partitionBy(_GROUP).orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)  # one row per piece
    pieces = (
        placed.groupBy(_PART, _GROUP)
        .agg(F.min(_POS).alias(_FIRST), F.count(F.lit(1)).alias(_COUNT))
        .select(_PART, _GROUP, _FIRST, F.coalesce(F.sum(_COUNT).over(before), F.lit(0)).alias(_BEFORE))
    )
    number = F.col(_POS) - F.col(_FIRST) + F.col(_BEFORE) + F.lit(start)
    return placed.join(pieces, [_PART, _GROUP]).select(*df.columns, number.cast("long").alias(name))


def with_chunk_id(df: DataFrame, order_by: Sequence[str | Column], chunk_size: int = 1000) -> DataFrame:
    """Add ``ordinal`` (from 1) and ``chunk_id`` (from 0): consecutive groups of ``chunk_size`` rows, last one short."""
    if chunk_size < 1:
        raise ValueError("chunk_size must be at least 1")
    numbered = with_ordinal(df, order_by)
    return numbered.withColumn("chunk_id", F.floor((F.col("ordinal") - 1) / chunk_size))


def paged(df: DataFrame, order_by: Sequence[str | Column], name: str = "ordinal") -> DataFrame:
    """All rows, numbered from 1 and written in the order of their numbers: an index for :func:`page`. Every row group of the
    written files spans few numbers, so a range of numbers reads only the row groups that hold it."""
    numbered = with_ordinal(df, order_by, name)
    return stage(numbered.repartitionByRange(name).sortWithinPartitions(name))


def page(index: DataFrame, first: int, rows: int, name: str = "ordinal") -> DataFrame:
    """Rows ``first`` to ``first + rows - 1`` of a :func:`paged` frame."""
    return index.where(F.col(name).between(first, first + rows - 1))


def iterate_pages(index: DataFrame, first: int = 1, page_rows: int = 1000, name: str = "ordinal") -> Iterator[list[Row]]:
    """Pages of a :func:`paged` frame for a caller's own loop, from row ``first`` on, in order. The driver holds one page, and a
    loop that has stopped goes on at any row, without the rows before."""
    if page_rows < 1:
        raise ValueError("page_rows must be at least 1")
    while rows := page(index, first, page_rows, name).orderBy(name).collect():
        yield rows
        first += page_rows


def map_chunks(chunks: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run ``work`` on every chunk of :func:`with_chunk_id` as a pandas frame; chunks are bounded by their size."""
    return chunks.groupBy("chunk_id").applyInPandas(work, schema)


def member_lists(
    df: DataFrame, group: str, member: str, list_rows: int = 10_000, name: str = "members"
) -> DataFrame:
    """Members of each group as ordered lists of at most ``list_rows``.

    Only a group with more members than that has several ``part`` rows, counted from 0 in the order of its members, so no
    list grows with the data and none depends on other groups.
    """
    numbered = with_group_ordinal(df.select(group, member), [group], [member], "__n", start=0)
    part = F.floor(F.col("__n") / list_rows).alias("part")
    lists = numbered.groupBy(group, part).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("__n", F.col(member).alias("m")))), lambda item: item["m"]
        ).alias(name)
    )
    return lists
