"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight that changes over training time, given at evenly spaced knots and linear between them. The
integral of the weight is the source's cumulative token demand; inverting it at the place of a document among its
source's tokens gives the time, and with it the training position, at which the document is due. Documents are then
range-sorted by position. DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkweft.llm.columns import WORD, column, others, packed, unpacked
from sparkweft.staging import stage

# Weight over time relative to its mean, by weight: small sources come early, heavy ones late.
SCHEDULE: Mapping[int, Sequence[float]] = {1: (1.5, 1.0, 0.5), 2: (1.0, 1.0, 1.0), 3: (0.5, 1.0, 1.5)}
MOST_REPEATS = 3
BROADCAST_SOURCES = 100_000  # a table of at most this many sources is broadcast, a larger one is joined by shuffle
BUCKET_ROWS = 20_000  # documents of a source ordered together


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """One row per source of ``sized`` (source, size): ``rank``, ``weight`` (1, 2, 3, repeating, in the order of code
    points with null last), ``source_size``, ``n_docs`` and ``target``.

    Targets share the total by weight. A source stops at ``most_repeats`` times its size; the sources that stop are those
    with the least size for their weight, so one running sum in that order finds them. Windows see one row per source.
    """
    everything = W.partitionBy()
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    ranked = sources.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.col("rank") % 3 + 1).withColumn("cap", most_repeats * F.col("source_size"))
    fill = W.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything)
    rest = total - F.coalesce(F.sum("cap").over(fill), F.lit(0))
    rest_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(fill), F.lit(0))
    level = ranked.withColumn("total", total).withColumn("full", F.col("cap") * rest_weight <= F.col("weight") * rest)
    full, free = F.when(F.col("full"), F.col("cap")), F.when(~F.col("full"), F.col("weight"))
    left = F.col("total") - F.coalesce(F.sum(full).over(everything), F.lit(0))
    share = F.col("weight").cast("double") * left / F.sum(free).over(everything)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share)
    return level.withColumn("target", target).select("source", "rank", "weight", "source_size", "n_docs", "target")


def _curves(targets: DataFrame, schedule: Mapping[int, Sequence[float]]) -> tuple[DataFrame, int]:
    """Adds to each source its weight at the knots (``v``), the integral up to them (``c``), and for each segment the
    coefficients of the total demand of all sources (``a``, ``b``, ``d``)."""
    segments = len(next(iter(schedule.values()))) - 1
    step = 1.0 / segments
    values = {}
    for k in range(segments + 1):
        value = F.lit(1.0)
        for weight, points in schedule.items():
            value = F.when(F.col("weight") == weight, F.lit(float(points[k]))).otherwise(value)
        values[f"v{k}"] = value
    curves = targets.withColumns(values).withColumn("c0", F.lit(0.0))
    for k in range(segments):
        area = (F.col(f"v{k}") + F.col(f"v{k + 1}")) / 2 * step
        curves = curves.withColumn(f"c{k + 1}", F.col(f"c{k}") + area)
    scale, everything = F.col("target") / F.col(f"c{segments}"), W.partitionBy()
    sums = {}
    for k in range(segments):
        bend = (F.col(f"v{k + 1}") - F.col(f"v{k}")) / (2 * step)
        sums |= {
            f"a{k}": F.sum(scale * F.col(f"c{k}")).over(everything),
            f"b{k}": F.sum(scale * F.col(f"v{k}")).over(everything),
            f"d{k}": F.sum(scale * bend).over(everything),
        }
    return curves.withColumns(sums), segments


def _position(demand: Column, segments: int) -> Column:
    """Training position, in tokens of all sources, at which a source has to deliver its ``demand``-th token."""
    step = 1.0 / segments
    area = F.when(F.col("target") > 0, demand / F.col("target")).otherwise(0.0) * F.col(f"c{segments}")
    found = F.lit(None).cast("double")
    for k in reversed(range(segments)):
        left = F.greatest(area - F.col(f"c{k}"), F.lit(0.0))
        slope = (F.col(f"v{k + 1}") - F.col(f"v{k}")) / step
        root = F.col(f"v{k}") + F.sqrt(F.greatest(F.col(f"v{k}") * F.col(f"v{k}") + 2 * slope * left, F.lit(0.0)))
        x = F.least(F.when(root > 0, 2 * left / root).otherwise(0.0), F.lit(step))
        here = F.col(f"a{k}") + F.col(f"b{k}") * x + F.col(f"d{k}") * x * x
        found = here if k == segments - 1 else F.when(area < F.col(f"c{k + 1}"), here).otherwise(found)
    return found


def _laid_out(
    df: DataFrame, size: Column, source: str, key: str, schedule: Mapping[int, Sequence[float]], seed: str
) -> tuple[DataFrame, int]:
    """Every row, packed, with its source's numbers, ``taken``, ``copies`` and ``offset`` among its source's tokens."""
    sized = df.select(
        packed(df), size.alias("size"), column(source).alias("source"),
        F.md5(F.concat_ws(":", F.lit(seed), column(key).cast("string")).cast("binary")).alias("draw"),
    )
    sized = stage(sized)  # texts are counted once; the sums below read two columns
    curves, segments = _curves(source_targets(sized), schedule)
    targets = stage(curves.withColumnRenamed("source", "of"))
    n_sources, n_docs = targets.agg(F.count(F.lit(1)), F.max("n_docs")).first()
    digits = 2
    while 16**digits * BUCKET_ROWS < (n_docs or 0):
        digits += 1
    side = F.broadcast(targets) if n_sources <= BROADCAST_SOURCES else targets
    same, bucket = F.col("source").eqNullSafe(F.col("of")), F.substring("draw", 1, digits).alias("bucket")
    rows = sized.join(side, same).withColumn("bucket", bucket)
    within = W.partitionBy("rank", "bucket").orderBy("draw", "size").rowsBetween(W.unboundedPreceding, -1)
    sums = sized.select("source", "size", bucket).join(side.select("of", "rank"), same)
    sums = sums.groupBy("rank", "bucket").agg(F.sum("size").alias("held"))
    before = W.partitionBy("rank").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("rank", "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("first"))
    placed = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, ["rank", "bucket"])
    placed = placed.withColumn("offset", F.col("first") + F.col("inner"))
    quota, whole = F.floor(F.col("target") + 0.5), F.col("source_size")
    rounds = F.when(whole > 0, F.floor(quota / whole)).otherwise(0).cast("long")
    last = F.greatest(F.lit(0), F.least(F.col("size"), quota - rounds * whole - F.col("offset")))
    copies = F.when(F.col("size") > 0, rounds + (last > 0).cast("long")).otherwise(0).cast("int")
    return placed.withColumns({"taken": (rounds * F.col("size") + last).cast("long"), "copies": copies}), segments


def mix(
    df: DataFrame,
    size: Column,
    source: str = "source",
    key: str = "doc_id",
    schedule: Mapping[int, Sequence[float]] = SCHEDULE,
    seed: str = "mix",
) -> DataFrame:
    """Every row with ``size``, ``source_size``, ``target`` (both of its source), ``taken``, ``copies`` and
    ``position``, sorted by position over all partitions.

    The tokens of a source are laid end to end in the order of a hash of ``key``, again and again until its target is
    reached; the last document is cut there, so ``taken`` adds up to the rounded target. ``copies`` counts the times a
    document begins before the target, ``position`` is where its first copy is due (null without one).

    Null sources form one source, null keys are a key like others, null texts have size 0 and are not taken. Repeated
    rows are taken independently. No rows give no rows. Columns with the names of the results are replaced. Documents
    of one source are ordered in buckets of the hash, so a source with a third of all rows is spread.
    """
    placed, segments = _laid_out(df, size, source, key, schedule, seed)
    added = ["size", "source_size", "target", "taken", "copies", "position"]
    due = F.when(F.col("copies") > 0, _position(F.col("offset").cast("double"), segments))
    mixed = placed.withColumn("position", due).repartitionByRange("position", "draw")
    return mixed.sortWithinPartitions("position", "draw").select(*unpacked(others(df, *added)), *added)


def mixed_documents(
    df: DataFrame,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    schedule: Mapping[int, Sequence[float]] = SCHEDULE,
    seed: str = "mix",
) -> DataFrame:
    """The corpus that the mix trains on, in training order, with the columns of ``df``: each document as often as it
    begins before its source's target, whole each time. Documents without words, and those of a source with a target
    below its size that come after it, are left out."""
    placed, segments = _laid_out(df, word_count(column(text)), source, key, schedule, seed)
    again = F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy")
    repeated = placed.where(F.col("copies") > 0).select("*", again)
    demand = F.col("copy").cast("double") * F.col("source_size") + F.col("offset")
    due = repeated.withColumn("position", _position(demand, segments)).repartitionByRange("position", "draw")
    return due.sortWithinPartitions("position", "draw").select(*unpacked(df.columns))
