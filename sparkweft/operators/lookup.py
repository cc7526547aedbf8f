"""Batch key look-up in two replicas of a store."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweft.staging import stage_path

STORE_BUCKETS = 64
_ID = "store_key"


def _id(keys: Sequence[str]) -> Column:
    """All keys as one text, so that no key that is constant in a query drops out of the join; NULL if one is NULL."""
    present = reduce(lambda a, b: a & b, [F.col(key).isNotNull() for key in keys])
    return F.when(present, F.to_json(F.struct(*keys))).alias(_ID)


def bucketed_store(
    replica: DataFrame, keys: Sequence[str], buckets: int = STORE_BUCKETS, value: str = "value", path: str | None = None
) -> DataFrame:
    """A replica as a table of key text and ``value``, bucketed and sorted by the text, in ``path`` or a new folder of the checkpoint folder.

    It is written once, with one shuffle; look-ups in stores with equally many buckets then move none of their rows.
    """
    spark = replica.sparkSession
    place = path or stage_path(spark)
    name = "store_" + place.rstrip("/").rsplit("/", 1)[1].replace("-", "_")
    rows = replica.select(_id(keys), F.col(value).alias("value")).where(F.col(_ID).isNotNull()).repartition(buckets, _ID)
    rows.write.bucketBy(buckets, _ID).sortBy(_ID).option("path", place).saveAsTable(name)
    return spark.table(name)


def look_up_stores(requests: DataFrame, store_a: DataFrame, store_b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """:func:`compare_replicas` over two bucketed stores, whose keys have the names and types of the requests' keys.

    Only the distinct keys that are asked for are shuffled, to the buckets of the stores; requests, which may repeat a key
    any number of times, are joined to the values found. A NULL in a key finds nothing.
    """
    asked = requests.select("*", _id(keys))
    found = asked.select(_ID).where(F.col(_ID).isNotNull()).distinct()
    for store, name in ((store_a, "value_a"), (store_b, "value_b")):
        found = found.join(store.select(_ID, F.col("value").alias(name)).hint("merge"), _ID, "left")
    return asked.join(found, _ID, "left").drop(_ID).withColumn("agree", F.col("value_a").eqNullSafe(F.col("value_b")))


def compare_replicas(
    requests: DataFrame, replica_a: DataFrame, replica_b: DataFrame, keys: Sequence[str], value: str = "value"
) -> DataFrame:
    """Every request with its value in both replicas (NULL when absent) and whether they ``agree``.

    Each replica has a key at most once. The replicas meet in one aggregation; requests, which may repeat a key any
    number of times, are joined to its result last.
    """
    keys = list(keys)
    tagged = replica_a.select(*keys, F.lit(True).alias("__a"), F.col(value).alias("__v")).unionAll(
        replica_b.select(*keys, F.lit(False).alias("__a"), F.col(value).alias("__v"))
    )
    stored = tagged.groupBy(*keys).agg(
        F.max(F.when(F.col("__a"), F.col("__v"))).alias("value_a"),
        F.max(F.when(~F.col("__a"), F.col("__v"))).alias("value_b"),
    )
    return requests.join(stored, list(keys), "left").withColumn(
        "agree", F.col("value_a").eqNullSafe(F.col("value_b"))
    )
