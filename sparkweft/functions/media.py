"""Frame size and quality tier of a media probe result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweft.functions.binding import let
from sparkweft.functions.json_text import parse_object

# Tier names by the length of the short side, highest first.
TIERS = (
    (2160, "4K (2160p)"),
    (1440, "2K (1440p)"),
    (1080, "1080p"),
    (720, "720p"),
    (480, "480p"),
    (360, "360p"),
    (240, "240p"),
)

_STREAM = T.StructType([T.StructField("width", T.LongType()), T.StructField("height", T.LongType())])
_PROBE = T.StructType([T.StructField("streams", T.ArrayType(_STREAM))])


def quality_tier(width: Column, height: Column) -> Column:
    """Tier of the shorter side; below the lowest tier the size itself."""
    short = F.least(width, height)
    tier = F.when(short.isNull(), F.lit(None).cast("string"))
    for floor, name in TIERS:
        tier = tier.when(short >= floor, F.lit(name))
    return tier.otherwise(F.concat(width.cast("string"), F.lit("x"), height.cast("string"), F.lit(" (低清)")))


def probe_size(probe: Column) -> Column:
    """Struct ``{width, height, status}`` of the first stream of a probe document.

    ``status`` is ``ok``, ``bad json``, ``no stream`` or ``bad size``; the sizes are NULL unless it is ``ok``.
    """

    def of_document(document: Column) -> Column:
        streams = document["streams"]
        first = F.get(streams, F.lit(0))
        width = F.coalesce(first["width"], F.lit(0))
        height = F.coalesce(first["height"], F.lit(0))
        status = (
            F.when(document.isNull(), "bad json")
            .when(F.coalesce(F.size(streams), F.lit(0)) <= 0, "no stream")
            .when((width <= 0) | (height <= 0), "bad size")
            .otherwise("ok")
        )
        return F.struct(
            F.when(status == "ok", width).alias("width"),
            F.when(status == "ok", height).alias("height"),
            status.alias("status"),
        )

    return let(parse_object(probe, _PROBE), of_document)
