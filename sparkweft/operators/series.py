"""Trailing means over time series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweft.functions.json_text import parse_object
from sparkweft.functions.signals import advice, deviation, preferred_series, relation
from sparkweft.operators.ordinal import with_ordinal
from sparkweft.operators.similarity import rank_top

DEFAULT_WIDTH = 170

_VALUES = T.ArrayType(T.DoubleType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


CHART = _struct(
    chart=_struct(
        result=T.ArrayType(
            _struct(
                meta=_struct(regularMarketPrice=T.DoubleType()),
                indicators=_struct(
                    adjclose=T.ArrayType(_struct(adjclose=_VALUES)), quote=T.ArrayType(_struct(close=_VALUES))
                ),
            )
        )
    )
)


def chart_points(documents: DataFrame, ticker: str, value: str = "value") -> DataFrame:
    """``ticker``, ``price``, ``week`` and ``close`` of chart documents: adjusted closes if there are any, else raw
    ones, without NULLs. A document without result gives one row with NULL week and close."""
    result = F.get(parse_object(F.col(value), CHART)["chart"]["result"], F.lit(0))
    charts = documents.select(F.col(ticker), result.alias("r"))
    closes = preferred_series(
        F.get(F.col("r.indicators.adjclose"), F.lit(0))["adjclose"],
        F.get(F.col("r.indicators.quote"), F.lit(0))["close"],
    )
    return charts.select(
        ticker, F.col("r.meta.regularMarketPrice").alias("price"), F.posexplode_outer(closes).alias("week", "close")
    )


def trailing_mean(
    df: DataFrame, series: str, order: str, value: str, width: int = DEFAULT_WIDTH, block_rows: int = 20_000
) -> DataFrame:
    """Every non-NULL point with the mean of the last ``width`` points of its series, NULL while there are fewer.

    Rows are numbered over all series and cut into blocks. Each block also gets the ``width - 1`` rows before it, so
    the window of every row lies in one block and a series of any length is spread over the cluster.
    """
    block_rows = max(block_rows, width)
    numbered = with_ordinal(df.where(F.col(value).isNotNull()), [series, order], "__n", start=0)
    own = F.floor(F.col("__n") / block_rows)
    reach = F.floor((F.col("__n") + F.lit(width - 1)) / block_rows)
    placed = numbered.withColumn("__own", own).withColumn("__block", F.explode(F.sequence(own, reach)))
    ordered = W.partitionBy("__block", series).orderBy("__n")
    enough = F.lag("__n", width - 1).over(ordered).isNotNull() if width > 1 else F.lit(True)
    mean = F.when(enough, F.avg(value).over(ordered.rowsBetween(1 - width, 0)))
    return placed.withColumn("trailing_mean", mean).where(F.col("__own") == F.col("__block")).select(
        *df.columns, "trailing_mean"
    )


def series_signals(
    points: DataFrame,
    series: str,
    order: str,
    value: str,
    price: Column | None = None,
    width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """Latest trailing mean of every series with price, deviation, relation and advice.

    The price is the last point unless given. A series with fewer than ``width`` points has ``status`` ``short
    history`` and no mean. Only the last ``width`` points of a series leave each task.
    """
    keep = points.withColumn("__p", price if price is not None else F.col(value))
    known = keep.where(F.col(value).isNotNull()).select(series, order, F.col(value).alias("__v"), "__p")
    recent = rank_top(known, [series], [f"{order} desc"], width, "__r")
    latest = recent.groupBy(series).agg(
        F.count(F.lit(1)).alias("points"),
        F.max_by("__p", order).alias("price"),
        F.avg("__v").alias("__mean"),
    )
    full = F.col("points") == width
    judged = latest.withColumn("trailing_mean", F.when(full, F.col("__mean")))
    percent = deviation(F.col("price"), F.col("trailing_mean"))
    return judged.select(
        series,
        "points",
        "price",
        "trailing_mean",
        percent.alias("deviation_percent"),
        relation(F.col("price"), F.col("trailing_mean")).alias("relation"),
        advice(percent).alias("advice"),
        F.when(full, "ok").otherwise("short history").alias("status"),
    )
