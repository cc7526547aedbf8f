"""Price against its trailing mean."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bound of the deviation in percent and the advice up to it.
ADVICE = ((0, "考虑买入"), (15, "持有观望"), (30, "分批卖 1/3"), (50, "分批再卖 1/3"))
ADVICE_ABOVE = "分批卖剩余"


def deviation(price: Column, mean: Column) -> Column:
    """Distance of the price from the mean in percent of the mean."""
    return (price - mean) / mean * 100


def advice(percent: Column) -> Column:
    """Advice tier of a deviation; NULL stays NULL."""
    tier = F.when(percent.isNull(), F.lit(None).cast("string"))
    for bound, text in ADVICE:
        tier = tier.when(percent <= bound, F.lit(text))
    return tier.otherwise(F.lit(ADVICE_ABOVE))


def relation(price: Column, mean: Column) -> Column:
    """``≥`` when the price is at or above the mean, else ``<``."""
    return F.when(price >= mean, "≥").when(price < mean, "<")


def preferred_series(adjusted: Column, raw: Column) -> Column:
    """The adjusted values if there are any, else the raw ones, without NULLs."""
    chosen = F.when(F.coalesce(F.size(adjusted), F.lit(0)) > 0, adjusted).otherwise(raw)
    return F.filter(chosen, lambda value: value.isNotNull())
