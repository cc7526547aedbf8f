"""Summary tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summary_by(df: DataFrame, groups: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    """Measures over all rows and by each group column alone, in one pass.

    ``level`` names the group column (``total`` for all rows) and ``member`` its value as text.
    """
    sets = [[], *[[name] for name in groups]]
    table = df.groupingSets(sets, *groups).agg(
        *[F.grouping(name).alias(f"__g_{name}") for name in groups],
        *[measure.alias(name) for name, measure in measures.items()],
    )
    level, member = F.lit("total"), F.lit(None).cast("string")
    for name in reversed(groups):
        mine = F.col(f"__g_{name}") == 0
        level = F.when(mine, F.lit(name)).otherwise(level)
        member = F.when(mine, F.col(name).cast("string")).otherwise(member)
    return table.select(level.alias("level"), member.alias("member"), *measures)
