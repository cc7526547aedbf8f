"""Projections, filters and row shaping."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweft.functions.text import cell_at, is_blank, split_fields, trim_ws


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """The frame itself; ``ValueError`` when a column is missing."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def reorder_columns(df: DataFrame, wanted: Sequence[str], strict: bool = False) -> DataFrame:
    """Wanted columns first, the others after in their own order. Unknown names are ignored unless ``strict``."""
    if strict:
        require_columns(df, wanted)
    first = [name for name in wanted if name in df.columns]
    return df.select(*first, *[name for name in df.columns if name not in first])


def shape_ragged(cells: Column, names: Sequence[str], overflow: str = "overflow") -> list[Column]:
    """Named cells padded with ``''`` and the surplus cells as one array column."""
    named = [cell_at(cells, i).alias(name) for i, name in enumerate(names)]
    surplus = F.when(F.size(cells) > len(names), F.slice(cells, len(names) + 1, F.size(cells) - len(names)))
    return [*named, F.coalesce(surplus, F.array().cast("array<string>")).alias(overflow)]


def split_positional(lines: DataFrame, names: Sequence[str], delimiter: str = "\t", value: str = "value") -> DataFrame:
    """Positional records of a line frame: blank lines dropped, short rows padded, surplus kept in ``overflow``.

    The other columns of ``lines`` stay in front.
    """
    kept = [name for name in lines.columns if name != value]
    cells = split_fields(F.rtrim(F.col(value), F.lit("\n")), delimiter)
    return lines.where(~is_blank(F.col(value))).select(*kept, *shape_ragged(cells, names))


def project_defaults(df: DataFrame, source: str, names: Sequence[str], default: str = "") -> DataFrame:
    """Fixed list of fields out of a struct or map column; absent ones get ``default``. Other columns are dropped."""
    return df.select(*[F.coalesce(F.col(source)[name].cast("string"), F.lit(default)).alias(name) for name in names])


def filter_rows(df: DataFrame, condition: Column | Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """Rows that satisfy a ``Column``, or a callable that maps a batch of rows to booleans."""
    if isinstance(condition, Column):
        return df.where(condition)

    def keep(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            yield batch[condition(batch).astype(bool)]

    return df.mapInPandas(keep, df.schema)


def filter_equal(df: DataFrame, column: str, value: str | None) -> DataFrame:
    """Rows whose column equals ``value``; an empty value filters nothing.

    A missing column is an error, and so is a filter no row passes.
    """
    if not value:
        return df
    require_columns(df, [column])
    kept = df.where(F.col(column) == value)
    if kept.isEmpty():
        raise ValueError(f"no row with {column} = {value!r}")
    return kept


def filter_status(
    df: DataFrame, name: str, flag: str, yes: str, stamp: str | None = None, dates: Sequence[str] = ()
) -> DataFrame:
    """Distinct trimmed names of rows whose flag is ``yes``; with ``dates``, only rows whose stamp contains one."""
    require_columns(df, [name, flag, *([stamp] if stamp else [])])
    wanted = trim_ws(F.col(flag)) == yes
    if dates and stamp:
        any_date = F.lit(False)
        for date in dates:
            any_date = any_date | F.contains(F.col(stamp), F.lit(date))
        wanted = wanted & any_date
    return df.where(wanted).select(trim_ws(F.col(name)).alias(name)).where(F.col(name) != "").distinct()


def drop_blank(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines trimmed, blank ones dropped."""
    return lines.withColumn(value, trim_ws(F.col(value))).where(F.col(value) != "")


def with_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose column starts with the prefix."""
    return df.where(F.col(column).startswith(prefix))


def cast_columns(
    df: DataFrame, numbers: Sequence[str] = (), dates: Sequence[str] = (), date_format: str = "yyyy-MM-dd"
) -> DataFrame:
    """Listed text columns as double or date; text that does not fit becomes NULL."""
    casts = {name: trim_ws(F.col(name)).try_cast("double") for name in numbers}
    casts |= {name: F.try_to_date(trim_ws(F.col(name)), date_format) for name in dates}
    return df.withColumns(casts)
