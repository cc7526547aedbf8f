"""Names and small expressions shared by the operators of this folder."""

from __future__ import annotations

import sys
from collections.abc import Callable
from types import ModuleType
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def column(name: str) -> Column:
    """A column by its plain name, also when the name holds dots or back quotes."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(df: DataFrame, *replaced: str) -> list[str]:
    """Columns of ``df`` but those an operator replaces; names are compared without case, as Spark does."""
    gone = {name.lower() for name in replaced}
    return [name for name in df.columns if name.lower() not in gone]


def packed(df: DataFrame, name: str = "row") -> Column:
    """The whole row as one struct, so that an operator's own columns can't clash with it."""
    return F.struct(*[column(c) for c in df.columns]).alias(name)


def unpacked(names: list[str], row: str = "row") -> list[Column]:
    """Fields of :func:`packed` as columns again."""
    return [F.col(row).getField(name).alias(name) for name in names]


def per_process(name: str, make: Callable[[], Any]) -> Any:
    """One value per Python worker process. Functions are sent by value and have globals of their own in every task, so the
    value is held by a module that only exists in the process."""
    held = sys.modules.setdefault("_sparkweft_held", ModuleType("_sparkweft_held")).__dict__
    if name not in held:
        held[name] = make()
    return held[name]
