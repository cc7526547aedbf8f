"""Numbers and times as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration_text(seconds: Column) -> Column:
    """Seconds as ``s.ss 秒``, ``m 分 s.ss 秒`` or ``h 小时 m 分 s.ss 秒``."""
    value = seconds.cast("double")
    hours = F.floor(value / 3600)
    minutes = F.floor(F.pmod(value, F.lit(3600.0)) / 60)
    rest = F.pmod(value, F.lit(60.0))
    return (
        F.when(value < 60, F.format_string("%.2f 秒", value))
        .when(value < 3600, F.format_string("%d 分 %.2f 秒", minutes, rest))
        .otherwise(F.format_string("%d 小时 %d 分 %.2f 秒", hours, minutes, rest))
    )


def fixed_text(number: Column, digits: int = 2) -> Column:
    """Number with a fixed count of decimals, rounded half up."""
    return F.format_string(f"%.{digits}f", number.cast("double"))


def signed_percent(number: Column, digits: int = 2) -> Column:
    """``+1.50%`` / ``-1.50%``."""
    return F.format_string(f"%+.{digits}f%%", number.cast("double"))


def grouped_text(number: Column) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(number, 0)


def stamp_text(ts: Column) -> Column:
    """``yyyyMMdd_HHmmss``."""
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def zoned_minute_text(utc: Column, zone: str = "Asia/Shanghai") -> Column:
    """``yyyy-MM-dd HH:mm`` of a UTC time in a fixed zone."""
    return F.date_format(F.from_utc_timestamp(utc, zone), "yyyy-MM-dd HH:mm")


def rate(amount: Column, seconds: Column) -> Column:
    """Amount per second, zero when no time passed."""
    return F.when(seconds > 0, amount / seconds).otherwise(F.lit(0.0))
