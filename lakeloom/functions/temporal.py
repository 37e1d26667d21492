"""Activity factors by hour, weekday and month."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

PEAK_HOURS = (10, 14, 18, 21)


def daily_factor(hour: Column, peaks: Sequence[int] = PEAK_HOURS) -> Column:
    """Low at night, rising in the morning, one at the peak hours."""
    return (
        F.when(hour < 6, 0.1)
        .when(hour < 9, 0.5 + (hour - 6) * 0.15)
        .when(hour.isin(*peaks), 1.0)
        .when(hour < 18, 0.7)
        .when(hour < 22, 0.8)
        .otherwise(0.3)
    )


def weekly_factor(weekday: Column, weekend: float = 0.3) -> Column:
    """``weekday`` counts from Monday, which is 0."""
    return (
        F.when(weekday >= 5, weekend).when(weekday == 0, 0.9).when(weekday == 4, 0.85).otherwise(1.0)
    )


def trend_factor(day: Column, monthly: float, base: date = date(2024, 1, 1)) -> Column:
    months = (F.year(day) - base.year) * 12 + (F.month(day) - base.month)
    return F.lit(1.0) + F.lit(monthly) * months


def adjusted_count(base_count: int, factor: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.lit(base_count) * factor).cast("int"))
