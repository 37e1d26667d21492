"""Pseudo-random columns that depend only on a seed, a name and row ids.

The same ids give the same values for any number of partitions and after any
task retry.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(seed: int, name: str, *ids: Column | str) -> Column:
    """Uniform double in [0, 1): the first 52 bits of an MD5 of seed, name and ids. Other engines can draw the same."""
    parts = [(F.col(i) if isinstance(i, str) else i).cast("string") for i in ids]
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}|{name}"), *parts)), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(2**52))


def draw_int(low: int | Column, high: int | Column, u: Column) -> Column:
    """Uniform integer in [low, high], as bigint."""
    low, high = (F.lit(v) if isinstance(v, int) else v for v in (low, high))
    return F.floor(low + u * (high - low + 1)).cast("bigint")


def draw_cents(low: float, high: float, u: Column) -> Column:
    """Uniform amount in [low, high] with two decimals, as a double."""
    return draw_int(round(low * 100), round(high * 100), u) / F.lit(100.0)


def pick(values: Sequence[str], u: Column) -> Column:
    index = F.floor(u * len(values)).cast("int") + 1
    return F.element_at(F.array(*[F.lit(v) for v in values]), index)


def weighted(weights: Mapping[str, float], u: Column) -> Column:
    """A key drawn in proportion to its weight."""
    total, reached = float(sum(weights.values())), 0.0
    *head, last = weights
    chain = None
    for value in head:
        reached += weights[value]
        step = u < reached / total
        chain = F.when(step, value) if chain is None else chain.when(step, value)
    return F.lit(last) if chain is None else chain.otherwise(last)


def draw_time(start: datetime | Column, end: datetime | Column, u: Column) -> Column:
    """A whole second between two instants, without a time zone."""
    start, end = (
        F.lit(str(v)).cast("timestamp_ntz") if isinstance(v, datetime) else v for v in (start, end)
    )
    seconds = F.floor(u * (F.timestamp_diff("SECOND", start, end) + 1))
    return start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
