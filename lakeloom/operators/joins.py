"""Joining many rows to one row per key when some keys are very frequent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType, StringType


def fresh_key(column: Column, kind: DataType) -> Column:
    """The same value, computed in a way the optimizer does not see through."""
    if isinstance(kind, IntegralType):
        return F.bitwise_not(F.bitwise_not(column))
    return F.reverse(F.reverse(column)) if isinstance(kind, StringType) else column


def shuffled_again(dimension: DataFrame, key: str) -> DataFrame:
    """Let a join shuffle a frame that is already partitioned by its key.

    Deduplication leaves one row per key, partitioned by that key, and Spark
    would join the other side to it in place. Adaptive execution splits a hot
    key only between two fresh shuffles, so the smaller side gets one: a
    computed key hides the partitioning it has. A small side is still broadcast.
    """
    return dimension.withColumn(key, fresh_key(F.col(key), dimension.schema[key].dataType))
