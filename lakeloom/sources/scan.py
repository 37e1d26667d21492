"""Reading: projection, row filter, limit, layers and partition keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Partition key formats, finest first.
KEY_FORMATS = {"hour": "%Y-%m-%d-%H", "day": "%Y-%m-%d", "month": "%Y-%m", "year": "%Y"}


def scan(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    row_filter: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Filter, project and limit; the filter may use columns that are not projected."""
    if row_filter is not None:
        df = df.where(row_filter)
    if columns is not None:
        df = df.select(*columns)
    return df if limit is None else df.limit(limit)


def scan_glob(spark: SparkSession, pattern: str) -> DataFrame:
    return spark.read.parquet(pattern)


def key_range(key: str) -> tuple[datetime, datetime]:
    """First instant of a partition key and first instant after it."""
    for unit, pattern in KEY_FORMATS.items():
        try:
            start = datetime.strptime(key, pattern)
        except ValueError:
            continue
        if start.strftime(pattern) != key:
            continue
        if unit == "hour":
            return start, start + timedelta(hours=1)
        if unit == "day":
            return start, start + timedelta(days=1)
        if unit == "year":
            return start, start.replace(year=start.year + 1)
        later = start.replace(day=28) + timedelta(days=4)
        return start, later.replace(day=1)
    raise ValueError(f"{key!r} is not an hour, day, month or year key")


def in_partition(df: DataFrame, column: str, key: str, last_key: str | None = None) -> DataFrame:
    """Rows of one time partition, or of all from ``key`` to ``last_key``.

    One half-open range, so it reaches the file scan.
    """
    start, end = key_range(key)[0], key_range(last_key or key)[1]
    kind = df.schema[column].dataType
    low, high = F.lit(str(start)).cast(kind), F.lit(str(end)).cast(kind)
    return df.where((F.col(column) >= low) & (F.col(column) < high))


def load_input(
    df: DataFrame,
    metadata: Mapping[str, object],
    partition_key: str | None = None,
    partition_column: str | None = None,
) -> DataFrame:
    """Options from asset metadata, and the partition filter, all applied at once."""
    column = metadata.get("partition_column", partition_column)
    if partition_key and column:
        df = in_partition(df, str(column), partition_key)
    return scan(df, metadata.get("columns"), metadata.get("row_filter"), metadata.get("limit"))


def table_name(key: Sequence[str], default_namespace: str = "default") -> str:
    """Asset key to table name: namespace first, the remaining parts joined by ``_``."""
    if not key:
        raise ValueError("an asset key needs at least one part")
    if len(key) == 1:
        return f"{default_namespace}.{key[0]}"
    return f"{key[0]}.{'_'.join(key[1:])}"


def layer_path(layers: Mapping[str, str], layer: str, name: str) -> str:
    if layer not in layers:
        raise KeyError(f"unknown layer {layer!r}, known layers: {', '.join(sorted(layers))}")
    return f"{layers[layer].rstrip('/')}/{name}"
