"""Known defects put into clean data, at given rates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lakeloom.functions.draws import draw, draw_int


@dataclass(frozen=True)
class Defects:
    null_rate: float = 0.0
    null_columns: tuple[str, ...] = ()
    duplicate_rate: float = 0.0
    late_rate: float = 0.0
    late_hours: tuple[int, int] = (24, 168)
    timestamp_column: str = "created_at"

    def __post_init__(self) -> None:
        for rate in (self.null_rate, self.duplicate_rate, self.late_rate):
            if not 0.0 <= rate <= 1.0:
                raise ValueError(f"rate {rate} is not between 0 and 1")
        if not 1 <= self.late_hours[0] <= self.late_hours[1]:
            raise ValueError(f"bad hour range {self.late_hours}")


def inject_nulls(df: DataFrame, keys: Sequence[str], defects: Defects, seed: int = 42) -> DataFrame:
    """Null out cells of the named columns, or of every text column but the keys."""
    columns = defects.null_columns or [
        f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name not in keys
    ]
    if defects.null_rate == 0:
        return df
    return df.withColumns(
        {
            c: F.when(draw(seed, f"null.{c}", *keys) >= defects.null_rate, F.col(c))
            for c in columns
        }
    )


def inject_duplicates(
    df: DataFrame, keys: Sequence[str], defects: Defects, seed: int = 42
) -> DataFrame:
    if defects.duplicate_rate == 0:
        return df
    twice = draw(seed, "duplicate", *keys) < defects.duplicate_rate
    copies = F.explode(F.sequence(F.lit(1), F.when(twice, 2).otherwise(1)))
    return df.withColumn("_copy", copies).drop("_copy")


def inject_late(df: DataFrame, keys: Sequence[str], defects: Defects, seed: int = 42) -> DataFrame:
    """Move some timestamps back; nulls stay null, a missing column changes nothing."""
    column = defects.timestamp_column
    if defects.late_rate == 0 or column not in df.columns:
        return df
    late = draw(seed, "late", *keys) < defects.late_rate
    hours = draw_int(*defects.late_hours, draw(seed, "late.hours", *keys)).cast("int")
    moved = F.col(column) - F.make_dt_interval(F.lit(0), hours)
    return df.withColumn(column, F.when(late, moved).otherwise(F.col(column)))


def inject(df: DataFrame, keys: Sequence[str], defects: Defects, seed: int = 42) -> DataFrame:
    """Nulls, then duplicates, then late rows."""
    for step in (inject_nulls, inject_duplicates, inject_late):
        df = step(df, keys, defects, seed)
    return df
