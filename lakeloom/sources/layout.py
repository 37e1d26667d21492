"""Partition columns derived from data columns, and schema alignment."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegerType,
    IntegralType,
    LongType,
    ShortType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
    TimestampType,
)

# Text form of a time partition; text order is time order.
TIME_FORMATS = {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd", "hour": "yyyy-MM-dd-HH"}


@dataclass(frozen=True)
class PartitionField:
    """One partition column: identity, year, month, day, hour, bucket or truncate."""

    column: str
    transform: str = "identity"
    param: int | None = None

    def __post_init__(self) -> None:
        if self.transform not in {"identity", "bucket", "truncate", *TIME_FORMATS}:
            raise ValueError(f"unknown partition transform {self.transform!r}")
        if self.transform in {"bucket", "truncate"} and (self.param is None or self.param < 1):
            raise ValueError(f"{self.transform} needs a positive parameter")

    @property
    def name(self) -> str:
        return f"_p_{self.column}_{self.transform}"

    def value(self, kind: DataType) -> Column:
        """Folder text of a row; null and empty share a folder and stay distinct in the data."""
        return F.coalesce(F.nullif(self._text(kind), F.lit("")), F.lit("null"))

    def holds(self, operator: str, literal: str, kind: DataType) -> Column | None:
        """Folders that may hold rows whose column compares so with a literal; none if the layout tells nothing of it."""
        value, folder = F.expr(literal).cast(kind), F.col(self.name)
        if self.transform in TIME_FORMATS:
            if not isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
                return None
            return _compare(folder, operator, self._text(kind, value))
        if operator == "=" and self.transform in {"identity", "bucket"}:
            return folder == F.coalesce(F.nullif(self._text(kind, value), F.lit("")), F.lit("null"))
        if self.transform == "truncate" and isinstance(kind, StringType):
            # Empty texts share the folder of nulls.
            return _compare(folder, operator, self._text(kind, value)) | (folder == "null")
        if self.transform == "truncate" and isinstance(kind, IntegralType) and re.fullmatch(r"-?\d+", literal):
            return _compare(folder.try_cast("bigint"), operator, self._text(kind, value).try_cast("bigint"))
        return None

    def _text(self, kind: DataType, column: Column | None = None) -> Column:
        column = F.col(self.column) if column is None else column
        if self.transform in TIME_FORMATS:
            return F.date_format(column, TIME_FORMATS[self.transform])
        if self.transform == "bucket":
            digits = F.substring(F.md5(column.cast("string")), 1, 13)
            return F.pmod(F.conv(digits, 16, 10).cast("bigint"), F.lit(self.param)).cast("string")
        if self.transform == "truncate":
            if isinstance(kind, StringType):
                return F.substring(column, 1, self.param)
            return (column - F.pmod(column, F.lit(self.param).cast(kind))).cast("string")
        return column.cast("string")


def _compare(folder: Column, operator: str, cut: Column) -> Column:
    """A cut value keeps the order, so rows on one side of a value lie in folders on that side of its cut or in it."""
    if operator == "=":
        return folder == cut
    return folder >= cut if operator in {">", ">="} else folder <= cut


_LITERAL = r"(?:(?:date|timestamp|timestamp_ntz)\s*)?'[^'\\]*'|-?\d+"
_CONDITION = rf"([A-Za-z_]\w*)\s*(<=|>=|=|<|>)\s*({_LITERAL})"


def comparisons(row_filter: str) -> list[tuple[str, str, str]]:
    """Column, operator and literal of a filter that is nothing but comparisons joined by ``and``; else none."""
    if not re.fullmatch(rf"\s*{_CONDITION}(?:\s+and\s+{_CONDITION})*\s*", row_filter, re.IGNORECASE):
        return []
    return re.findall(rf"{_CONDITION}(?:\s+and\s+|\s*$)", row_filter, re.IGNORECASE)


def folders_for(row_filter: str, fields: Sequence[PartitionField], schema: StructType) -> list[Column]:
    """Conditions on the folder columns that every row of a filter meets. The filter itself still has to be applied."""
    found = []
    for column, operator, literal in comparisons(row_filter):
        for field in fields:
            if field.column.lower() == column.lower():
                kind = schema[field.column].dataType
                found.append(field.holds(operator, literal, kind))
    return [f for f in found if f is not None]


def with_partitions(df: DataFrame, fields: Sequence[PartitionField]) -> DataFrame:
    return df.withColumns({f.name: f.value(df.schema[f.column].dataType) for f in fields})


def default_partitioning(df: DataFrame, column: str | None) -> list[PartitionField]:
    """Day partitions on the configured column, where the table has it."""
    return [PartitionField(column, "day")] if column and column in df.columns else []


def wider(old: DataType, new: DataType) -> DataType:
    """The type that holds both; only lossless widening is accepted."""
    if old == new:
        return old
    for chain in ((ShortType(), IntegerType(), LongType()), (FloatType(), DoubleType())):
        if old in chain and new in chain:
            return chain[max(chain.index(old), chain.index(new))]
    if isinstance(old, DecimalType) and isinstance(new, DecimalType) and old.scale == new.scale:
        return DecimalType(max(old.precision, new.precision), old.scale)
    raise TypeError(f"cannot widen {old.simpleString()} to {new.simpleString()}")


def merged_schema(old: StructType, new: StructType) -> StructType:
    """Old columns in order, widened where needed, then the added ones."""
    by_name = {f.name: f for f in new.fields}
    fields = [
        StructField(f.name, wider(f.dataType, by_name[f.name].dataType), True)
        if f.name in by_name
        else StructField(f.name, f.dataType, True)
        for f in old.fields
    ]
    known = set(old.fieldNames())
    added = [StructField(f.name, f.dataType, True) for f in new.fields if f.name not in known]
    return StructType(fields + added)


def align(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns in schema order and type, null where the frame lacks one."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def union_evolved(old: DataFrame, new: DataFrame) -> DataFrame:
    """Append with added columns and widened types."""
    schema = merged_schema(old.schema, new.schema)
    return align(old, schema).unionByName(align(new, schema))


def partition_counts(df: DataFrame, fields: Sequence[PartitionField]) -> DataFrame:
    names = [f.name for f in fields]
    return with_partitions(df, fields).groupBy(*names).agg(F.count("*").alias("n_rows"))
