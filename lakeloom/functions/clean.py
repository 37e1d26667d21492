"""Cleaning expressions shared by the staging models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Accepted spellings of each order status.
STATUS_SYNONYMS = {
    "completed": ["completed", "complete"],
    "pending": ["pending", "processing"],
    "cancelled": ["cancelled", "canceled"],
    "failed": ["failed", "error"],
}

# Display label of each product category.
CATEGORY_LABELS = {
    "electronics": "Electronics",
    "clothing": "Clothing",
    "home": "Home & Garden",
    "sports": "Sports & Outdoors",
    "books": "Books",
}

# Fixed value: accepted shape of an email address.
EMAIL_PATTERN = r"^[\w.\-+]+@[\w.\-]+\.\w+$"


def normalize(col: Column | str) -> Column:
    return F.lower(F.trim(col))


def fold(col: Column | str, synonyms: Mapping[str, Sequence[str]], default: str) -> Column:
    """Replace every known spelling by its canonical value."""
    value = normalize(col)
    result = F.lit(default)
    for canonical, spellings in synonyms.items():
        result = F.when(value.isin(*spellings), F.lit(canonical)).otherwise(result)
    return result


def canonical_status(col: Column | str) -> Column:
    return fold(col, STATUS_SYNONYMS, "unknown")


def category_label(col: Column | str) -> Column:
    return fold(col, {label: [raw] for raw, label in CATEGORY_LABELS.items()}, "Other")


def money(col: Column | str) -> Column:
    """An amount in cents; one too large to be held is null and does not end the job."""
    return (F.col(col) if isinstance(col, str) else col).try_cast("decimal(10,2)")


def is_email(col: Column | str) -> Column:
    return F.col(col).rlike(EMAIL_PATTERN) if isinstance(col, str) else col.rlike(EMAIL_PATTERN)


def require(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropna(subset=list(columns))


def dedupe_latest(df: DataFrame, keys: Sequence[str], newest: str) -> DataFrame:
    """One row per key, the newest; ties fall to the largest remaining values.

    Spark turns ``row_number() = 1`` into a group limit on the map side, so a
    key that holds a large part of the table reaches the shuffle as one row
    per input partition.
    """
    rest = [c for c in df.columns if c not in keys and c != newest]
    order = [F.col(c).desc_nulls_last() for c in [newest, *rest]]
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rn = 1").drop("_rn")


def mismatch(declared: Column, computed: Column, tolerance: str = "0.01") -> Column:
    """True when two amounts differ by more than the tolerance."""
    return F.abs(declared - F.coalesce(computed, F.lit(0))) > F.lit(tolerance).cast("decimal(10,2)")
