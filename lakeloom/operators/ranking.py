"""Ranks over large groups, spread over many tasks.

A plain window puts a whole partition (all products, or one category) in one
task. Here rows are dealt by ranges of their order, numbered inside each range, and the
counts of earlier ranges are added. Ranks with ties are taken over counted values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.session import materialize


def with_chunks(
    df: DataFrame, source: DataFrame, column: str, chunks: int | None = None, least: int = 16
) -> DataFrame:
    """Add ``_chunk``: the number of cut points below the row's id.

    The cuts are quantiles of the ids in ``source``, so chunks are of about equal size, whether ids are dense or sparse.
    """
    chunks = max(2, chunks or max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    shares = F.array(*[F.lit(i / chunks) for i in range(1, chunks)])
    cuts = source.agg(F.percentile_approx(column, shares).alias("c")).scalar()
    rows = df.withColumn("_cuts", cuts)
    below = F.size(F.filter("_cuts", lambda c: c < F.col(column)))
    return rows.withColumn("_chunk", F.coalesce(below, F.lit(0))).drop("_cuts")


def sum_before(
    df: DataFrame, amount: str, out: str, order: Sequence[Column], within: Sequence[str] = (), ranges: int | None = None
) -> DataFrame:
    """Add the sum of ``amount`` over the rows before each one, in an order that leaves no ties.

    Rows are dealt once by ranges of (within, order), so a group of any size is spread over many tasks. A window runs inside each range, and what
    earlier ranges of the group hold comes from one row per group and range.
    """
    within = list(within)
    keys = [*[F.col(k) for k in within], *order]
    dealt = df.repartitionByRange(*([ranges] if ranges else []), *keys).withColumn("_range", F.spark_partition_id())
    dealt = materialize(dealt, "ranges")
    before = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*within, "_range").orderBy(*order).rowsBetween(*before)
    earlier = Window.partitionBy(*within).orderBy("_range").rowsBetween(*before)
    totals = dealt.groupBy(*within, "_range").agg(F.sum(amount).alias("_sum"))
    totals = totals.withColumn("_earlier", F.sum("_sum").over(earlier)).drop("_sum")
    names = {n: f"_k{i}" for i, n in enumerate([*within, "_range"])}
    match = [F.col(n).eqNullSafe(F.col(k)) for n, k in names.items()]
    rows = dealt.withColumn("_inside", F.sum(amount).over(inside)).join(totals.withColumnsRenamed(names), match)
    found = F.coalesce("_inside", F.lit(0)) + F.coalesce("_earlier", F.lit(0))
    return rows.select(*df.columns, found.alias(out))


def rank_desc(
    df: DataFrame, value: str, out: str, within: Sequence[str] = (), buckets: int | None = None
) -> DataFrame:
    """``rank() over (partition by within order by value desc)``, value not null."""
    return ranks_desc(df, value, {out: list(within)}, buckets)


def ranks_desc(df: DataFrame, value: str, ranks: Mapping[str, Sequence[str]], buckets: int | None = None) -> DataFrame:
    """Several ranks by one value, each inside its own columns (``name: columns``): values are counted once and joined once."""
    columns = list(dict.fromkeys(c for within in ranks.values() for c in within))
    counts = materialize(df.groupBy(*columns, value).agg(F.count("*").alias("_n")), "value-counts")
    found = counts.drop("_n")
    for out, within in ranks.items():
        coarse = counts if list(within) == columns else counts.groupBy(*within, value).agg(F.sum("_n").alias("_n"))
        above = sum_before(coarse, "_n", "_above", [F.desc(value)], within, buckets)
        above = above.select(*within, value, (F.col("_above") + 1).alias(out))
        found = _joined(found, above, [*within, value])
    return _joined(df, found, [*columns, value])


def _joined(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join one row per key; null keys are equal."""
    names = {k: f"_j{i}" for i, k in enumerate(keys)}
    match = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return df.join(other.withColumnsRenamed(names), match).drop(*names.values())


def row_number_desc(
    df: DataFrame,
    value: str,
    unique_id: str,
    out: str,
    within: Sequence[str] = (),
    buckets: int | None = None,
) -> DataFrame:
    """``row_number() over (partition by within order by value desc, unique_id)``."""
    numbered = sum_before(df.withColumn("_one", F.lit(1)), "_one", out, [F.desc(value), F.col(unique_id)], within, buckets)
    return numbered.withColumn(out, F.col(out) + 1).drop("_one")
