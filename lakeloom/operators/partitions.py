"""Partition keys as data: keys, selection, missing ones and backfill batches."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from importlib import import_module
from threading import Event

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators.joins import shuffled_again
from lakeloom.sources.datasets import Dataset

STEPS = {
    "hour": ("interval 1 hour", "yyyy-MM-dd-HH"),
    "day": ("interval 1 day", "yyyy-MM-dd"),
    "week": ("interval 7 days", "yyyy-MM-dd"),
    "month": ("interval 1 month", "yyyy-MM"),
}


def time_keys(
    bounds: DataFrame, start: Column, end: Column, frequency: str, fmt: str | None = None
) -> DataFrame:
    """One key per step from ``start`` up to, not including, ``end``.

    ``bounds`` is a one-row frame. ``index`` numbers the keys from zero, so
    batches need no window.
    """
    if frequency not in STEPS:
        raise ValueError(f"unknown frequency {frequency!r}, known: {', '.join(STEPS)}")
    step, default_fmt = STEPS[frequency]
    first = F.date_trunc(frequency, start)
    steps = F.sequence(first, F.greatest(first, end.cast("timestamp")), F.expr(step))
    rows = bounds.select(end.cast("timestamp").alias("_end"), F.posexplode(steps).alias("index", "at"))
    return rows.where("at < _end").select(
        F.date_format("at", fmt or default_fmt).alias("partition_key"),
        F.col("index").cast("bigint").alias("index"),
    )


def time_keys_of(df: DataFrame, column: str, frequency: str, fmt: str | None = None) -> DataFrame:
    """Keys that cover a column from its first to its last value."""
    bounds = df.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    after = F.col("high").cast("timestamp") + F.expr("interval 1 microsecond")
    return time_keys(bounds, F.col("low"), after, frequency, fmt)


def static_keys(spark: SparkSession, keys: Sequence[str]) -> DataFrame:
    if not keys or len(set(keys)) != len(keys):
        raise ValueError("static partition keys must be given and be unique")
    return spark.createDataFrame([(k,) for k in keys], "partition_key string")


def multi_keys(keys: DataFrame, dimensions: Mapping[str, Sequence[str]]) -> DataFrame:
    """Product of a key frame and fixed key lists, joined as ``a|b``."""
    rows = keys.select("partition_key")
    for name, values in dimensions.items():
        if not values or len(set(values)) != len(values):
            raise ValueError(f"keys of {name} must be given and be unique")
        rows = rows.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return rows.withColumn("partition_key", F.concat_ws("|", "partition_key", *dimensions))


def dynamic_keys(df: DataFrame, column: str) -> DataFrame:
    return (
        df.where(F.col(column).isNotNull())
        .select(F.col(column).cast("string").alias("partition_key"))
        .distinct()
    )


def keys_from(spark: SparkSession, fn: Callable[..., Sequence[str]] | str, **arguments) -> DataFrame:
    """Keys a user function returns at run time; it may be named as ``module.function``."""
    if isinstance(fn, str):
        module, _, name = fn.rpartition(".")
        fn = getattr(import_module(module), name)
    return static_keys(spark, list(fn(**arguments)))


def select_keys(keys: DataFrame, selector: str) -> DataFrame:
    if selector == "all":
        return keys.select("partition_key")
    if selector == "latest":
        return keys.agg(F.max("partition_key").alias("partition_key"))
    raise ValueError(f"unknown selector {selector!r}")


def backfill_plan(keys: DataFrame, start: str, end: str, batch_size: int = 10) -> DataFrame:
    """Keys from ``start`` to ``end``, both included, in batches of consecutive keys."""
    if end < start:
        raise ValueError("the range ends before it starts")
    if batch_size < 1:
        raise ValueError("a batch holds at least one key")
    chosen = keys.where(F.col("partition_key").between(start, end))
    first = chosen.agg(F.min("index")).scalar()
    return chosen.withColumn(
        "batch", F.floor((F.col("index") - first) / batch_size).cast("bigint")
    ).select("partition_key", "batch")


def run_backfill(plan: DataFrame, fn: Callable[[list[str]], None], done: Dataset | None = None, together: int = 1) -> int:
    """Call ``fn`` with the keys of each batch, in order; returns the batches run.

    ``done`` keeps the keys of finished batches: a backfill that broke is run again with the batches that are left. Up to ``together``
    batches run at a time, each in a scheduler pool of its own; if one breaks, those that run are finished and no more are started.
    """
    if done is not None and done.exists():
        plan = plan.join(shuffled_again(done.scan().select("partition_key").distinct(), "partition_key"), "partition_key", "left_anti")
    batches = (
        plan.groupBy("batch")
        .agg(F.sort_array(F.collect_list("partition_key")).alias("keys"))
        .orderBy("batch")
        .collect()  # key names only, never data
    )
    spark, stopped = plan.sparkSession, Event()

    def run(row) -> bool:
        if stopped.is_set():
            return False
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"backfill-{row['batch']}")
        try:
            fn(list(row["keys"]))
            if done is not None:
                finished = spark.createDataFrame([(k, row["batch"]) for k in row["keys"]], "partition_key string, batch bigint")
                done.append(finished, batch=f"backfill-{row['keys'][0]}-{row['keys'][-1]}")
        except BaseException:
            stopped.set()
            raise
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
        return True

    if together < 2:
        return sum(run(row) for row in batches)
    with ThreadPoolExecutor(together) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(run), row) for row in batches]
    return sum(s.result() for s in started)


def missing_keys(keys: DataFrame, df: DataFrame, key: Column) -> DataFrame:
    """Keys without a single row."""
    present = df.select(key.alias("partition_key")).distinct()
    return keys.select("partition_key").join(present, "partition_key", "left_anti")
