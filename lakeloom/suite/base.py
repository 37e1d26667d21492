"""Registry of the queries and of the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.plans import marts, staging
from lakeloom.session import tune
from lakeloom.sources import bronze

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Raw, silver and gold frames over one data folder, all lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    @cache
    def given(self, name: str) -> DataFrame:
        return bronze.table(self.spark, self.sf_dir, name)

    @cache
    def raw(self, name: str) -> DataFrame:
        return getattr(bronze, f"raw_{name}")(self.spark, self.sf_dir)

    @cache
    def stg(self, name: str) -> DataFrame:
        return getattr(staging, f"stg_{name}")(self.raw(name))

    @cache
    def customer_orders(self) -> DataFrame:
        return marts.mart_customer_orders(
            self.stg("customers"), self.stg("orders"), self.stg("order_items")
        )


def comparable(df: DataFrame) -> DataFrame:
    """Types both engines print alike: decimals as doubles, dates as text."""
    columns = []
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        column = F.col(f"`{field.name}`")
        if kind == "decimal":
            column = column.cast("double")
        elif kind == "date":
            column = F.date_format(column, "yyyy-MM-dd")
        elif kind == "timestamp":
            column = column.cast("timestamp_ntz")
        elif kind in ("integer", "short", "byte"):
            column = column.cast("bigint")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], QueryFn]:
    """Register a query; ``sql`` is the same result in the checking engine."""

    def register(fn: Callable[[Tables], DataFrame]) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return comparable(fn(Tables(tune(spark), sf_dir)))

        run.__name__ = name
        run.area = fn.__module__.rsplit(".", 1)[1]
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return run

    return register
