"""Adapters: the given star-schema tables seen as raw e-commerce entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Raw spellings per order status letter, chosen by order key modulo 4.
STATUS_SPELLINGS = {
    "F": ["completed", " Complete ", "COMPLETED", "completed"],
    "O": ["pending", "Processing", "PENDING ", "pending"],
    "P": ["cancelled", "Canceled", "error", "on_hold"],
}

# Raw product category per part type.
CATEGORY_BY_TYPE = {
    "STANDARD": "electronics",
    "ECONOMY": "Clothing",
    "MEDIUM": " home",
    "PROMO": "SPORTS",
    "LARGE": "books ",
    "SMALL": "garden",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, with the columns its files have now."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(selector: Column, options: dict[str, Column]) -> Column:
    chain = F.lit(None).cast("string")
    for value, result in reversed(options.items()):
        chain = F.when(selector == value, result).otherwise(chain)
    return chain


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left"
    )
    return (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("name"),
            F.concat(
                F.lit(" "),
                F.upper(F.regexp_replace("c_name", "#", ".")),
                F.lit("@Example.com "),
            ).alias("email"),
            F.col("r_name").alias("region"),
            F.expr(
                "timestamp_ntz'1994-01-01 00:00:00' + make_dt_interval(cast(c_custkey % 365 as int))"
            ).alias("created_at"),
        )
    )


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order; one whose customer is not known has no region."""
    region = raw_customers(spark, sf_dir).select("customer_id", "region")
    spelled = {
        letter: F.element_at(
            F.array(*[F.lit(s) for s in words]), (F.col("o_orderkey") % 4 + 1).cast("int")
        )
        for letter, words in STATUS_SPELLINGS.items()
    }
    return (
        table(spark, sf_dir, "orders")
        .join(region, F.col("o_custkey") == F.col("customer_id"), "left")
        .select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            _pick(F.col("o_orderstatus"), spelled).alias("status"),
            "region",
            F.col("o_totalprice").alias("total_amount"),
            F.col("o_orderdate").alias("created_at"),
        )
    )


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = {kind: F.lit(name) for kind, name in CATEGORY_BY_TYPE.items()}
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.concat(F.lit(" "), "p_name").alias("name"),
        _pick(F.col("p_type"), category).alias("category"),
        F.col("p_retailprice").alias("price"),
        F.expr("timestamp_ntz'1994-01-01 00:00:00'").alias("created_at"),
    )


def raw_order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit price is worked out in whole cents, so engines cannot round it apart."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("order_item_id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        (
            F.expr("cast(round(l_extendedprice * 100) as bigint) div nullif(cast(l_quantity as bigint), 0)")
            / F.lit(100.0)
        ).alias("price"),
        F.col("l_shipdate").alias("created_at"),
    )


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        "event_type",
        F.col("props").alias("properties"),
        F.col("ts").alias("timestamp"),
        "value",
    )
