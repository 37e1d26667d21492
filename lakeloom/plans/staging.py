"""Silver models: one cleaned, typed row per entity key."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions.clean import canonical_status, category_label, dedupe_latest, money, normalize, require


def stg_customers(raw: DataFrame) -> DataFrame:
    rows = require(raw, "customer_id", "email", "name").select(
        "customer_id", "name", "email", "region", "created_at"
    )
    return dedupe_latest(rows, ["customer_id"], "created_at").withColumn("email", normalize("email"))


def stg_orders(raw: DataFrame) -> DataFrame:
    rows = require(raw, "order_id", "customer_id").where("total_amount >= 0").select(
        "order_id", "customer_id", "status", "region", "total_amount", "created_at"
    )
    return dedupe_latest(rows, ["order_id"], "created_at").select(
        "order_id",
        "customer_id",
        canonical_status("status").alias("status"),
        "region",
        money("total_amount").alias("total_amount"),
        "created_at",
    )


def stg_products(raw: DataFrame) -> DataFrame:
    rows = require(raw, "product_id", "name").where("price >= 0").select(
        "product_id", "name", "category", "price", "created_at"
    )
    return dedupe_latest(rows, ["product_id"], "created_at").select(
        "product_id",
        F.trim("name").alias("name"),
        category_label("category").alias("category"),
        money("price").alias("price"),
        "created_at",
    )


def stg_order_items(raw: DataFrame) -> DataFrame:
    rows = (
        require(raw, "order_item_id", "order_id", "product_id")
        .where("quantity > 0 and price >= 0")
        .select("order_item_id", "order_id", "product_id", "quantity", "price", "created_at")
    )
    price = money("price")
    return dedupe_latest(rows, ["order_item_id"], "created_at").select(
        "order_item_id",
        "order_id",
        "product_id",
        F.col("quantity").cast("int").alias("quantity"),
        price.alias("price"),
        money(F.col("quantity").cast("int") * price).alias("line_total"),
        "created_at",
    )


def events_cleaned(raw: DataFrame) -> DataFrame:
    return raw.where(F.col("event_type").isNotNull())


def create_views(spark: SparkSession, models: Mapping[str, DataFrame], prefix: str = "stg_") -> dict[str, str]:
    """Register cleaned tables as temporary views; nothing is computed until one is read. Returns the views' names."""
    names = {model: f"{prefix}{model}" for model in models}
    for model, frame in models.items():
        frame.createOrReplaceTempView(names[model])
    return names
