"""Gold models built from the silver ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.clean import mismatch
from lakeloom.operators.joins import shuffled_again
from lakeloom.operators.ranking import ranks_desc, row_number_desc
from lakeloom.session import materialize

# Our own cut points; no published model fixes them.
SEGMENT_RULES = {"vip_revenue": 1_500_000, "loyal_orders": 8, "active_days": 365}
CHURN_DAYS = {"low": 180, "medium": 540}
TIER_RATIOS = {"top_performer": 1.5, "good_performer": 1.1, "average": 0.7}


def ratio(total: Column | str, count: Column | str) -> Column:
    """Mean of an exact total, as a double."""
    total = F.col(total) if isinstance(total, str) else total
    count = F.col(count) if isinstance(count, str) else count
    return total.cast("double") / F.nullif(count, F.lit(0)).cast("double")


# --- customer orders -------------------------------------------------------


def order_aggregates(items: DataFrame) -> DataFrame:
    return items.groupBy("order_id").agg(
        F.count_distinct("product_id").alias("product_count"),
        F.sum("quantity").alias("total_items"),
        F.sum("line_total").alias("calculated_total"),
    )


def join_order_totals(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Orders with their item totals, zero where an order has no items."""
    totals = order_aggregates(items)
    return orders.join(totals, "order_id", "left").select(
        *orders.columns,
        F.coalesce("product_count", F.lit(0)).alias("products_in_order"),
        F.coalesce("total_items", F.lit(0)).alias("items_in_order"),
        F.coalesce("calculated_total", F.lit(0)).alias("calculated_order_total"),
    )


def _people(customers: DataFrame) -> DataFrame:
    return shuffled_again(customers, "customer_id").select(
        "customer_id",
        F.col("name").alias("customer_name"),
        F.col("email").alias("customer_email"),
        F.col("region").alias("customer_region"),
    )


def join_customer_orders(customers: DataFrame, orders: DataFrame) -> DataFrame:
    return (
        _people(customers)
        .join(orders, "customer_id")
        .select(
            "customer_id",
            "customer_name",
            "customer_email",
            "customer_region",
            "order_id",
            F.col("status").alias("order_status"),
            F.col("region").alias("order_region"),
            F.col("created_at").alias("order_date"),
            F.col("total_amount").alias("order_total"),
        )
    )


def flag_amount_mismatch(order_totals: DataFrame) -> DataFrame:
    return order_totals.withColumn(
        "has_amount_mismatch", mismatch(F.col("total_amount"), F.col("calculated_order_total"))
    )


def mart_customer_orders(customers: DataFrame, orders: DataFrame, items: DataFrame) -> DataFrame:
    flagged = flag_amount_mismatch(join_order_totals(orders, items)).select(
        "order_id",
        "products_in_order",
        "items_in_order",
        "calculated_order_total",
        "has_amount_mismatch",
        "customer_id",
        "status",
        "region",
        "created_at",
        "total_amount",
    )
    extra = ["products_in_order", "items_in_order", "calculated_order_total", "has_amount_mismatch"]
    return _people(customers).join(flagged, "customer_id").select(
        "customer_id",
        "customer_name",
        "customer_email",
        "customer_region",
        "order_id",
        F.col("status").alias("order_status"),
        F.col("region").alias("order_region"),
        F.col("created_at").alias("order_date"),
        F.col("total_amount").alias("order_total"),
        *extra,
    )


# --- revenue ---------------------------------------------------------------


def daily_revenue(customer_orders: DataFrame) -> DataFrame:
    """Daily grain. Order ids are unique in the input, so counting rows counts orders."""
    return (
        customer_orders.groupBy(
            F.to_date("order_date").alias("revenue_date"),
            F.col("order_region").alias("region"),
            F.col("order_status").alias("status"),
        )
        .agg(
            F.count("order_id").alias("order_count"),
            F.count_distinct("customer_id").alias("customer_count"),
            F.sum("order_total").alias("total_revenue"),
            F.sum("items_in_order").alias("total_items_sold"),
            F.sum("products_in_order").alias("total_products_sold"),
        )
        .select(
            "revenue_date",
            "region",
            "status",
            "order_count",
            "customer_count",
            "total_revenue",
            ratio("total_revenue", "order_count").alias("avg_order_value"),
            "total_items_sold",
            "total_products_sold",
        )
    )


def cumulative_revenue(daily: DataFrame) -> DataFrame:
    """Running sum per region; the input holds one row per day and status."""
    running = (
        Window.partitionBy("region")
        .orderBy("revenue_date", "status")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return daily.withColumn("cumulative_revenue_by_region", F.sum("total_revenue").over(running))


def revenue_7_rows_ago(daily: DataFrame) -> DataFrame:
    weekly = Window.partitionBy("region", "status").orderBy("revenue_date")
    return daily.withColumn("revenue_7d_ago", F.lag("total_revenue", 7).over(weekly))


def revenue_7_days_ago(daily: DataFrame) -> DataFrame:
    """Calendar variant: the value exactly seven days earlier, null if that day is missing."""
    earlier = daily.select(
        F.date_add("revenue_date", 7).alias("revenue_date"),
        "region",
        "status",
        F.col("total_revenue").alias("revenue_7d_ago"),
    )
    return daily.join(earlier, ["revenue_date", "region", "status"], "left")


def week_growth(with_previous: DataFrame) -> DataFrame:
    now = F.col("total_revenue").cast("double")
    previous = F.col("revenue_7d_ago").cast("double")
    return with_previous.withColumn(
        "wow_growth_pct",
        F.when(F.col("revenue_7d_ago") > 0, (now - previous) / previous * 100),
    )


def mart_revenue(customer_orders: DataFrame) -> DataFrame:
    return week_growth(revenue_7_rows_ago(cumulative_revenue(daily_revenue(customer_orders))))


# --- products --------------------------------------------------------------


def product_sales(products: DataFrame, items: DataFrame, orders: DataFrame) -> DataFrame:
    return (
        items.select(
            "order_id", "product_id", "quantity", F.col("price").alias("sold_price"), "line_total"
        )
        .join(
            shuffled_again(orders, "order_id").select(
                "order_id",
                F.col("status").alias("order_status"),
                F.col("created_at").alias("sale_date"),
            ),
            "order_id",
        )
        .join(
            shuffled_again(products, "product_id").select(
                "product_id",
                F.col("name").alias("product_name"),
                "category",
                F.col("price").alias("list_price"),
            ),
            "product_id",
        )
    )


def product_metrics(sales: DataFrame) -> DataFrame:
    """Product totals.

    The first line of every product and order is marked, so distinct orders are counts of marks: no row is
    expanded per distinct column, and no table of products and orders is held, only a sort that can spill.
    Names are joined back later, so they never travel with the order lines.
    """
    zero = F.lit(0).cast("decimal(10,2)")
    below_list = F.when(
        F.col("sold_price") < F.col("list_price"), F.col("list_price") - F.col("sold_price")
    ).otherwise(zero)
    keys = ["product_id", "list_price"]
    same_order = Window.partitionBy(*keys, "order_id", "order_status", "sale_date").orderBy("order_id")
    lines = sales.select(
        *keys, "order_id", "order_status", "sale_date", "quantity", "line_total", "sold_price"
    ).withColumn("_first", F.row_number().over(same_order) == 1)
    completed = F.col("order_status") == "completed"
    revenue = F.col("line_total").cast("decimal(20,2)")
    return (
        lines.groupBy(*keys)
        .agg(
            F.count_if("_first").alias("orders_with_product"),
            F.sum("quantity").alias("total_units_sold"),
            F.sum(revenue).alias("total_revenue"),
            F.sum("sold_price").alias("price_sum"),
            F.count("*").alias("n_lines"),
            F.count_if(completed & F.col("_first")).alias("completed_orders"),
            F.sum(F.when(completed, revenue).otherwise(F.lit(0))).alias("completed_revenue"),
            F.min("sold_price").alias("min_sold_price"),
            F.max("sold_price").alias("max_sold_price"),
            F.sum(below_list).alias("discount_sum"),
            F.min("sale_date").alias("first_sale_date"),
            F.max("sale_date").alias("last_sale_date"),
        )
        .select(
            *keys,
            "orders_with_product",
            "total_units_sold",
            "total_revenue",
            ratio("price_sum", "n_lines").alias("avg_selling_price"),
            "completed_orders",
            "completed_revenue",
            "min_sold_price",
            "max_sold_price",
            ratio("discount_sum", "n_lines").alias("avg_discount"),
            "first_sale_date",
            "last_sale_date",
        )
    )


def rank_in_category(metrics: DataFrame) -> DataFrame:
    """Position by revenue inside a category, ties by product id."""
    return row_number_desc(metrics, "total_revenue", "product_id", "revenue_rank_in_category", ["category"])


def mart_product_performance(
    products: DataFrame, items: DataFrame, orders: DataFrame
) -> DataFrame:
    metrics = product_metrics(product_sales(products, items, orders))
    names = products.select("product_id", F.col("name").alias("product_name"), "category")
    return rank_in_category(names.join(metrics, "product_id"))


# --- documented models -----------------------------------------------------


def dim_customers(customers: DataFrame) -> DataFrame:
    """Full name from first and last part, joined by a blank."""
    parts = F.split("name", "#")
    return customers.select(
        "customer_id",
        F.concat(F.element_at(parts, 1), F.lit(" "), F.element_at(parts, 2)).alias("full_name"),
        "email",
        "region",
    )


def fact_orders(orders: DataFrame, dim: DataFrame) -> DataFrame:
    names = shuffled_again(dim.select("customer_id", "full_name"), "customer_id")
    return orders.join(names, "customer_id").select(
        "order_id", "customer_id", "full_name", "status", "total_amount", "created_at"
    )


def inherit_region(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Order region taken from the customer, as an explicit lookup."""
    parent = shuffled_again(customers, "customer_id").select(
        "customer_id", F.col("region").alias("customer_region")
    )
    return (
        orders.join(parent, "customer_id", "left")
        .withColumn("region", F.coalesce("customer_region", "region"))
        .select(*orders.columns)
    )


def order_items_enriched(items: DataFrame, products: DataFrame) -> DataFrame:
    details = shuffled_again(products, "product_id").select(
        "product_id",
        F.col("name").alias("product_name"),
        "category",
        F.col("price").alias("list_price"),
    )
    return items.join(details, "product_id").select(*items.columns, *details.columns[1:])


def customer_orders_metrics(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Per-customer totals. Orders shrink to one row per customer before the join."""
    per_customer = orders.groupBy("customer_id").agg(
        F.count("*").alias("n"),
        F.sum("total_amount").alias("revenue"),
        F.min("created_at").alias("first_order_date"),
        F.max("created_at").alias("last_order_date"),
    )
    return customers.join(per_customer, "customer_id", "left").select(
        "customer_id",
        F.col("name").alias("customer_name"),
        "email",
        "region",
        F.col("created_at").alias("customer_created_at"),
        F.coalesce("n", F.lit(0)).alias("total_orders"),
        F.coalesce("revenue", F.lit(0)).alias("total_revenue"),
        "first_order_date",
        "last_order_date",
    )


def customer_order_summary(customers: DataFrame, orders: DataFrame) -> DataFrame:
    return customer_orders_metrics(customers, orders).select(
        "customer_id", "customer_name", "total_orders", "total_revenue"
    )


def mart_customer_segments(customers: DataFrame, orders: DataFrame, as_of: Column) -> DataFrame:
    metrics = customer_orders_metrics(customers, orders)
    days = F.datediff(as_of, F.col("last_order_date"))
    segment = (
        F.when(F.col("total_orders") == 0, "never_ordered")
        .when(F.col("total_revenue") >= SEGMENT_RULES["vip_revenue"], "vip")
        .when(F.col("total_orders") >= SEGMENT_RULES["loyal_orders"], "loyal")
        .when(days <= SEGMENT_RULES["active_days"], "active")
        .otherwise("new")
    )
    risk = (
        F.when(days.isNull(), "unknown")
        .when(days <= CHURN_DAYS["low"], "low")
        .when(days <= CHURN_DAYS["medium"], "medium")
        .otherwise("high")
    )
    return metrics.select(
        "customer_id",
        "customer_name",
        "email",
        "region",
        "customer_created_at",
        "total_orders",
        "total_revenue",
        ratio("total_revenue", "total_orders").alias("avg_order_value"),
        "first_order_date",
        "last_order_date",
        days.alias("days_since_last_order"),
        segment.alias("customer_segment"),
        risk.alias("churn_risk"),
    )


def product_totals(products: DataFrame, items: DataFrame) -> DataFrame:
    """Per-product totals, products without a sale included."""
    per_order = items.groupBy("product_id", "order_id").agg(
        F.sum("quantity").alias("units"),
        F.sum("line_total").alias("revenue"),
        F.sum("price").alias("price_sum"),
        F.count("*").alias("n_lines"),
        F.min("created_at").alias("first_at"),
        F.max("created_at").alias("last_at"),
    )
    sold = per_order.groupBy("product_id").agg(
        F.count("*").alias("total_orders"),
        F.sum("units").alias("total_units_sold"),
        F.sum("revenue").alias("total_revenue"),
        F.sum("price_sum").alias("price_sum"),
        F.sum("n_lines").alias("n_lines"),
        F.min("first_at").alias("first_sale_date"),
        F.max("last_at").alias("last_sale_date"),
    )
    return products.join(sold, "product_id", "left").select(
        "product_id",
        F.col("name").alias("product_name"),
        "category",
        F.col("price").alias("current_price"),
        F.coalesce("total_orders", F.lit(0)).alias("total_orders"),
        F.coalesce("total_units_sold", F.lit(0)).alias("total_units_sold"),
        F.coalesce("total_revenue", F.lit(0)).alias("total_revenue"),
        ratio("price_sum", "n_lines").alias("avg_selling_price"),
        ratio("total_units_sold", "total_orders").alias("avg_quantity_per_order"),
        "first_sale_date",
        "last_sale_date",
    )


def revenue_ranks(totals: DataFrame) -> DataFrame:
    """Overall and in-category rank by revenue, equal revenue sharing a rank.

    ``totals`` is read several times: hand in a written frame.
    """
    return ranks_desc(totals, "total_revenue", {"revenue_rank": [], "category_revenue_rank": ["category"]})


def mart_product_analytics(products: DataFrame, items: DataFrame) -> DataFrame:
    totals = materialize(product_totals(products, items), "product-totals")
    sold = totals.where("total_orders > 0")
    mean = sold.agg(ratio(F.sum("total_revenue"), F.count("*")).alias("m")).scalar()
    relative = F.col("total_revenue").cast("double") / mean
    tier = F.when(F.col("total_orders") == 0, "no_sales")
    for name, least in TIER_RATIOS.items():
        tier = tier.when(relative >= least, name)
    listed = F.col("current_price").cast("double")
    return revenue_ranks(totals).select(
        *totals.columns,
        tier.otherwise("underperformer").alias("performance_tier"),
        "revenue_rank",
        "category_revenue_rank",
        F.when(
            F.col("current_price") > 0, (F.col("avg_selling_price") - listed) / listed * 100
        ).alias("price_variance_pct"),
    )


# --- events ----------------------------------------------------------------


def daily_active_users(events: DataFrame) -> DataFrame:
    return events.groupBy(F.to_date("timestamp").alias("date")).agg(
        F.count_distinct("user_id").alias("dau")
    )


def with_share(counts: DataFrame, total: DataFrame) -> DataFrame:
    """Share of each count. The total is a scalar over the same shuffled counts, so the
    rows are read once and no window gathers the counts in one task."""
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / total.scalar(), 1))


def pct_of_total(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return with_share(counts, counts.agg(F.sum("n")))


def value_distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts and shares of the values of several columns, in one pass."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
            for c in columns
        ]
    )
    counts = (
        df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count("*").alias("n"))
    )
    return with_share(counts, counts.agg(F.sum("n") / len(columns)))


def load_gate(df: DataFrame, least_rows: int, least_regions: int) -> DataFrame:
    """One row saying whether a load is big and varied enough."""
    return df.agg(
        F.count("*").alias("n_rows"), F.count_distinct("region").alias("n_regions")
    ).withColumn("ok", (F.col("n_rows") >= least_rows) & (F.col("n_regions") >= least_regions))
