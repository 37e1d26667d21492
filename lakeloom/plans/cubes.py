"""The demo cubes over the silver and gold models."""

from __future__ import annotations

from lakeloom.plans.metrics import Cube, Dimension, Join, Measure, Rollup

ORDERS = Cube(
    name="Orders",
    table="orders",
    dimensions=(
        Dimension("id", "order_id", "number", primary_key=True),
        Dimension("status", "status"),
        Dimension("region", "region"),
        Dimension("customerId", "customer_id", "number"),
        Dimension("createdAt", "created_at", "time"),
    ),
    measures=(
        Measure("count"),
        Measure("totalAmount", "sum", "total_amount"),
        Measure("averageAmount", "avg", "total_amount"),
        Measure("minAmount", "min", "total_amount"),
        Measure("maxAmount", "max", "total_amount"),
        Measure("completedCount", "sum", "CASE WHEN status = 'completed' THEN 1 ELSE 0 END"),
        Measure("customers", "count_distinct", "customer_id"),
        Measure("customersApprox", "count_distinct_approx", "customer_id"),
        Measure("largeOrders", "count", None, ("total_amount > 100000",)),
        Measure("completedAmount", "sum", "total_amount", ("status = 'completed'",)),
        Measure("runningAmount", "running_total", "total_amount"),
        Measure("lastStatus", "string", "status"),
        Measure("latestOrder", "time", "created_at"),
        Measure("anyFailed", "boolean", "status = 'failed'"),
        Measure(
            "amountPerCustomer",
            "number",
            "try_divide(cast({totalAmount} as double), {customers})",
            uses=("totalAmount", "customers"),
        ),
        Measure(
            "completedShare",
            "number",
            "try_divide(cast({completedCount} as double), {count})",
            uses=("completedCount", "count"),
        ),
    ),
    joins=(
        Join("Customers", "many_to_one", "customer_id", "customer_id"),
        Join("Items", "one_to_many", "order_id", "order_id"),
    ),
    rollups=(
        Rollup(
            "ordersByDay",
            ("count", "totalAmount", "averageAmount", "customersApprox"),
            ("status", "region"),
            "createdAt",
            "day",
        ),
        Rollup("ordersByWeek", ("count", "totalAmount"), ("status",), "createdAt", "week"),
        Rollup("ordersByMonth", ("count", "totalAmount", "customers"), ("status", "region"), "createdAt", "month", "30m"),
        # Keeps the key of the customers, so it answers queries over both.
        Rollup("ordersByCustomer", ("count", "totalAmount", "averageAmount"), ("customerId", "status")),
    ),
    row_filters=("region",),
)

ITEMS = Cube(
    name="Items",
    table="item_details",
    dimensions=(
        Dimension("id", "order_item_id", "number", primary_key=True),
        Dimension("category", "category"),
        Dimension("productId", "product_id", "number"),
    ),
    measures=(
        Measure("count"),
        Measure("quantity", "sum", "quantity"),
        Measure("products", "count_distinct", "product_id"),
    ),
    row_filters=(),
)

CUSTOMERS = Cube(
    name="Customers",
    table="customers",
    dimensions=(
        Dimension("id", "customer_id", "number", primary_key=True),
        Dimension("name", "name"),
        Dimension("email", "email"),
        Dimension("region", "region"),
        Dimension("createdAt", "created_at", "time"),
    ),
    measures=(Measure("count"),),
    joins=(
        Join("Orders", "one_to_many", "customer_id", "customer_id"),
        Join("Segments", "one_to_one", "customer_id", "customer_id"),
    ),
    rollups=(Rollup("customersByRegion", ("count",), ("region",)),),
    row_filters=("region",),
)

PRODUCTS = Cube(
    name="Products",
    table="products",
    dimensions=(
        Dimension("id", "product_id", "number", primary_key=True),
        Dimension("name", "name"),
        Dimension("category", "category"),
        Dimension("price", "price", "number"),
    ),
    measures=(
        Measure("count"),
        Measure("averagePrice", "avg", "price"),
        Measure("totalValue", "sum", "price"),
    ),
    row_filters=(),
)

SEGMENTS = Cube(
    name="Segments",
    table="segments",
    dimensions=(
        Dimension("customerId", "customer_id", "number", primary_key=True),
        Dimension("segment", "customer_segment"),
        Dimension("churnRisk", "churn_risk"),
        Dimension("customerName", "customer_name"),
        Dimension("email", "email"),
        Dimension("createdAt", "customer_created_at", "time"),
        Dimension("firstOrderDate", "first_order_date", "time"),
        Dimension("lastOrderDate", "last_order_date", "time"),
    ),
    measures=(
        Measure("count"),
        Measure("totalRevenue", "sum", "total_revenue"),
        Measure("totalOrders", "sum", "total_orders"),
        # Averages of ratios are taken over six decimals, so the order of rows does not show.
        Measure("averageOrderValue", "avg", "cast(avg_order_value as decimal(18,6))"),
        Measure("averageDaysSinceOrder", "avg", "days_since_last_order"),
    ),
    rollups=(Rollup("bySegment", ("count", "totalRevenue", "averageOrderValue"), ("segment", "churnRisk")),),
    row_filters=(),
)

PRODUCT_TIERS = Cube(
    name="ProductTiers",
    table="product_analytics",
    dimensions=(
        Dimension("productId", "product_id", "number", primary_key=True),
        Dimension("productName", "product_name"),
        Dimension("category", "category"),
        Dimension("currentPrice", "current_price", "number"),
        Dimension("performanceTier", "performance_tier"),
        Dimension("revenueRank", "revenue_rank", "number"),
        Dimension("categoryRevenueRank", "category_revenue_rank", "number"),
        Dimension("priceVariance", "price_variance_pct", "number"),
        Dimension("firstSaleDate", "first_sale_date", "time"),
        Dimension("lastSaleDate", "last_sale_date", "time"),
    ),
    measures=(
        Measure("count"),
        Measure("totalRevenue", "sum", "total_revenue"),
        Measure("totalUnitsSold", "sum", "total_units_sold"),
        Measure("totalOrders", "sum", "total_orders"),
        Measure("averageSellingPrice", "avg", "cast(avg_selling_price as decimal(18,6))"),
        Measure("averageQuantityPerOrder", "avg", "cast(avg_quantity_per_order as decimal(18,6))"),
    ),
    rollups=(Rollup("byCategory", ("count", "totalRevenue", "totalUnitsSold"), ("category", "performanceTier")),),
    row_filters=(),
)

DAILY_REVENUE = Cube(
    name="DailyRevenue",
    table="revenue",
    dimensions=(
        Dimension("orderDate", "cast(revenue_date as timestamp_ntz)", "time"),
        Dimension("region", "region"),
        Dimension("status", "status"),
    ),
    measures=(
        Measure("count", "sum", "order_count"),
        Measure("completedCount", "sum", "order_count", ("status = 'completed'",)),
        Measure("totalAmount", "sum", "total_revenue"),
        Measure("averageOrderValue", "avg", "cast(avg_order_value as decimal(18,6))"),
        Measure("totalUnitsSold", "sum", "total_items_sold"),
        Measure("uniqueProducts", "max", "total_products_sold"),
        Measure("uniqueCustomers", "max", "customer_count"),
    ),
    rollups=(Rollup("revenueByDay", ("count", "totalAmount", "averageOrderValue"), (), "orderDate", "day"),),
    row_filters=(),
)

CUBES = {c.name: c for c in (ORDERS, ITEMS, CUSTOMERS, PRODUCTS, SEGMENTS, PRODUCT_TIERS, DAILY_REVENUE)}
