"""Metric queries, rollups and row-level security."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.plans import marts, metrics, staging
from lakeloom.plans.cubes import CUBES, CUSTOMERS, ORDERS, PRODUCT_TIERS, SEGMENTS
from lakeloom.plans.metrics import SecurityContext, cube_from_schema
from lakeloom.session import scratch_path
from lakeloom.sources.datasets import Dataset
from lakeloom.sources.layout import PartitionField
from lakeloom.suite import transforms  # noqa: F401  its SQL is used below
from lakeloom.suite.base import ORACLES, Tables, query
from lakeloom.suite.ctes import sql

AS_OF = datetime(2001, 8, 2)


class Frames(dict):
    """The tables behind the cubes; one is built when a query asks for it."""

    def __init__(self, t: Tables):
        self.t = t

    def __missing__(self, name: str) -> DataFrame:
        t = self.t
        if name == "segments":
            as_of = F.lit(str(AS_OF)).cast("timestamp_ntz")
            self[name] = marts.mart_customer_segments(t.stg("customers"), t.stg("orders"), as_of)
        elif name == "product_analytics":
            self[name] = marts.mart_product_analytics(t.stg("products"), t.stg("order_items"))
        elif name == "revenue":
            self[name] = marts.mart_revenue(t.customer_orders())
        elif name == "item_details":
            self[name] = marts.order_items_enriched(t.stg("order_items"), t.stg("products"))
        else:
            self[name] = t.stg(name)
        return self[name]


def frames(t: Tables) -> Frames:
    return Frames(t)


def ask(t: Tables, request: Mapping, **options) -> DataFrame:
    """A query of a trusted job: without a context it sees all rows."""
    return metrics.run(CUBES, frames(t), request, **{"as_of": AS_OF, "require_security": False} | options)


def metric(name: str, request: Mapping, check: str, **options) -> None:
    """Register one metric query and the SQL of its result."""

    @query(name, sql(check))
    def run(t: Tables) -> DataFrame:
        return ask(t, request, **options)


def by(measures: list[str], *dimensions: str, **rest) -> dict:
    return {"measures": measures, "dimensions": list(dimensions), **rest}


TOTAL = "CAST(sum(total_amount) AS DOUBLE)"
MEAN = "CAST(sum(total_amount) AS DOUBLE) / count(total_amount)"
STATUS = "status AS Orders_status"
REGION = "region AS Orders_region"

# --- query shapes ----------------------------------------------------------

metric(
    "query_totals",
    {"measures": ["Orders.count", "Orders.totalAmount"]},
    f"SELECT count(*) AS Orders_count, {TOTAL} AS Orders_totalAmount FROM stg_orders",
)
metric(
    "query_by_dims",
    by(["Orders.count", "Orders.totalAmount"], "Orders.status", "Orders.region"),
    f"""SELECT {STATUS}, {REGION}, count(*) AS Orders_count, {TOTAL} AS Orders_totalAmount
        FROM stg_orders GROUP BY status, region""",
)
metric(
    "query_filter_equals",
    by(
        ["Orders.count"],
        "Orders.status",
        filters=[{"member": "Orders.status", "operator": "equals", "values": ["completed"]}],
    ),
    f"SELECT {STATUS}, count(*) AS Orders_count FROM stg_orders WHERE status = 'completed' GROUP BY status",
)
metric(
    "query_filter_and",
    by(
        ["Orders.count"],
        "Orders.status",
        "Orders.region",
        filters=[
            {"member": "Orders.status", "operator": "equals", "values": ["completed", "pending"]},
            {"member": "Orders.region", "operator": "equals", "values": ["ASIA"]},
        ],
    ),
    f"""SELECT {STATUS}, {REGION}, count(*) AS Orders_count FROM stg_orders
        WHERE status IN ('completed', 'pending') AND region = 'ASIA' GROUP BY status, region""",
)
metric(
    "query_time_day",
    {
        "measures": ["Orders.count", "Orders.totalAmount"],
        "timeDimensions": [{"dimension": "Orders.createdAt", "granularity": "day"}],
    },
    f"""SELECT CAST(date_trunc('day', created_at) AS TIMESTAMP) AS Orders_createdAt,
               count(*) AS Orders_count, {TOTAL} AS Orders_totalAmount FROM stg_orders GROUP BY 1""",
)
metric(
    "query_time_range",
    {
        "measures": ["Orders.count"],
        "timeDimensions": [
            {
                "dimension": "Orders.createdAt",
                "granularity": "month",
                "dateRange": ["1997-01-01", "1997-12-31"],
            }
        ],
    },
    """SELECT CAST(date_trunc('month', created_at) AS TIMESTAMP) AS Orders_createdAt,
              count(*) AS Orders_count FROM stg_orders
       WHERE created_at >= TIMESTAMP '1997-01-01' AND created_at < TIMESTAMP '1998-01-01' GROUP BY 1""",
)
metric(
    "date_range_last_n",
    {
        "measures": ["Orders.count"],
        "timeDimensions": [
            {"dimension": "Orders.createdAt", "granularity": "day", "dateRange": "last 30 days"}
        ],
    },
    """SELECT CAST(date_trunc('day', created_at) AS TIMESTAMP) AS Orders_createdAt,
              count(*) AS Orders_count FROM stg_orders
       WHERE created_at >= TIMESTAMP '2001-07-03' AND created_at < TIMESTAMP '2001-08-02' GROUP BY 1""",
)
metric(
    "query_since",
    by(
        ["Orders.count"],
        "Orders.status",
        filters=[{"member": "Orders.createdAt", "operator": "gt", "values": ["2001-07-26 00:00:00"]}],
    ),
    f"""SELECT {STATUS}, count(*) AS Orders_count FROM stg_orders
        WHERE created_at > TIMESTAMP '2001-07-26' GROUP BY status""",
)
metric(
    "query_filter_sort_limit",
    by(
        ["Orders.totalAmount"],
        "Orders.region",
        filters=[{"member": "Orders.status", "operator": "equals", "values": ["completed"]}],
        order={"Orders.totalAmount": "desc"},
        limit=3,
    ),
    f"""SELECT {REGION}, {TOTAL} AS Orders_totalAmount FROM stg_orders WHERE status = 'completed'
        GROUP BY region ORDER BY sum(total_amount) DESC, region LIMIT 3""",
)
metric(
    "query_empty",
    by(
        ["Orders.count"],
        "Orders.status",
        filters=[{"member": "Orders.status", "operator": "equals", "values": ["no such status"]}],
    ),
    f"SELECT {STATUS}, count(*) AS Orders_count FROM stg_orders WHERE status = 'no such status' GROUP BY status",
)
metric(
    "query_order",
    by(["Orders.count"], "Orders.status", order={"Orders.count": "desc"}),
    f"SELECT {STATUS}, count(*) AS Orders_count FROM stg_orders GROUP BY status ORDER BY 2 DESC, 1",
)
metric(
    "query_limit",
    by(["Orders.count"], "Orders.customerId", limit=50),
    """SELECT customer_id AS Orders_customerId, count(*) AS Orders_count FROM stg_orders
       GROUP BY customer_id ORDER BY customer_id LIMIT 50""",
)
metric(
    "page_offset",
    by(["Orders.totalAmount"], "Orders.customerId", order={"Orders.totalAmount": "desc"}, limit=100, offset=200),
    f"""SELECT customer_id AS Orders_customerId, {TOTAL} AS Orders_totalAmount FROM stg_orders
        GROUP BY customer_id ORDER BY sum(total_amount) DESC, customer_id LIMIT 100 OFFSET 200""",
)
metric(
    "top_segments",
    by(
        ["Segments.totalRevenue", "Segments.count"],
        "Segments.segment",
        order={"Segments.totalRevenue": "desc"},
        limit=5,
    ),
    """SELECT CASE WHEN total_orders = 0 THEN 'never_ordered' WHEN total_revenue >= 1500000 THEN 'vip'
                   WHEN total_orders >= 8 THEN 'loyal'
                   WHEN date_diff('day', CAST(last_order_date AS DATE), DATE '2001-08-02') <= 365 THEN 'active'
                   ELSE 'new' END AS Segments_segment,
              CAST(sum(total_revenue) AS DOUBLE) AS Segments_totalRevenue, count(*) AS Segments_count
       FROM customer_metrics GROUP BY 1 ORDER BY sum(total_revenue) DESC, 1 LIMIT 5""",
)

for grain in ("second", "minute", "hour", "day"):
    # Event times are fine enough to tell the short grains apart.
    def _fine(grain: str) -> None:
        @query(
            f"time_grain_{grain}",
            f"""SELECT CAST(date_trunc('{grain}', ts) AS TIMESTAMP) AS Events_timestamp,
                       count(*) AS Events_count FROM events GROUP BY 1""",
        )
        def run(t: Tables) -> DataFrame:
            events = t.raw("events")
            cube = cube_from_schema("Events", "events", events.schema)
            request = {
                "measures": ["Events.count"],
                "timeDimensions": [{"dimension": "Events.timestamp", "granularity": grain}],
            }
            return metrics.run({"Events": cube}, {"events": events}, request)

    _fine(grain)

for grain in ("week", "month", "quarter", "year"):
    metric(
        f"time_grain_{grain}",
        {
            "measures": ["Orders.count", "Orders.totalAmount"],
            "timeDimensions": [{"dimension": "Orders.createdAt", "granularity": grain}],
        },
        f"""SELECT CAST(date_trunc('{grain}', created_at) AS TIMESTAMP) AS Orders_createdAt,
                   count(*) AS Orders_count, {TOTAL} AS Orders_totalAmount FROM stg_orders GROUP BY 1""",
    )

# --- measures --------------------------------------------------------------

for name, member, check in [
    ("count", "count", "count(*)"),
    ("count_distinct", "customers", "count(DISTINCT customer_id)"),
    ("sum", "totalAmount", TOTAL),
    ("avg", "averageAmount", MEAN),
    ("ratio", "amountPerCustomer", f"{TOTAL} / count(DISTINCT customer_id)"),
]:
    metric(
        f"measure_{name}",
        by([f"Orders.{member}"], "Orders.status"),
        f"SELECT {STATUS}, {check} AS Orders_{member} FROM stg_orders GROUP BY status",
    )

metric(
    "measure_min_max",
    by(["Orders.minAmount", "Orders.maxAmount"], "Orders.status"),
    f"""SELECT {STATUS}, CAST(min(total_amount) AS DOUBLE) AS Orders_minAmount,
               CAST(max(total_amount) AS DOUBLE) AS Orders_maxAmount FROM stg_orders GROUP BY status""",
)
metric(
    "measure_typed_exprs",
    by(["Orders.lastStatus", "Orders.latestOrder", "Orders.anyFailed"], "Orders.region"),
    f"""SELECT {REGION}, max(status) AS Orders_lastStatus, max(created_at) AS Orders_latestOrder,
               bool_or(status = 'failed') AS Orders_anyFailed FROM stg_orders GROUP BY region""",
)
metric(
    "measure_running_total",
    by(
        ["Orders.runningAmount"],
        "Orders.region",
        timeDimensions=[{"dimension": "Orders.createdAt", "granularity": "month"}],
    ),
    f"""SELECT {REGION}, CAST(date_trunc('month', created_at) AS TIMESTAMP) AS Orders_createdAt,
               CAST(sum(sum(total_amount)) OVER (PARTITION BY region ORDER BY date_trunc('month', created_at)
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS Orders_runningAmount
        FROM stg_orders GROUP BY region, date_trunc('month', created_at)""",
)
metric(
    "measure_filtered",
    by(["Orders.largeOrders", "Orders.completedAmount", "Orders.completedShare"], "Orders.region"),
    f"""SELECT {REGION}, count(*) FILTER (WHERE total_amount > 100000) AS Orders_largeOrders,
               CAST(sum(total_amount) FILTER (WHERE status = 'completed') AS DOUBLE) AS Orders_completedAmount,
               CAST(sum(CASE WHEN status = 'completed' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS Orders_completedShare
        FROM stg_orders GROUP BY region""",
)


@query(
    "measure_count_distinct_approx",
    sql(
        f"""SELECT {STATUS}, count(DISTINCT customer_id) AS exact, true AS within_bound
            FROM stg_orders GROUP BY status"""
    ),
)
def measure_count_distinct_approx(t: Tables) -> DataFrame:
    """The approximate count beside the exact one, within three standard errors."""
    both = ask(t, by(["Orders.customers", "Orders.customersApprox"], "Orders.status"))
    error = F.abs(F.col("Orders_customersApprox") - F.col("Orders_customers"))
    return both.select(
        "Orders_status",
        F.col("Orders_customers").alias("exact"),
        (error <= F.col("Orders_customers") * 0.06 + 1).alias("within_bound"),
    )


# --- joined and derived cubes ----------------------------------------------

metric(
    "cube_join_many_to_one",
    by(["Orders.count", "Orders.totalAmount"], "Customers.region"),
    f"""SELECT c.region AS Customers_region, count(*) AS Orders_count, {TOTAL} AS Orders_totalAmount
        FROM stg_orders o LEFT JOIN stg_customers c ON o.customer_id = c.customer_id GROUP BY c.region""",
)
metric(
    "cube_join_one_to_one",
    by(["Customers.count"], "Segments.churnRisk"),
    """SELECT CASE WHEN last_order_date IS NULL THEN 'unknown'
                   WHEN date_diff('day', CAST(last_order_date AS DATE), DATE '2001-08-02') <= 180 THEN 'low'
                   WHEN date_diff('day', CAST(last_order_date AS DATE), DATE '2001-08-02') <= 540 THEN 'medium'
                   ELSE 'high' END AS Segments_churnRisk, count(*) AS Customers_count
       FROM customer_metrics GROUP BY 1""",
)
metric(
    "cube_join_one_to_many",
    by(["Customers.count", "Orders.count", "Orders.averageAmount"], "Customers.region"),
    """SELECT c.region AS Customers_region, count(DISTINCT c.customer_id) AS Customers_count,
              count(o.order_id) AS Orders_count,
              CAST(sum(o.total_amount) AS DOUBLE) / count(o.total_amount) AS Orders_averageAmount
       FROM stg_customers c LEFT JOIN stg_orders o ON c.customer_id = o.customer_id GROUP BY c.region""",
)
ITEM_DETAILS = "SELECT i.order_id, i.product_id, i.quantity, p.category FROM stg_order_items i JOIN stg_products p ON i.product_id = p.product_id"

metric(
    "many_side_distinct",
    by(["Customers.count", "Orders.customers", "Orders.count", "Orders.totalAmount"], "Customers.region"),
    f"""SELECT c.region AS Customers_region, count(DISTINCT c.customer_id) AS Customers_count, count(DISTINCT o.customer_id) AS Orders_customers,
               count(o.order_id) AS Orders_count, {TOTAL} AS Orders_totalAmount
        FROM stg_customers c LEFT JOIN stg_orders o ON c.customer_id = o.customer_id GROUP BY c.region""",
)
metric(
    "many_side_distinct_products",
    by(
        ["Orders.totalAmount", "Items.products", "Items.quantity"],
        "Orders.status",
        filters=[{"member": "Orders.region", "operator": "equals", "values": ["ASIA", "AFRICA"]}],
    ),
    f"""WITH i AS ({ITEM_DETAILS}), o AS (SELECT * FROM stg_orders WHERE region IN ('ASIA', 'AFRICA'))
        SELECT {STATUS}, {TOTAL} AS Orders_totalAmount,
               (SELECT count(DISTINCT product_id) FROM i JOIN o x USING (order_id) WHERE x.status = o.status) AS Items_products,
               (SELECT sum(quantity) FROM i JOIN o x USING (order_id) WHERE x.status = o.status) AS Items_quantity
        FROM o GROUP BY status""",
)
metric(
    "many_side_dimensions",
    by(["Orders.count", "Orders.totalAmount", "Items.quantity", "Items.products"], "Items.category", "Orders.status"),
    f"""WITH i AS ({ITEM_DETAILS}),
        per AS (SELECT order_id, category, sum(quantity) AS quantity FROM i GROUP BY order_id, category)
        SELECT category AS Items_category, {STATUS}, count(*) AS Orders_count, {TOTAL} AS Orders_totalAmount, sum(quantity) AS Items_quantity,
               coalesce((SELECT count(DISTINCT product_id) FROM i JOIN stg_orders x USING (order_id)
                         WHERE i.category = per.category AND x.status = stg_orders.status), 0) AS Items_products
        FROM stg_orders LEFT JOIN per USING (order_id) GROUP BY category, status""",
)
metric(
    "query_joined_cubes",
    by(
        ["Orders.count", "Orders.totalAmount"],
        "Customers.region",
        "Orders.status",
        filters=[{"member": "Customers.region", "operator": "equals", "values": ["EUROPE", "ASIA"]}],
    ),
    f"""SELECT c.region AS Customers_region, o.status AS Orders_status, count(*) AS Orders_count,
               {TOTAL} AS Orders_totalAmount
        FROM stg_orders o JOIN stg_customers c ON o.customer_id = c.customer_id
        WHERE c.region IN ('EUROPE', 'ASIA') GROUP BY 1, 2""",
)
metric(
    "cube_orders",
    by(["Orders.count", "Orders.totalAmount", "Orders.averageAmount", "Orders.completedCount"], "Orders.region"),
    f"""SELECT {REGION}, count(*) AS Orders_count, {TOTAL} AS Orders_totalAmount,
               {MEAN} AS Orders_averageAmount,
               CAST(sum(CASE WHEN status = 'completed' THEN 1 ELSE 0 END) AS BIGINT) AS Orders_completedCount
        FROM stg_orders GROUP BY region""",
)
metric(
    "cube_customers",
    by(["Customers.count"], "Customers.region"),
    "SELECT region AS Customers_region, count(*) AS Customers_count FROM stg_customers GROUP BY region",
)
metric(
    "cube_products",
    by(["Products.count", "Products.averagePrice", "Products.totalValue"], "Products.category"),
    """SELECT category AS Products_category, count(*) AS Products_count,
              CAST(sum(price) AS DOUBLE) / count(price) AS Products_averagePrice,
              CAST(sum(price) AS DOUBLE) AS Products_totalValue FROM stg_products GROUP BY category""",
)


@query(
    "cube_from_schema",
    """SELECT event_type AS Events_event_type, count(*) AS Events_count,
              count(DISTINCT user_id) AS Events_users FROM events GROUP BY 1""",
)
def from_schema(t: Tables) -> DataFrame:
    """Dimensions derived from the columns, measures declared beside the model."""
    events = t.raw("events")
    meta = {
        "measures": [
            {"name": "count", "type": "count"},
            {"name": "users", "type": "count_distinct", "sql": "user_id"},
        ]
    }
    cube = cube_from_schema("Events", "events", events.schema, meta)
    request = by(["Events.count", "Events.users"], "Events.event_type")
    return metrics.run({"Events": cube}, {"events": events}, request)


# --- cubes over marts ------------------------------------------------------

SEGMENT_ROWS = f"({ORACLES['mart_customer_segments']})"
TIER_ROWS = f"({ORACLES['mart_product_analytics']})"
REVENUE_ROWS = f"({ORACLES['mart_revenue']})"
MONEY = "CAST(sum(CAST(total_revenue AS DECIMAL(18,2))) AS DOUBLE)"


def _mean(column: str) -> str:
    return f"CAST(sum(CAST({column} AS DECIMAL(18,6))) AS DOUBLE) / count({column})"


metric(
    "cube_segments",
    by(
        ["Segments.count", "Segments.totalRevenue", "Segments.totalOrders", "Segments.averageOrderValue", "Segments.averageDaysSinceOrder"],
        "Segments.segment",
    ),
    f"""SELECT customer_segment AS Segments_segment, count(*) AS Segments_count, {MONEY} AS Segments_totalRevenue,
               CAST(sum(total_orders) AS BIGINT) AS Segments_totalOrders, {_mean("avg_order_value")} AS Segments_averageOrderValue,
               CAST(sum(days_since_last_order) AS DOUBLE) / count(days_since_last_order) AS Segments_averageDaysSinceOrder
        FROM {SEGMENT_ROWS} GROUP BY 1""",
)
metric(
    "cube_product_tiers",
    by(
        [
            "ProductTiers.count", "ProductTiers.totalRevenue", "ProductTiers.totalUnitsSold", "ProductTiers.totalOrders",
            "ProductTiers.averageSellingPrice", "ProductTiers.averageQuantityPerOrder",
        ],
        "ProductTiers.category",
        "ProductTiers.performanceTier",
    ),
    f"""SELECT category AS ProductTiers_category, performance_tier AS "ProductTiers_performanceTier", count(*) AS ProductTiers_count,
               {MONEY} AS "ProductTiers_totalRevenue", CAST(sum(total_units_sold) AS BIGINT) AS "ProductTiers_totalUnitsSold",
               CAST(sum(total_orders) AS BIGINT) AS "ProductTiers_totalOrders", {_mean("avg_selling_price")} AS "ProductTiers_averageSellingPrice",
               {_mean("avg_quantity_per_order")} AS "ProductTiers_averageQuantityPerOrder"
        FROM {TIER_ROWS} GROUP BY 1, 2""",
)
metric(
    "cube_daily_revenue",
    {
        "measures": [f"DailyRevenue.{m}" for m in ("count", "completedCount", "totalAmount", "totalUnitsSold", "uniqueProducts", "uniqueCustomers")],
        "timeDimensions": [{"dimension": "DailyRevenue.orderDate", "granularity": "month"}],
    },
    f"""SELECT CAST(date_trunc('month', CAST(revenue_date AS DATE)) AS TIMESTAMP) AS "DailyRevenue_orderDate", CAST(sum(order_count) AS BIGINT) AS DailyRevenue_count,
               CAST(sum(CASE WHEN status = 'completed' THEN order_count END) AS BIGINT) AS "DailyRevenue_completedCount",
               {MONEY} AS "DailyRevenue_totalAmount", CAST(sum(total_items_sold) AS BIGINT) AS "DailyRevenue_totalUnitsSold",
               max(total_products_sold) AS "DailyRevenue_uniqueProducts", max(customer_count) AS "DailyRevenue_uniqueCustomers"
        FROM {REVENUE_ROWS} GROUP BY 1""",
)
metric(
    "cube_two_joins",
    by(["Orders.count", "Orders.totalAmount"], "Segments.segment"),
    f"""SELECT s.customer_segment AS Segments_segment, count(*) AS Orders_count, {TOTAL} AS Orders_totalAmount
        FROM stg_orders o LEFT JOIN stg_customers c ON o.customer_id = c.customer_id
        LEFT JOIN {SEGMENT_ROWS} s ON c.customer_id = s.customer_id GROUP BY 1""",
)


@query(
    "rollup_by_segment",
    sql(
        f"""SELECT customer_segment AS segment, churn_risk AS "churnRisk", count(*) AS "count", {MONEY} AS "totalRevenue",
                   {_mean("avg_order_value")} AS "averageOrderValue" FROM {SEGMENT_ROWS} GROUP BY 1, 2"""
    ),
)
def rollup_by_segment(t: Tables) -> DataFrame:
    rollup = SEGMENTS.rollups[0]
    return metrics.finish_rollup(SEGMENTS, rollup, metrics.build_rollup(SEGMENTS, rollup, frames(t)["segments"]))


@query(
    "rollup_by_category",
    sql(
        f"""SELECT category, performance_tier AS "performanceTier", count(*) AS "count", {MONEY} AS "totalRevenue",
                   CAST(sum(total_units_sold) AS BIGINT) AS "totalUnitsSold" FROM {TIER_ROWS} GROUP BY 1, 2"""
    ),
)
def rollup_by_category(t: Tables) -> DataFrame:
    rollup = PRODUCT_TIERS.rollups[0]
    parts = metrics.build_rollup(PRODUCT_TIERS, rollup, frames(t)["product_analytics"])
    return metrics.finish_rollup(PRODUCT_TIERS, rollup, parts)


@query(
    "silver_views",
    sql("SELECT status, count(*) AS n, CAST(sum(total_amount) AS DOUBLE) AS amount FROM stg_orders GROUP BY status"),
)
def silver_views(t: Tables) -> DataFrame:
    """The cleaned tables as views of the session, asked in SQL."""
    names = staging.create_views(t.spark, {n: t.stg(n) for n in ("orders", "customers")})
    return t.spark.sql(f"SELECT status, count(*) AS n, sum(total_amount) AS amount FROM {names['orders']} GROUP BY status")


FIFTIETH = by(
    ["Orders.count"], "Orders.customerId", order={"Orders.count": "desc"}, limit=50,
)


@query(
    "page_after",
    sql(
        """SELECT customer_id AS "Orders_customerId", count(*) AS Orders_count FROM stg_orders GROUP BY 1
           ORDER BY 2 DESC, 1 LIMIT 50 OFFSET 50"""
    ),
)
def page_after(t: Tables) -> DataFrame:
    """The second page, found by the last row of the first."""
    last = ask(t, FIFTIETH).collect()[-1]
    after = {"Orders.count": last.Orders_count, "Orders.customerId": last.Orders_customerId}
    return ask(t, {**FIFTIETH, "after": after})


# --- rollups ---------------------------------------------------------------

DAY, WEEK, MONTH, BY_CUSTOMER = ORDERS.rollups


@query(
    "rollup_orders_by_day",
    sql(
        f"""SELECT status, region, CAST(date_trunc('day', created_at) AS TIMESTAMP) AS "createdAt",
                   count(*) AS "count", {TOTAL} AS "totalAmount", {MEAN} AS "averageAmount"
            FROM stg_orders GROUP BY 1, 2, 3"""
    ),
)
def rollup_orders_by_day(t: Tables) -> DataFrame:
    parts = metrics.build_rollup(ORDERS, DAY, t.stg("orders"))
    return metrics.finish_rollup(ORDERS, DAY, parts).drop("customersApprox")


@query(
    "rollup_orders_by_week",
    sql(
        f"""SELECT status, CAST(date_trunc('week', created_at) AS TIMESTAMP) AS "createdAt",
                   count(*) AS "count", {TOTAL} AS "totalAmount" FROM stg_orders GROUP BY 1, 2"""
    ),
)
def rollup_orders_by_week(t: Tables) -> DataFrame:
    return metrics.finish_rollup(ORDERS, WEEK, metrics.build_rollup(ORDERS, WEEK, t.stg("orders")))


@query(
    "rollup_customers_by_region",
    sql('SELECT region, count(*) AS "count" FROM stg_customers GROUP BY region'),
)
def rollup_customers_by_region(t: Tables) -> DataFrame:
    rollup = CUSTOMERS.rollups[0]
    parts = metrics.build_rollup(CUSTOMERS, rollup, t.stg("customers"))
    return metrics.finish_rollup(CUSTOMERS, rollup, parts)


def _stored_rollup(t: Tables) -> DataFrame:
    table = Dataset(t.spark, scratch_path(t.spark, "rollup"))
    table.overwrite(metrics.build_rollup(ORDERS, DAY, t.stg("orders")))
    return table.scan()


@query(
    "query_via_rollup",
    sql(
        f"""SELECT {REGION}, CAST(date_trunc('month', created_at) AS TIMESTAMP) AS Orders_createdAt,
                   count(*) AS Orders_count, {MEAN} AS Orders_averageAmount
            FROM stg_orders WHERE status = 'completed'
              AND created_at >= TIMESTAMP '1996-01-01' AND created_at < TIMESTAMP '1999-01-01'
            GROUP BY region, 2"""
    ),
)
def query_via_rollup(t: Tables) -> DataFrame:
    """A monthly average answered from the stored daily rollup; the base table is not given."""
    request = by(
        ["Orders.count", "Orders.averageAmount"],
        "Orders.region",
        filters=[{"member": "Orders.status", "operator": "equals", "values": ["completed"]}],
        timeDimensions=[
            {
                "dimension": "Orders.createdAt",
                "granularity": "month",
                "dateRange": ["1996-01-01", "1998-12-31"],
            }
        ],
    )
    return metrics.run(CUBES, {}, request, rollups={"ordersByDay": _stored_rollup(t)}, require_security=False)


def _stored(t: Tables, rollup: metrics.Rollup, name: str) -> DataFrame:
    table = Dataset(t.spark, scratch_path(t.spark, name))
    table.overwrite(metrics.build_rollup(ORDERS, rollup, t.stg("orders")))
    return table.scan()


@query(
    "distinct_via_rollup",
    sql(
        f"""SELECT {REGION}, CAST(date_trunc('quarter', created_at) AS TIMESTAMP) AS Orders_createdAt,
                   count(DISTINCT customer_id) AS Orders_customers, {TOTAL} / count(DISTINCT customer_id) AS Orders_amountPerCustomer
            FROM stg_orders WHERE status IN ('completed', 'pending') GROUP BY region, 2"""
    ),
)
def distinct_via_rollup(t: Tables) -> DataFrame:
    """Exact distinct customers of quarters from the bitmaps of a monthly rollup; the base table is not given."""
    request = by(
        ["Orders.customers", "Orders.amountPerCustomer"],
        "Orders.region",
        filters=[{"member": "Orders.status", "operator": "equals", "values": ["completed", "pending"]}],
        timeDimensions=[{"dimension": "Orders.createdAt", "granularity": "quarter"}],
    )
    return metrics.run(CUBES, {}, request, rollups={"ordersByMonth": _stored(t, MONTH, "by-month")}, require_security=False)


@query(
    "query_two_cubes_via_rollup",
    sql(
        f"""SELECT c.region AS Customers_region, count(DISTINCT c.customer_id) AS Customers_count, count(o.order_id) AS Orders_count,
                   {TOTAL} AS Orders_totalAmount
            FROM stg_customers c LEFT JOIN (SELECT * FROM stg_orders WHERE status <> 'x') o ON c.customer_id = o.customer_id GROUP BY c.region"""
    ),
)
def query_two_cubes_via_rollup(t: Tables) -> DataFrame:
    """Customers and their orders by region: the orders come from the rollup that keeps the customers' key, not from their table."""
    request = by(["Customers.count", "Orders.count", "Orders.totalAmount"], "Customers.region")
    stored = {"ordersByCustomer": _stored(t, BY_CUSTOMER, "by-customer")}
    return metrics.run(CUBES, {"customers": t.stg("customers")}, request, rollups=stored, require_security=False)


@query(
    "joined_dimension_via_rollup",
    sql(
        f"""SELECT c.region AS Customers_region, o.status AS Orders_status, count(*) AS Orders_count, {MEAN} AS Orders_averageAmount
            FROM stg_orders o JOIN stg_customers c ON o.customer_id = c.customer_id WHERE c.region IN ('EUROPE', 'ASIA') GROUP BY 1, 2"""
    ),
)
def joined_dimension_via_rollup(t: Tables) -> DataFrame:
    """Orders by a column of their customers, joined to the rollup's rows; the smaller of two rollups that hold the key is taken."""
    request = by(
        ["Orders.count", "Orders.averageAmount"],
        "Customers.region",
        "Orders.status",
        filters=[{"member": "Customers.region", "operator": "equals", "values": ["EUROPE", "ASIA"]}],
    )
    stored = {"ordersByCustomer": _stored(t, BY_CUSTOMER, "by-customer"), "ordersByDay": _stored_rollup(t)}
    sizes = {name: rows.count() for name, rows in stored.items()}
    return metrics.run(CUBES, {"customers": t.stg("customers")}, request, rollups=stored, sizes=sizes, require_security=False)


MONTH_SQL = f"""SELECT status, region, CAST(date_trunc('month', created_at) AS TIMESTAMP) AS "createdAt",
                       count(*) AS "count", {TOTAL} AS "totalAmount", count(DISTINCT customer_id) AS customers FROM stg_orders GROUP BY 1, 2, 3"""


@query("rollup_delta", sql(MONTH_SQL))
def rollup_delta(t: Tables) -> DataFrame:
    """Orders arrive in three loads that share months; each is merged into the stored parts, and the orders before it are not read."""
    orders = t.stg("orders")
    table = Dataset(t.spark, scratch_path(t.spark, "delta-rollup"), [PartitionField("createdAt", "year")])
    for i in range(3):
        metrics.add_to_rollup(table, ORDERS, MONTH, orders.where(F.col("order_id") % 3 == i))
    return metrics.finish_rollup(ORDERS, MONTH, table.scan())


@query("rollup_refresh_changed", sql(MONTH_SQL))
def rollup_refresh_changed(t: Tables) -> DataFrame:
    """The base grows and shrinks in some years; only their folders are read when the rule says that the rollup is too old."""
    orders = t.stg("orders")
    years = [PartitionField("created_at", "year")]
    base = Dataset(t.spark, scratch_path(t.spark, "orders"), years)
    base.append(orders.where("order_id % 5 <> 0 or year(created_at) < 1998"))
    table = Dataset(t.spark, scratch_path(t.spark, "refreshed"), [PartitionField("createdAt", "year")])
    keys, at = Dataset(t.spark, scratch_path(t.spark, "refresh-keys")), AS_OF
    metrics.refresh_changed(table, keys, ORDERS, MONTH, base, "created_at", at)
    base.append(orders.where("order_id % 5 = 0 and year(created_at) >= 1998"))
    # Young enough: nothing happens until the rule's half hour is over.
    metrics.refresh_changed(table, keys, ORDERS, MONTH, base, "created_at", at + timedelta(minutes=10))
    metrics.refresh_changed(table, keys, ORDERS, MONTH, base, "created_at", at + timedelta(minutes=40))
    return metrics.finish_rollup(ORDERS, MONTH, table.scan())


@query(
    "rollup_refresh",
    sql(
        f"""SELECT status, region, CAST(date_trunc('day', created_at) AS TIMESTAMP) AS "createdAt",
                   count(*) AS "count", {TOTAL} AS "totalAmount" FROM stg_orders GROUP BY 1, 2, 3"""
    ),
)
def rollup_refresh(t: Tables) -> DataFrame:
    """New orders arrive; only the years they fall into are recomputed."""
    orders = t.stg("orders")
    old = orders.where("created_at < timestamp_ntz'2000-06-01'")
    arrived = orders.where("created_at >= timestamp_ntz'2000-06-01'")
    path = scratch_path(t.spark, "refresh")
    table = Dataset(t.spark, path, [PartitionField("createdAt", "year")])
    table.append(metrics.build_rollup(ORDERS, DAY, old))
    metrics.refresh_rollup(table, ORDERS, DAY, orders, arrived)
    return metrics.finish_rollup(ORDERS, DAY, table.scan()).select(
        "status", "region", "createdAt", "count", "totalAmount"
    )


@query(
    "rollup_hll",
    sql(
        f"""SELECT {STATUS}, count(DISTINCT customer_id) AS exact, true AS within_bound
            FROM stg_orders GROUP BY status"""
    ),
)
def rollup_hll(t: Tables) -> DataFrame:
    """Distinct customers per status from the sketches of the daily rollup."""
    request = by(["Orders.customersApprox"], "Orders.status")
    estimate = metrics.run(CUBES, {}, request, rollups={"ordersByDay": _stored_rollup(t)}, require_security=False)
    exact = ask(t, by(["Orders.customers"], "Orders.status"))
    error = F.abs(F.col("Orders_customersApprox") - F.col("Orders_customers"))
    return estimate.join(exact, "Orders_status").select(
        "Orders_status",
        F.col("Orders_customers").alias("exact"),
        (error <= F.col("Orders_customers") * 0.06 + 1).alias("within_bound"),
    )


# --- row-level security ----------------------------------------------------

metric(
    "rls_region",
    by(["Orders.count", "Orders.totalAmount"], "Orders.region", "Orders.status"),
    f"""SELECT {REGION}, {STATUS}, count(*) AS Orders_count, {TOTAL} AS Orders_totalAmount
        FROM stg_orders WHERE region = 'ASIA' GROUP BY region, status""",
    security=SecurityContext("ana", claims={"region": "ASIA"}),
)


@query(
    "rls_multi_claim",
    sql(
        f"""SELECT {STATUS}, count(*) AS Orders_count FROM stg_orders
            WHERE region = 'EUROPE' AND status = 'pending' GROUP BY status"""
    ),
)
def rls_multi_claim(t: Tables) -> DataFrame:
    """Two claims are both applied."""
    from dataclasses import replace

    cubes = {"Orders": replace(ORDERS, row_filters=("region", "status"))}
    context = SecurityContext("bo", claims={"region": "EUROPE", "status": "pending"})
    return metrics.run(cubes, frames(t), by(["Orders.count"], "Orders.status"), context)


@query(
    "rls_partition_sum",
    sql(
        """SELECT count(*) FILTER (WHERE region IS NOT NULL) AS parts, count(*) AS total, true AS equal
           FROM stg_orders"""
    ),
)
def rls_partition_sum(t: Tables) -> DataFrame:
    """What each region may see adds up to the whole."""
    request = {"measures": ["Orders.count"]}
    regions = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    seen = [ask(t, request, security=SecurityContext(r, claims={"region": r})) for r in regions]
    union = seen[0]
    for part in seen[1:]:
        union = union.unionByName(part)
    total = ask(t, request).select("Orders_count").scalar()
    return union.agg(F.sum("Orders_count").alias("parts")).select(
        "parts", total.alias("total"), (F.col("parts") == total).alias("equal")
    )
