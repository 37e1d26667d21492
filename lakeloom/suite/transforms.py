"""Cleaning, joins, aggregations, windows and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.functions import clean
from lakeloom.operators.ranking import row_number_desc
from lakeloom.plans import marts, staging
from lakeloom.session import materialize
from lakeloom.suite.base import Tables, query
from lakeloom.suite.ctes import sql

AS_OF = "2001-08-02 00:00:00"


# --- staging ---------------------------------------------------------------


@query("stg_customers", sql("SELECT * FROM stg_customers"))
def stg_customers(t: Tables) -> DataFrame:
    return t.stg("customers")


@query(
    "stg_orders",
    sql(
        "SELECT order_id, customer_id, status, region, CAST(total_amount AS DOUBLE) AS total_amount,"
        " created_at FROM stg_orders"
    ),
)
def stg_orders(t: Tables) -> DataFrame:
    return t.stg("orders")


@query(
    "stg_products",
    sql(
        "SELECT product_id, name, category, CAST(price AS DOUBLE) AS price, created_at FROM stg_products"
    ),
)
def stg_products(t: Tables) -> DataFrame:
    return t.stg("products")


@query(
    "stg_order_items",
    sql(
        "SELECT order_item_id, order_id, product_id, CAST(quantity AS BIGINT) AS quantity,"
        " CAST(price AS DOUBLE) AS price, CAST(line_total AS DOUBLE) AS line_total, created_at"
        " FROM stg_order_items"
    ),
)
def stg_order_items(t: Tables) -> DataFrame:
    return t.stg("order_items")


@query(
    "filter_required",
    """SELECT c_custkey, name, email FROM (
         SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_name END AS name,
                CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS email FROM customer)
       WHERE c_custkey IS NOT NULL AND name IS NOT NULL AND email IS NOT NULL""",
)
def filter_required(t: Tables) -> DataFrame:
    rows = t.given("customer").select(
        "c_custkey",
        F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("name"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("email"),
    )
    return clean.require(rows, "c_custkey", "name", "email")


@query(
    "filter_range",
    sql(
        "SELECT order_item_id, quantity, price FROM raw_order_items WHERE quantity > 5 AND price >= 1000"
    ),
)
def filter_range(t: Tables) -> DataFrame:
    return (
        t.raw("order_items")
        .where("quantity > 5 and price >= 1000")
        .select("order_item_id", "quantity", "price")
    )


@query(
    "dedupe_latest",
    sql(
        """SELECT order_item_id, created_at, product_id, quantity FROM (
             SELECT *, row_number() OVER (PARTITION BY order_item_id
                    ORDER BY created_at DESC, product_id DESC, quantity DESC) AS rn FROM raw_order_items)
           WHERE rn = 1"""
    ),
)
def dedupe_latest(t: Tables) -> DataFrame:
    rows = t.raw("order_items").select("order_item_id", "created_at", "product_id", "quantity")
    return clean.dedupe_latest(rows, ["order_item_id"], "created_at")


@query(
    "canon_status",
    sql(
        """SELECT r.status AS raw_status, s.status, count(*) AS n
           FROM raw_orders r JOIN stg_orders s ON r.order_id = s.order_id GROUP BY 1, 2"""
    ),
)
def canon_status(t: Tables) -> DataFrame:
    return (
        t.raw("orders")
        .select(F.col("status").alias("raw_status"), clean.canonical_status("status").alias("status"))
        .groupBy("raw_status", "status")
        .agg(F.count("*").alias("n"))
    )


@query(
    "flag_amount_mismatch",
    sql("SELECT order_id, has_amount_mismatch FROM mart_customer_orders"),
)
def flag_amount_mismatch(t: Tables) -> DataFrame:
    totals = marts.join_order_totals(t.stg("orders"), t.stg("order_items"))
    return marts.flag_amount_mismatch(totals).select("order_id", "has_amount_mismatch")


@query(
    "events_cleaned",
    """SELECT event_id, user_id, event_type, ts AS "timestamp" FROM (
         SELECT *, CASE WHEN value < 1 THEN NULL ELSE event_type END AS kind FROM events)
       WHERE kind IS NOT NULL""",
)
def events_cleaned(t: Tables) -> DataFrame:
    """Events whose value is below one have lost their type and are dropped."""
    raw = t.raw("events").withColumn(
        "event_type", F.when(F.col("value") < 1, None).otherwise(F.col("event_type"))
    )
    return staging.events_cleaned(raw).select("event_id", "user_id", "event_type", "timestamp")


@query(
    "recent_window",
    sql(
        f"""SELECT order_id, created_at FROM raw_orders
            WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY"""
    ),
)
def recent_window(t: Tables) -> DataFrame:
    return (
        t.raw("orders")
        .where(f"created_at >= timestamp_ntz'{AS_OF}' - interval 7 days")
        .select("order_id", "created_at")
    )


# --- joins -----------------------------------------------------------------


@query(
    "join_customer_orders",
    sql(
        """SELECT customer_id, customer_name, customer_email, customer_region, order_id, order_status,
                  order_region, order_date, CAST(order_total AS DOUBLE) AS order_total
           FROM mart_customer_orders"""
    ),
)
def join_customer_orders(t: Tables) -> DataFrame:
    return marts.join_customer_orders(t.stg("customers"), t.stg("orders"))


@query(
    "join_order_item_totals",
    sql(
        """SELECT o.order_id, o.customer_id, o.status, o.region,
                  CAST(o.total_amount AS DOUBLE) AS total_amount, o.created_at,
                  coalesce(product_count, 0) AS products_in_order,
                  CAST(coalesce(total_items, 0) AS BIGINT) AS items_in_order,
                  CAST(coalesce(calculated_total, 0) AS DOUBLE) AS calculated_order_total
           FROM stg_orders o LEFT JOIN order_aggregates a ON o.order_id = a.order_id"""
    ),
)
def join_order_item_totals(t: Tables) -> DataFrame:
    return marts.join_order_totals(t.stg("orders"), t.stg("order_items"))


@query(
    "join_product_sales",
    sql(
        """SELECT product_id, product_name, category, CAST(list_price AS DOUBLE) AS list_price, order_id,
                  CAST(quantity AS BIGINT) AS quantity, CAST(sold_price AS DOUBLE) AS sold_price,
                  CAST(line_total AS DOUBLE) AS line_total, order_status, sale_date FROM product_sales"""
    ),
)
def join_product_sales(t: Tables) -> DataFrame:
    return marts.product_sales(t.stg("products"), t.stg("order_items"), t.stg("orders"))


FULL_NAME = "split_part(name, '#', 1) || ' ' || split_part(name, '#', 2)"


@query(
    "dim_customers",
    sql(f"SELECT customer_id, {FULL_NAME} AS full_name, email, region FROM stg_customers"),
)
def dim_customers(t: Tables) -> DataFrame:
    return marts.dim_customers(t.stg("customers"))


@query(
    "fact_orders",
    sql(
        f"""SELECT o.order_id, o.customer_id, {FULL_NAME.replace('name', 'c.name')} AS full_name, o.status,
                   CAST(o.total_amount AS DOUBLE) AS total_amount, o.created_at
            FROM stg_orders o JOIN stg_customers c ON o.customer_id = c.customer_id"""
    ),
)
def fact_orders(t: Tables) -> DataFrame:
    return marts.fact_orders(t.stg("orders"), marts.dim_customers(t.stg("customers")))


@query(
    "int_order_items_enriched",
    sql(
        """SELECT i.order_item_id, i.order_id, i.product_id, CAST(i.quantity AS BIGINT) AS quantity,
                  CAST(i.price AS DOUBLE) AS price, CAST(i.line_total AS DOUBLE) AS line_total, i.created_at,
                  p.name AS product_name, p.category, CAST(p.price AS DOUBLE) AS list_price
           FROM stg_order_items i JOIN stg_products p ON i.product_id = p.product_id"""
    ),
)
def int_order_items_enriched(t: Tables) -> DataFrame:
    return marts.order_items_enriched(t.stg("order_items"), t.stg("products"))


@query(
    "inherit_region",
    """SELECT o_orderkey AS order_id, o_custkey AS customer_id, coalesce(r_name, 'none') AS region
       FROM orders LEFT JOIN customer ON o_custkey = c_custkey
       LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def inherit_region(t: Tables) -> DataFrame:
    orders = t.given("orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.lit("none").alias("region"),
    )
    return marts.inherit_region(orders, t.raw("customers"))


@query(
    "customer_order_summary",
    sql(
        """SELECT customer_id, customer_name, total_orders, CAST(total_revenue AS DOUBLE) AS total_revenue
           FROM customer_metrics"""
    ),
)
def customer_order_summary(t: Tables) -> DataFrame:
    return marts.customer_order_summary(t.stg("customers"), t.stg("orders"))


# --- aggregations ----------------------------------------------------------


@query(
    "order_aggregates",
    sql(
        """SELECT order_id, product_count, CAST(total_items AS BIGINT) AS total_items,
                  CAST(calculated_total AS DOUBLE) AS calculated_total FROM order_aggregates"""
    ),
)
def order_aggregates(t: Tables) -> DataFrame:
    return marts.order_aggregates(t.stg("order_items"))


@query(
    "mart_customer_orders",
    sql(
        """SELECT customer_id, customer_name, customer_email, customer_region, order_id, order_status,
                  order_region, order_date, CAST(order_total AS DOUBLE) AS order_total, products_in_order,
                  CAST(items_in_order AS BIGINT) AS items_in_order,
                  CAST(calculated_order_total AS DOUBLE) AS calculated_order_total, has_amount_mismatch
           FROM mart_customer_orders"""
    ),
)
def mart_customer_orders(t: Tables) -> DataFrame:
    return t.customer_orders()


PRODUCT_METRICS = """
    SELECT product_id, product_name, category, CAST(list_price AS DOUBLE) AS list_price,
           count(DISTINCT order_id) AS orders_with_product,
           CAST(sum(quantity) AS BIGINT) AS total_units_sold,
           CAST(sum(line_total) AS DOUBLE) AS total_revenue,
           CAST(sum(sold_price) AS DOUBLE) / count(*) AS avg_selling_price,
           count(DISTINCT CASE WHEN order_status = 'completed' THEN order_id END) AS completed_orders,
           CAST(sum(CASE WHEN order_status = 'completed' THEN line_total ELSE 0 END) AS DOUBLE) AS completed_revenue,
           CAST(min(sold_price) AS DOUBLE) AS min_sold_price, CAST(max(sold_price) AS DOUBLE) AS max_sold_price,
           CAST(sum(CASE WHEN sold_price < list_price THEN list_price - sold_price ELSE 0 END) AS DOUBLE)
             / count(*) AS avg_discount,
           min(sale_date) AS first_sale_date, max(sale_date) AS last_sale_date,
           row_number() OVER (PARTITION BY category ORDER BY sum(line_total) DESC, product_id)
             AS revenue_rank_in_category
    FROM product_sales GROUP BY product_id, product_name, category, list_price"""


@query("mart_product_performance", sql(PRODUCT_METRICS))
def mart_product_performance(t: Tables) -> DataFrame:
    return marts.mart_product_performance(
        t.stg("products"), t.stg("order_items"), t.stg("orders")
    )


DAILY = """CAST(revenue_date AS VARCHAR) AS revenue_date, region, status, order_count, customer_count,
           CAST(total_revenue AS DOUBLE) AS total_revenue, avg_order_value,
           CAST(total_items_sold AS BIGINT) AS total_items_sold,
           CAST(total_products_sold AS BIGINT) AS total_products_sold"""


@query("daily_revenue", sql(f"SELECT {DAILY} FROM daily_revenue"))
def daily_revenue(t: Tables) -> DataFrame:
    return marts.daily_revenue(t.customer_orders())


RUNNING = """CAST(sum(total_revenue) OVER (PARTITION BY region ORDER BY revenue_date, status
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)"""
LAG = "lag(total_revenue, 7) OVER (PARTITION BY region, status ORDER BY revenue_date)"


@query(
    "mart_revenue",
    sql(
        f"""SELECT {DAILY}, {RUNNING} AS cumulative_revenue_by_region,
                   CAST({LAG} AS DOUBLE) AS revenue_7d_ago,
                   CASE WHEN {LAG} > 0 THEN (CAST(total_revenue AS DOUBLE) - CAST({LAG} AS DOUBLE))
                        / CAST({LAG} AS DOUBLE) * 100 END AS wow_growth_pct
            FROM daily_revenue"""
    ),
)
def mart_revenue(t: Tables) -> DataFrame:
    return marts.mart_revenue(t.customer_orders())


@query(
    "agg_conditional_distinct",
    sql(
        """SELECT product_id, count(DISTINCT CASE WHEN order_status = 'completed' THEN order_id END)
             AS completed_orders FROM product_sales GROUP BY product_id"""
    ),
)
def agg_conditional_distinct(t: Tables) -> DataFrame:
    sales = marts.product_sales(t.stg("products"), t.stg("order_items"), t.stg("orders"))
    return sales.groupBy("product_id").agg(
        F.count_distinct(F.when(F.col("order_status") == "completed", F.col("order_id"))).alias(
            "completed_orders"
        )
    )


@query(
    "agg_conditional_sum",
    sql(
        """SELECT region, CAST(sum(CASE WHEN status = 'completed' THEN total_amount ELSE 0 END) AS DOUBLE)
             AS completed_revenue FROM stg_orders GROUP BY region"""
    ),
)
def agg_conditional_sum(t: Tables) -> DataFrame:
    done = F.when(F.col("status") == "completed", F.col("total_amount")).otherwise(F.lit(0))
    return t.stg("orders").groupBy("region").agg(F.sum(done).alias("completed_revenue"))


@query(
    "agg_avg_discount",
    sql(
        """SELECT category, CAST(sum(CASE WHEN sold_price < list_price THEN list_price - sold_price
             ELSE 0 END) AS DOUBLE) / count(*) AS avg_discount FROM product_sales GROUP BY category"""
    ),
)
def agg_avg_discount(t: Tables) -> DataFrame:
    sales = marts.product_sales(t.stg("products"), t.stg("order_items"), t.stg("orders"))
    below = F.greatest(F.col("list_price") - F.col("sold_price"), F.lit(0).cast("decimal(11,2)"))
    return sales.groupBy("category").agg(
        marts.ratio(F.sum(below), F.count("*")).alias("avg_discount")
    )


@query(
    "daily_active_users",
    "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(DISTINCT user_id) AS dau FROM events GROUP BY 1",
)
def daily_active_users(t: Tables) -> DataFrame:
    return marts.daily_active_users(staging.events_cleaned(t.raw("events")))


CUSTOMER_METRICS = """customer_id, customer_name, email, region, customer_created_at, total_orders,
    CAST(total_revenue AS DOUBLE) AS total_revenue"""


@query(
    "int_customer_orders",
    sql(f"SELECT {CUSTOMER_METRICS}, first_order_date, last_order_date FROM customer_metrics"),
)
def int_customer_orders(t: Tables) -> DataFrame:
    return marts.customer_orders_metrics(t.stg("customers"), t.stg("orders"))


PRODUCT_TOTALS = """product_id, product_name, category, CAST(current_price AS DOUBLE) AS current_price,
    total_orders, CAST(total_units_sold AS BIGINT) AS total_units_sold,
    CAST(total_revenue AS DOUBLE) AS total_revenue, avg_selling_price, avg_quantity_per_order,
    first_sale_date, last_sale_date"""


@query("int_product_performance", sql(f"SELECT {PRODUCT_TOTALS} FROM product_totals"))
def int_product_performance(t: Tables) -> DataFrame:
    return marts.product_totals(t.stg("products"), t.stg("order_items"))


@query(
    "mart_customer_segments",
    sql(
        f"""SELECT {CUSTOMER_METRICS},
              CAST(total_revenue AS DOUBLE) / nullif(total_orders, 0) AS avg_order_value,
              first_order_date, last_order_date,
              date_diff('day', CAST(last_order_date AS DATE), DATE '2001-08-02') AS days_since_last_order,
              CASE WHEN total_orders = 0 THEN 'never_ordered' WHEN total_revenue >= 1500000 THEN 'vip'
                   WHEN total_orders >= 8 THEN 'loyal'
                   WHEN date_diff('day', CAST(last_order_date AS DATE), DATE '2001-08-02') <= 365 THEN 'active'
                   ELSE 'new' END AS customer_segment,
              CASE WHEN last_order_date IS NULL THEN 'unknown'
                   WHEN date_diff('day', CAST(last_order_date AS DATE), DATE '2001-08-02') <= 180 THEN 'low'
                   WHEN date_diff('day', CAST(last_order_date AS DATE), DATE '2001-08-02') <= 540 THEN 'medium'
                   ELSE 'high' END AS churn_risk
            FROM customer_metrics"""
    ),
)
def mart_customer_segments(t: Tables) -> DataFrame:
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    return marts.mart_customer_segments(t.stg("customers"), t.stg("orders"), as_of)


@query(
    "mart_product_analytics",
    sql(
        f"""WITH m AS (SELECT CAST(sum(total_revenue) AS DOUBLE) / count(*) AS mean
                       FROM product_totals WHERE total_orders > 0)
            SELECT {PRODUCT_TOTALS},
              CASE WHEN total_orders = 0 THEN 'no_sales'
                   WHEN CAST(total_revenue AS DOUBLE) / mean >= 1.5 THEN 'top_performer'
                   WHEN CAST(total_revenue AS DOUBLE) / mean >= 1.1 THEN 'good_performer'
                   WHEN CAST(total_revenue AS DOUBLE) / mean >= 0.7 THEN 'average'
                   ELSE 'underperformer' END AS performance_tier,
              rank() OVER (ORDER BY t.total_revenue DESC) AS revenue_rank,
              rank() OVER (PARTITION BY category ORDER BY t.total_revenue DESC) AS category_revenue_rank,
              CASE WHEN current_price > 0 THEN (avg_selling_price - CAST(current_price AS DOUBLE))
                   / CAST(current_price AS DOUBLE) * 100 END AS price_variance_pct
            FROM product_totals t, m"""
    ),
)
def mart_product_analytics(t: Tables) -> DataFrame:
    return marts.mart_product_analytics(t.stg("products"), t.stg("order_items"))


@query(
    "load_gate",
    sql(
        """SELECT count(*) AS n_rows, count(DISTINCT region) AS n_regions,
                  count(*) >= 15000 AND count(DISTINCT region) >= 4 AS ok FROM raw_orders"""
    ),
)
def load_gate(t: Tables) -> DataFrame:
    return marts.load_gate(t.raw("orders"), 15000, 4)


@query(
    "value_distribution",
    sql(
        """SELECT 'status' AS "column", status AS value, count(*) AS n,
                  round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM stg_orders), 1) AS pct
           FROM stg_orders GROUP BY 2
           UNION ALL
           SELECT 'region', region, count(*), round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM stg_orders), 1)
           FROM stg_orders GROUP BY 2"""
    ),
)
def value_distribution(t: Tables) -> DataFrame:
    return marts.value_distribution(t.stg("orders"), ["status", "region"])


# --- windows ---------------------------------------------------------------


@query(
    "rank_in_category",
    sql(
        f"SELECT category, product_id, total_revenue, revenue_rank_in_category FROM ({PRODUCT_METRICS})"
    ),
)
def rank_in_category(t: Tables) -> DataFrame:
    """The spread-out form of the rank, whatever the size of the products table."""
    products = t.stg("products")
    metrics = marts.product_metrics(
        marts.product_sales(products, t.stg("order_items"), t.stg("orders"))
    ).select("product_id", "total_revenue")
    named = products.select("product_id", "category").join(metrics, "product_id")
    return row_number_desc(
        named, "total_revenue", "product_id", "revenue_rank_in_category", ["category"]
    ).select("category", "product_id", "total_revenue", "revenue_rank_in_category")


@query(
    "cumulative_revenue",
    sql(
        f"""SELECT CAST(revenue_date AS VARCHAR) AS revenue_date, region, status,
                   {RUNNING} AS cumulative_revenue_by_region FROM daily_revenue"""
    ),
)
def cumulative_revenue(t: Tables) -> DataFrame:
    return marts.cumulative_revenue(marts.daily_revenue(t.customer_orders())).select(
        "revenue_date", "region", "status", "cumulative_revenue_by_region"
    )


@query(
    "lag_7_rows",
    sql(
        f"""SELECT CAST(revenue_date AS VARCHAR) AS revenue_date, region, status,
                   CAST({LAG} AS DOUBLE) AS revenue_7d_ago FROM daily_revenue"""
    ),
)
def lag_7_rows(t: Tables) -> DataFrame:
    return marts.revenue_7_rows_ago(marts.daily_revenue(t.customer_orders())).select(
        "revenue_date", "region", "status", "revenue_7d_ago"
    )


@query(
    "lag_7_days",
    sql(
        """SELECT CAST(a.revenue_date AS VARCHAR) AS revenue_date, a.region, a.status,
                  CAST(b.total_revenue AS DOUBLE) AS revenue_7d_ago
           FROM daily_revenue a LEFT JOIN daily_revenue b
             ON b.revenue_date = a.revenue_date - 7 AND a.region = b.region AND a.status = b.status"""
    ),
)
def lag_7_days(t: Tables) -> DataFrame:
    return marts.revenue_7_days_ago(marts.daily_revenue(t.customer_orders())).select(
        "revenue_date", "region", "status", "revenue_7d_ago"
    )


@query(
    "wow_growth",
    sql(
        f"""SELECT CAST(revenue_date AS VARCHAR) AS revenue_date, region, status,
                   CASE WHEN {LAG} > 0 THEN (CAST(total_revenue AS DOUBLE) - CAST({LAG} AS DOUBLE))
                        / CAST({LAG} AS DOUBLE) * 100 END AS wow_growth_pct FROM daily_revenue"""
    ),
)
def wow_growth(t: Tables) -> DataFrame:
    daily = marts.revenue_7_rows_ago(marts.daily_revenue(t.customer_orders()))
    return marts.week_growth(daily).select("revenue_date", "region", "status", "wow_growth_pct")


@query(
    "pct_of_total",
    sql(
        """SELECT status AS value, count(*) AS n,
                  round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS pct
           FROM stg_orders GROUP BY status"""
    ),
)
def pct_of_total(t: Tables) -> DataFrame:
    return marts.pct_of_total(t.stg("orders"), "status")


@query(
    "revenue_ranks",
    sql(
        """SELECT product_id, rank() OVER (ORDER BY total_revenue DESC) AS revenue_rank,
                  rank() OVER (PARTITION BY category ORDER BY total_revenue DESC) AS category_revenue_rank
           FROM product_totals"""
    ),
)
def revenue_ranks(t: Tables) -> DataFrame:
    """The spread-out form of both ranks, whatever the size of the products table."""
    totals = marts.product_totals(t.stg("products"), t.stg("order_items")).select(
        "product_id", "category", "total_revenue"
    )
    return marts.revenue_ranks(materialize(totals, "revenue")).select("product_id", "revenue_rank", "category_revenue_rank")


# --- set operations --------------------------------------------------------


@query(
    "union_append",
    sql(
        """SELECT customer_id, name, region, CAST(NULL AS VARCHAR) AS segment FROM raw_customers
           UNION ALL SELECT c_custkey, c_name, NULL, c_mktsegment FROM customer"""
    ),
)
def union_append(t: Tables) -> DataFrame:
    first = t.raw("customers").select("customer_id", "name", "region")
    second = t.given("customer").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"),
    )
    return first.unionByName(second, allowMissingColumns=True)
