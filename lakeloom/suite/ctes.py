"""Named sub-queries the checking SQL is put together from."""

from __future__ import annotations

import re

_DEFS = {
    "raw_customers": """
        SELECT c_custkey AS customer_id, c_name AS name,
               ' ' || upper(replace(c_name, '#', '.')) || '@Example.com ' AS email,
               r_name AS region,
               TIMESTAMP '1994-01-01 00:00:00' + to_days(CAST(c_custkey % 365 AS INTEGER)) AS created_at
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
        LEFT JOIN region ON n_regionkey = r_regionkey""",
    "raw_orders": """
        SELECT o_orderkey AS order_id, o_custkey AS customer_id,
               CASE o_orderstatus
                 WHEN 'F' THEN (['completed', ' Complete ', 'COMPLETED', 'completed'])[CAST(o_orderkey % 4 AS INTEGER) + 1]
                 WHEN 'O' THEN (['pending', 'Processing', 'PENDING ', 'pending'])[CAST(o_orderkey % 4 AS INTEGER) + 1]
                 WHEN 'P' THEN (['cancelled', 'Canceled', 'error', 'on_hold'])[CAST(o_orderkey % 4 AS INTEGER) + 1]
               END AS status,
               c.region, o_totalprice AS total_amount, o_orderdate AS created_at
        FROM orders LEFT JOIN raw_customers c ON o_custkey = c.customer_id""",
    "raw_products": """
        SELECT p_partkey AS product_id, ' ' || p_name AS name,
               CASE p_type WHEN 'STANDARD' THEN 'electronics' WHEN 'ECONOMY' THEN 'Clothing'
                 WHEN 'MEDIUM' THEN ' home' WHEN 'PROMO' THEN 'SPORTS' WHEN 'LARGE' THEN 'books '
                 WHEN 'SMALL' THEN 'garden' END AS category,
               p_retailprice AS price, TIMESTAMP '1994-01-01 00:00:00' AS created_at
        FROM part""",
    "raw_order_items": """
        SELECT l_orderkey * 10 + l_linenumber AS order_item_id, l_orderkey AS order_id,
               l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS quantity,
               (CAST(round(l_extendedprice * 100) AS BIGINT) // nullif(CAST(l_quantity AS BIGINT), 0)) / 100.0::DOUBLE AS price,
               l_shipdate AS created_at
        FROM lineitem""",
    "raw_events": """
        SELECT event_id, user_id, event_type, props AS properties, ts AS "timestamp", value FROM events""",
    "stg_customers": """
        SELECT customer_id, name, lower(trim(email)) AS email, region, created_at FROM (
          SELECT *, row_number() OVER (PARTITION BY customer_id
                 ORDER BY created_at DESC, name DESC, email DESC, region DESC) AS rn
          FROM raw_customers WHERE customer_id IS NOT NULL AND email IS NOT NULL AND name IS NOT NULL)
        WHERE rn = 1""",
    "stg_orders": """
        SELECT order_id, customer_id,
               CASE WHEN lower(trim(status)) IN ('completed', 'complete') THEN 'completed'
                    WHEN lower(trim(status)) IN ('pending', 'processing') THEN 'pending'
                    WHEN lower(trim(status)) IN ('cancelled', 'canceled') THEN 'cancelled'
                    WHEN lower(trim(status)) IN ('failed', 'error') THEN 'failed'
                    ELSE 'unknown' END AS status,
               region, CAST(total_amount AS DECIMAL(10,2)) AS total_amount, created_at FROM (
          SELECT *, row_number() OVER (PARTITION BY order_id
                 ORDER BY created_at DESC, customer_id DESC, status DESC, region DESC, total_amount DESC) AS rn
          FROM raw_orders WHERE order_id IS NOT NULL AND customer_id IS NOT NULL AND total_amount >= 0)
        WHERE rn = 1""",
    "stg_products": """
        SELECT product_id, trim(name) AS name,
               CASE lower(trim(category)) WHEN 'electronics' THEN 'Electronics' WHEN 'clothing' THEN 'Clothing'
                 WHEN 'home' THEN 'Home & Garden' WHEN 'sports' THEN 'Sports & Outdoors'
                 WHEN 'books' THEN 'Books' ELSE 'Other' END AS category,
               CAST(price AS DECIMAL(10,2)) AS price, created_at FROM (
          SELECT *, row_number() OVER (PARTITION BY product_id
                 ORDER BY created_at DESC, name DESC, category DESC, price DESC) AS rn
          FROM raw_products WHERE product_id IS NOT NULL AND name IS NOT NULL AND price >= 0)
        WHERE rn = 1""",
    "stg_order_items": """
        SELECT order_item_id, order_id, product_id, CAST(quantity AS INTEGER) AS quantity,
               CAST(price AS DECIMAL(10,2)) AS price,
               CAST(CAST(quantity AS INTEGER) * CAST(price AS DECIMAL(10,2)) AS DECIMAL(10,2)) AS line_total,
               created_at FROM (
          SELECT *, row_number() OVER (PARTITION BY order_item_id
                 ORDER BY created_at DESC, order_id DESC, product_id DESC, quantity DESC, price DESC) AS rn
          FROM raw_order_items
          WHERE order_item_id IS NOT NULL AND order_id IS NOT NULL AND product_id IS NOT NULL
            AND quantity > 0 AND price >= 0)
        WHERE rn = 1""",
    "order_aggregates": """
        SELECT order_id, count(DISTINCT product_id) AS product_count, sum(quantity) AS total_items,
               sum(line_total) AS calculated_total
        FROM stg_order_items GROUP BY order_id""",
    "mart_customer_orders": """
        SELECT c.customer_id, c.name AS customer_name, c.email AS customer_email, c.region AS customer_region,
               o.order_id, o.status AS order_status, o.region AS order_region, o.created_at AS order_date,
               o.total_amount AS order_total, coalesce(oa.product_count, 0) AS products_in_order,
               coalesce(oa.total_items, 0) AS items_in_order,
               coalesce(oa.calculated_total, 0) AS calculated_order_total,
               abs(o.total_amount - coalesce(oa.calculated_total, 0)) > 0.01 AS has_amount_mismatch
        FROM stg_customers c JOIN stg_orders o ON c.customer_id = o.customer_id
        LEFT JOIN order_aggregates oa ON o.order_id = oa.order_id""",
    "daily_revenue": """
        SELECT CAST(order_date AS DATE) AS revenue_date, order_region AS region, order_status AS status,
               count(DISTINCT order_id) AS order_count, count(DISTINCT customer_id) AS customer_count,
               sum(order_total) AS total_revenue,
               CAST(sum(order_total) AS DOUBLE) / count(order_total) AS avg_order_value,
               sum(items_in_order) AS total_items_sold, sum(products_in_order) AS total_products_sold
        FROM mart_customer_orders GROUP BY 1, 2, 3""",
    "product_sales": """
        SELECT p.product_id, p.name AS product_name, p.category, p.price AS list_price, oi.order_id,
               oi.quantity, oi.price AS sold_price, oi.line_total, o.status AS order_status,
               o.created_at AS sale_date
        FROM stg_products p JOIN stg_order_items oi ON p.product_id = oi.product_id
        JOIN stg_orders o ON oi.order_id = o.order_id""",
    "customer_metrics": """
        SELECT c.customer_id, c.name AS customer_name, c.email, c.region, c.created_at AS customer_created_at,
               count(o.order_id) AS total_orders, coalesce(sum(o.total_amount), 0) AS total_revenue,
               min(o.created_at) AS first_order_date, max(o.created_at) AS last_order_date
        FROM stg_customers c LEFT JOIN stg_orders o ON c.customer_id = o.customer_id
        GROUP BY 1, 2, 3, 4, 5""",
    "product_totals": """
        SELECT p.product_id, p.name AS product_name, p.category, p.price AS current_price,
               count(DISTINCT i.order_id) AS total_orders, coalesce(sum(i.quantity), 0) AS total_units_sold,
               coalesce(sum(i.line_total), 0) AS total_revenue,
               CAST(sum(i.price) AS DOUBLE) / nullif(count(i.price), 0) AS avg_selling_price,
               CAST(sum(i.quantity) AS DOUBLE) / nullif(count(DISTINCT i.order_id), 0) AS avg_quantity_per_order,
               min(i.created_at) AS first_sale_date, max(i.created_at) AS last_sale_date
        FROM stg_products p LEFT JOIN stg_order_items i ON p.product_id = i.product_id
        GROUP BY 1, 2, 3, 4""",
}


def define(name: str, body: str) -> None:
    _DEFS[name] = body


def _needs(body: str) -> list[str]:
    return [n for n in _DEFS if re.search(rf"\b{n}\b", body)]


def sql(body: str) -> str:
    """Prefix a query with the sub-queries it uses, each defined once."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for needed in _needs(_DEFS[name]):
            if needed != name:
                visit(needed)
        ordered.append(name)

    for name in _needs(body):
        visit(name)
    if not ordered:
        return body.strip()
    parts = ", ".join(f"{n} AS ({_DEFS[n].strip()})" for n in ordered)
    joiner = ", " if body.lstrip().upper().startswith("WITH ") else " "
    rest = body.strip()[5:] if joiner == ", " else body.strip()
    return f"WITH {parts}{joiner}{rest}"
