"""Plans: what reaches the file scan, and what no plan may contain."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from lakeloom import suite
from lakeloom.functions.clean import dedupe_latest
from lakeloom.plans import marts, staging
from lakeloom.sources.scan import in_partition, scan

# These write and read tables while they are built; their last plan is a plain scan.
EAGER = {"storage", "streams", "records"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_columns_reach_the_scan(tables):
    text = plan(scan(tables.given("orders"), ["o_orderkey"], "o_orderstatus = 'F'"))
    assert "EqualTo(o_orderstatus,F)" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in text


def test_partition_range_reaches_the_scan(tables):
    text = plan(in_partition(tables.given("events").select("event_id", "ts"), "ts", "2024-01-15"))
    assert "GreaterThanOrEqual(ts,2024-01-15" in text and "LessThan(ts,2024-01-16" in text


def test_dedupe_limits_groups_before_the_shuffle(tables):
    """A hot key leaves each map task as one row."""
    text = plan(dedupe_latest(tables.raw("order_items"), ["order_item_id"], "created_at"))
    partial, exchange = text.find("WindowGroupLimit"), text.find("Exchange hashpartitioning")
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text
    assert text.rfind("WindowGroupLimit") > exchange > partial


def test_order_scan_reads_only_needed_columns(tables):
    text = plan(marts.daily_revenue(tables.customer_orders()))
    assert "o_orderpriority" not in text and "l_extendedprice" in text and "l_tax" not in text


def test_product_metrics_expand_nothing(tables):
    sales = marts.product_sales(
        tables.stg("products"), tables.stg("order_items"), tables.stg("orders")
    )
    assert "Expand" not in plan(marts.product_metrics(sales))


@pytest.mark.parametrize("name", [n for n, q in suite.all_queries().items() if q.area not in EAGER])
def test_no_cross_join(spark, name):
    text = plan(suite.all_queries()[name](spark, SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_no_one_task_window_over_raw_rows(spark):
    """A window without a partition key gets one row per chunk or range, whose number does not follow the rows."""
    one_task = re.compile(r"Window \[[^\n]*\n[^\n]*Sort [^\n]*\n[^\n]*Exchange SinglePartition[^\n]*\n([^\n]*)")
    summary = re.compile(r"\+- HashAggregate\(keys=\[(_chunk|_range)#\d+L?\]")
    seen = 0
    for name, query in suite.all_queries().items():
        if query.area not in EAGER:
            for below in one_task.findall(plan(query(spark, SMALL))):
                assert summary.search(below), f"{name}: {below}"
                seen += 1
    assert seen


def test_revenue_is_independent_of_partitioning(spark, tables):
    few = tables.customer_orders().coalesce(1).agg(F.sum("order_total")).first()[0]
    many = tables.customer_orders().repartition(32).agg(F.sum("order_total")).first()[0]
    assert few == many


SKEW_SETTINGS = {
    "spark.sql.shuffle.partitions": "16",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
}


@pytest.fixture
def tiny_partitions(spark):
    before = {k: spark.conf.get(k, None) for k in SKEW_SETTINGS}
    for key, value in SKEW_SETTINGS.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def hot_tables(spark, n=300_000):
    """A third of the lines on one product, a third of the orders of one customer."""
    at = "timestamp_ntz'2024-01-01' AS created_at"
    items = spark.range(n).selectExpr(
        "id AS order_item_id", "id div 3 AS order_id", "if(id % 3 = 0, 5, pmod(xxhash64(id), 900)) AS product_id",
        "1 + id % 4 AS quantity", "cast(1 + id % 7 as double) AS price", at,
    )
    orders = spark.range(n // 3).selectExpr(
        "id AS order_id", "if(id % 3 = 0, 7, pmod(xxhash64(id), 800)) AS customer_id",
        "'completed' AS status", "'north' AS region", "cast(id % 90 as double) AS total_amount", at,
    )
    products = spark.range(900).selectExpr(
        "id AS product_id", "concat('p', id) AS name", "'books' AS category", "4.0D AS price", at
    )
    customers = spark.range(800).selectExpr(
        "id AS customer_id", "concat('c#', id) AS name", "'a@b.co' AS email", "'north' AS region", at
    )
    return (
        staging.stg_products(products),
        staging.stg_order_items(items),
        staging.stg_orders(orders),
        staging.stg_customers(customers),
    )


def test_hot_keys_are_split_in_joins(spark, tiny_partitions):
    products, items, orders, customers = hot_tables(spark)
    sales = marts.product_metrics(marts.product_sales(products, items, orders))
    people = marts.join_customer_orders(customers, orders)
    detailed = marts.order_items_enriched(items, products)
    assert sales.agg(F.sum("orders_with_product"), F.max("orders_with_product")).first()[1] > 90_000
    for df in (sales, people, detailed):
        df = df.agg(F.max(F.xxhash64(*df.columns)))  # every column is computed
        df.collect()
        assert "SortMergeJoin(skew=true)" in plan(df)


def test_partitioned_write_splits_a_hot_partition(spark, tiny_partitions):
    from lakeloom.session import scratch_path
    from lakeloom.sources.layout import PartitionField
    from lakeloom.sources.datasets import Dataset

    table = Dataset(spark, scratch_path(spark, "hot"), [PartitionField("day")])
    rows = spark.range(90_000).selectExpr("id", "uuid() AS payload", "if(id % 3 = 0, 'hot', cast(id % 50 as string)) AS day")
    table.append(rows)
    files = table.rows().select("_metadata.file_path").distinct().where(F.col("file_path").contains("=hot")).count()
    assert files > 1 and table.scan().count() == 90_000


def test_product_totals_hold_no_table_of_orders(spark):
    """Lines of one order and product count as one order; no hash table is keyed by order."""
    products = spark.sql("select id as product_id, concat('p', id) as name, 'c' as category, cast(10 as decimal(10,2)) as price from range(1, 4)")
    orders = spark.createDataFrame([(1, "completed"), (2, "pending"), (3, "completed"), (4, None)], "order_id bigint, status string")
    orders = orders.selectExpr("*", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(order_id as int)) as created_at")
    lines = [(1, 1, 2, 9.0, 18.0), (1, 1, 1, 11.0, 11.0), (2, 1, 1, 10.0, 10.0), (3, 1, 5, 10.0, None), (4, 1, 1, 8.0, 8.0), (2, 2, 1, None, 4.0), (2, 2, 1, 4.0, 4.0), (9, 3, 1, 4.0, 4.0)]
    items = spark.createDataFrame(lines, "order_id bigint, product_id bigint, quantity int, price double, line_total double")
    items = items.selectExpr("order_id", "product_id", "quantity", "cast(price as decimal(10,2)) price", "cast(line_total as decimal(10,2)) line_total")
    found = marts.product_metrics(marts.product_sales(products, items, orders))
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in text.splitlines() if "Aggregate [" in x and "order_id" in x.partition("], [")[0]]
    assert found.schema["total_revenue"].dataType.simpleString() == "decimal(30,2)"
    got = {r.product_id: r for r in found.collect()}
    assert set(got) == {1, 2}
    one, two = got[1], got[2]
    assert (one.orders_with_product, one.total_units_sold, float(one.total_revenue), one.completed_orders, float(one.completed_revenue)) == (4, 10, 47.0, 2, 29.0)
    assert (one.avg_selling_price, one.avg_discount, float(one.min_sold_price), float(one.max_sold_price)) == (48.0 / 5, 3.0 / 5, 8.0, 11.0)
    assert (two.orders_with_product, two.completed_orders, float(two.completed_revenue), two.avg_discount, two.avg_selling_price) == (1, 0, 0.0, 3.0, 2.0)
