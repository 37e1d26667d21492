from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lakeloom.plans import metrics
from lakeloom.plans.cubes import CUBES, CUSTOMERS, ORDERS
from lakeloom.plans.metrics import (
    Cube,
    Dimension,
    Join,
    Measure,
    MetricError,
    Rollup,
    SecurityContext,
    SecurityError,
    cube_from_schema,
    date_range,
)
from lakeloom.session import materialize, scratch_path
from lakeloom.sources.datasets import Dataset
from lakeloom.sources.layout import PartitionField
from lakeloom.suite.semantic import frames


@pytest.fixture(scope="module")
def data(tables):
    made = frames(tables)
    return {name: made[name].cache() for name in ("orders", "customers", "products", "segments", "item_details")}


def ask(data, request, **options):
    return metrics.run(CUBES, data, request, **{"require_security": False} | options)


def rows(df):
    return [tuple(r) for r in df.collect()]


BY_STATUS = {"measures": ["Orders.count"], "dimensions": ["Orders.status"]}


@pytest.mark.parametrize(
    "request_",
    [
        {"measures": ["Nothing.count"]},
        {"measures": ["Orders.nothing"]},
        {"measures": ["Orders.count"], "dimensions": ["Orders.nothing"]},
        {"measures": ["Orders.count"], "dimensions": ["Products.category"]},
        {"measures": ["Orders.count"], "order": {"Orders.totalAmount": "desc"}},
        {**BY_STATUS, "filters": [{"member": "Orders.status", "operator": "like", "values": ["x"]}]},
        {"measures": ["Orders.count"], "timeDimensions": [{"dimension": "Orders.createdAt", "granularity": "eon"}]},
        {"measures": ["Orders.runningAmount"]},
        {"measures": ["Orders.customers", "Items.products"], "dimensions": ["Orders.status"]},
        {},
    ],
)
def test_bad_queries_are_errors(data, request_):
    with pytest.raises(MetricError):
        ask(data, request_)


@pytest.mark.parametrize(
    "make",
    [
        lambda: Measure("total", "sum"),
        lambda: Measure("total", "median", "x"),
        lambda: Measure("1st"),
        lambda: Dimension("a b", "x"),
        lambda: Cube("a-b", "t", ()),
        lambda: Join("Orders", "many_to_many", "a", "b"),
    ],
)
def test_bad_definitions_are_errors(make):
    with pytest.raises(MetricError):
        make()


def test_distinct_counts_of_texts_cannot_be_stored(data):
    cube = replace(ORDERS, measures=(Measure("kinds", "count_distinct", "status"),))
    with pytest.raises(MetricError, match="string"):
        metrics.build_rollup(cube, Rollup("r", ("kinds",), ("region",)), data["orders"])


def test_security_fails_closed(data):
    with pytest.raises(SecurityError):  # the cube has row filters, so silence is no permission
        metrics.run(CUBES, data, BY_STATUS)
    with pytest.raises(SecurityError):
        ask(data, BY_STATUS, require_security=True)
    with pytest.raises(SecurityError, match="region"):
        ask(data, BY_STATUS, security=SecurityContext("a"))
    with pytest.raises(SecurityError):  # the joined cube asks for its claim too
        cubes = {**CUBES, "Customers": replace(CUSTOMERS, row_filters=("organization_id",))}
        request = {"measures": ["Orders.count"], "dimensions": ["Customers.region"]}
        metrics.run(cubes, data, request, SecurityContext("a", claims={"region": "ASIA"}))
    late = SecurityContext("a", claims={"region": "ASIA"}, expires_at=datetime.now() - timedelta(seconds=1))
    with pytest.raises(SecurityError, match="expired"):
        ask(data, BY_STATUS, security=late)
    fine = replace(late, expires_at=datetime.now() + timedelta(hours=1))
    assert rows(ask(data, BY_STATUS, security=fine))


def test_contexts_do_not_mix(data):
    request = {"measures": ["Orders.count"], "dimensions": ["Orders.region"]}
    asia = ask(data, request, security=SecurityContext("a", claims={"region": "ASIA"}))
    europe = ask(data, request, security=SecurityContext("b", claims={"region": "EUROPE"}))
    assert {r[0] for r in rows(asia)} == {"ASIA"} and {r[0] for r in rows(europe)} == {"EUROPE"}
    everything = ask(data, request).where("Orders_region in ('ASIA', 'EUROPE')")
    assert sorted(rows(everything)) == sorted(rows(asia) + rows(europe))


def test_security_reaches_the_scan_filter(data, tables):
    """Over a written silver table a reader's claim prunes row groups."""
    written = {"orders": materialize(tables.stg("orders"), "orders")}
    asked = metrics.run(CUBES, written, BY_STATUS, SecurityContext("a", claims={"region": "ASIA"}))
    text = asked._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(region,ASIA)" in text and "ReadSchema: struct<status:string,region:string>" in text


def test_pages_differ_and_cover(data):
    request = {
        "measures": ["Orders.count"],
        "dimensions": ["Orders.customerId"],
        "order": {"Orders.count": "desc"},
    }
    whole = rows(ask(data, request))
    pages = [rows(ask(data, {**request, "limit": 30, "offset": o})) for o in range(0, len(whole) + 30, 30)]
    with pytest.raises(MetricError, match="limit"):
        ask(data, {**request, "offset": 30})
    assert sum(pages, []) == whole and pages[-1] == []
    # The same pages by key: each goes on after the last row of the one before.
    found, last = [], {}
    while page := ask(data, {**request, "limit": 30} | last).collect():
        found += page
        last = {"after": {"Orders.count": page[-1].Orders_count, "Orders.customerId": page[-1].Orders_customerId}}
    assert [tuple(r) for r in found] == [tuple(r) for r in whole]


ROLLUP_QUERIES = [
    ({"measures": ["Orders.count"]}, True),
    ({"measures": ["Orders.averageAmount"], "dimensions": ["Orders.region"]}, True),
    ({"measures": ["Orders.count"], "dimensions": ["Orders.customerId"]}, False),
    ({"measures": ["Orders.customers"]}, False),
    ({"measures": ["Orders.maxAmount"]}, False),
    ({"measures": ["Orders.count"], "timeDimensions": [{"dimension": "Orders.createdAt", "granularity": "week"}]}, True),
    ({"measures": ["Orders.count"], "timeDimensions": [{"dimension": "Orders.createdAt", "granularity": "hour"}]}, False),
    (
        {**BY_STATUS, "filters": [{"member": "Orders.createdAt", "operator": "gt", "values": ["2000-01-01"]}]},
        False,
    ),
    ({**BY_STATUS, "filters": [{"member": "Orders.region", "operator": "equals", "values": ["ASIA"]}]}, True),
    (
        {
            "measures": ["Orders.totalAmount", "Orders.count"],
            "dimensions": ["Orders.status"],
            "timeDimensions": [
                {"dimension": "Orders.createdAt", "granularity": "quarter", "dateRange": ["1996-02-10", "1999-03-04"]}
            ],
            "order": {"Orders.totalAmount": "desc"},
            "limit": 7,
        },
        True,
    ),
]


@pytest.mark.parametrize("request_,covered", ROLLUP_QUERIES)
def test_rollup_answers_equal_base_answers(data, request_, covered):
    """Where the rollup covers the query the base table is not needed at all."""
    parts = metrics.build_rollup(ORDERS, ORDERS.rollups[0], data["orders"])
    stored = {"ordersByDay": parts}
    base = sorted(rows(ask(data, request_)), key=str)
    assert sorted(rows(ask(data, request_, rollups=stored)), key=str) == base
    if covered:
        assert sorted(rows(ask({}, request_, rollups=stored)), key=str) == base
    else:
        with pytest.raises(KeyError):
            ask({}, request_, rollups=stored)


def test_sets_merge_over_any_grouping(data):
    """Distinct counts from bitmaps: over other grains, over negative and very large numbers and over several builds."""
    cube = replace(ORDERS, measures=(Measure("count"), Measure("far", "count_distinct", "(customer_id - 700) * 1000000007")), joins=(), row_filters=())
    rollup = Rollup("r", ("count", "far"), ("status", "region"), "createdAt", "month")
    cube = replace(cube, rollups=(rollup,))
    orders = data["orders"]
    halves = [metrics.build_rollup(cube, rollup, orders.where(f"order_id % 2 = {i}")) for i in (0, 1)]
    for stored in (metrics.build_rollup(cube, rollup, orders), metrics.merge_rollups(cube, rollup, halves[0].unionByName(halves[1]))):
        for request in (
            {"measures": ["Orders.far"]},
            {"measures": ["Orders.far", "Orders.count"], "dimensions": ["Orders.status"]},
            {"measures": ["Orders.far"], "timeDimensions": [{"dimension": "Orders.createdAt", "granularity": "year"}]},
            {"measures": ["Orders.count"], "dimensions": ["Orders.region"]},
            {"measures": ["Orders.far"], "filters": [{"member": "Orders.status", "operator": "equals", "values": ["none"]}]},
        ):
            got = metrics.run({"Orders": cube}, {}, request, rollups={"r": stored})
            assert sorted(rows(got), key=str) == sorted(rows(metrics.run({"Orders": cube}, data, request)), key=str)


def test_the_smallest_rollup_is_taken(data):
    stored = {r.name: metrics.build_rollup(ORDERS, r, data["orders"]) for r in ORDERS.rollups}
    count = {"measures": ["Orders.count"], "dimensions": ["Orders.status"]}
    for small in ("ordersByMonth", "ordersByCustomer"):
        sizes = {name: 1 if name == small else 10 for name in stored}
        tried = {small: stored[small], "ordersByDay": data["orders"].limit(0)}
        assert sorted(rows(ask({}, count, rollups=tried, sizes=sizes))) == sorted(rows(ask(data, count)))


def test_dimensions_of_the_many_side(data, spark):
    """A base row counts once for each value of the many side; rows without any stand under null."""
    orders = spark.createDataFrame([(1, "a", 10), (2, "a", 20), (3, "b", 40)], "order_id int, status string, total_amount int")
    items = spark.createDataFrame(
        [(1, 1, 7, "x", 2), (2, 1, 8, "x", 3), (3, 1, 7, "y", 1), (4, 2, 9, "y", 5), (5, 9, 9, "y", 5)], "order_item_id int, order_id int, product_id int, category string, quantity int"
    )
    frames_ = {"orders": orders, "item_details": items}
    request = {"measures": ["Orders.totalAmount", "Items.quantity", "Items.products"], "dimensions": ["Items.category"]}
    got = rows(ask(frames_, request))
    assert sorted(got, key=str) == sorted([("x", 10, 5, 2), ("y", 30, 6, 2), (None, 40, None, 0)], key=str)
    only = {**request, "filters": [{"member": "Items.category", "operator": "equals", "values": ["x"]}]}
    assert rows(ask(frames_, only)) == [("x", 10, 5, 2)]
    assert rows(ask(frames_, {"measures": ["Orders.count", "Items.products"]})) == [(3, 3)]


def test_sets_of_the_many_side_are_joined_as_numbers(data, spark):
    """A bitmap takes 4 KB whatever it holds, so none is made for the key of a join; negative, repeated and missing numbers count as ever."""
    orders = spark.createDataFrame([(1, "a", 10), (2, "a", 20), (3, "b", 40), (None, "b", 1)], "order_id int, status string, total_amount int")
    items = spark.createDataFrame(
        [(1, 1, 70000, "x", 2), (2, 1, -8, "x", 3), (3, 1, 70000, "x", 1), (4, 2, -8, "y", 5), (5, 2, None, "y", 5), (6, 3, None, None, 1), (7, None, 4, "x", 1)],
        "order_item_id int, order_id int, product_id int, category string, quantity int",
    )
    request = {"measures": ["Orders.totalAmount", "Items.quantity", "Items.products"], "dimensions": ["Orders.status"]}
    found = ask({"orders": orders, "item_details": items}, request)
    assert sorted(rows(found)) == [("a", 30, 16, 2), ("b", 41, 1, 0)]
    for result in (found, ask(data, {"measures": ["Customers.count", "Orders.customers"]})):
        assert "bitmap" not in result._jdf.queryExecution().optimizedPlan().toString()


def test_only_changed_folders_are_read_again(spark, data):
    orders, rule = data["orders"], ORDERS.rollups[2]
    fields = [PartitionField("created_at", "year")]
    base, table, keys = (Dataset(spark, scratch_path(spark, n), f) for n, f in (("b", fields), ("r", [PartitionField("createdAt", "year")]), ("k", [])))
    base.append(orders.where("year(created_at) <> 1997"))
    at = datetime(2024, 1, 1)
    refresh = lambda minutes: metrics.refresh_changed(table, keys, ORDERS, rule, base, "created_at", at + timedelta(minutes=minutes))
    assert "1996" in refresh(0) and refresh(40) == []
    base.append(orders.where("year(created_at) = 1997"))
    base.overwrite_partitions(orders.where("year(created_at) = 1995 and order_id % 2 = 0"))
    base._drop_folder({"_p_created_at_year": "1996"})
    assert refresh(50) == []  # younger than half an hour
    assert refresh(80) == ["1995", "1996", "1997"]
    want = orders.where("year(created_at) <> 1996 and (year(created_at) <> 1995 or order_id % 2 = 0)")
    finish = lambda parts: sorted(rows(metrics.finish_rollup(ORDERS, rule, parts)), key=str)
    assert finish(table.scan()) == finish(metrics.build_rollup(ORDERS, rule, want))
    text = metrics.base_partitions(base, ["1995"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_p_created_at_year" in text and "= 1995)" in text


def test_deltas_without_rows_and_refresh_rules(spark, data):
    table, rule = Dataset(spark, scratch_path(spark, "d"), [PartitionField("createdAt", "year")]), ORDERS.rollups[0]
    for rows_ in (data["orders"].limit(0), data["orders"], data["orders"].limit(0)):
        metrics.add_to_rollup(table, ORDERS, rule, rows_)
        metrics.refresh_rollup(table, ORDERS, rule, data["orders"], data["orders"].limit(0))
    assert table.scan().agg(F.sum("count_n")).first()[0] == data["orders"].count()
    for bad in ("soon", "0m", "5", "* * * * *"):
        with pytest.raises(MetricError):
            Rollup("r", ("count",), refresh_every=bad)


def test_weeks_do_not_add_up_to_months(data):
    parts = metrics.build_rollup(ORDERS, ORDERS.rollups[1], data["orders"])
    month = {"measures": ["Orders.count"], "timeDimensions": [{"dimension": "Orders.createdAt", "granularity": "month"}]}
    with pytest.raises(KeyError):
        ask({}, month, rollups={"ordersByWeek": parts})


def test_a_rollup_without_the_claim_column_is_not_used(data):
    parts = metrics.build_rollup(ORDERS, ORDERS.rollups[1], data["orders"])
    context = SecurityContext("a", claims={"region": "ASIA"})
    with pytest.raises(KeyError):
        ask({}, BY_STATUS, security=context, rollups={"ordersByWeek": parts})
    by_day = {"ordersByDay": metrics.build_rollup(ORDERS, ORDERS.rollups[0], data["orders"])}
    assert sorted(rows(ask({}, BY_STATUS, security=context, rollups=by_day))) == sorted(
        rows(ask(data, BY_STATUS, security=context))
    )


def test_base_measures_do_not_double_over_one_to_many(spark):
    people = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "customer_id bigint, region string")
    orders = spark.createDataFrame(
        [(1, 1, 10), (2, 1, 30), (3, 2, 5)], "order_id bigint, customer_id bigint, total_amount int"
    )
    data = {"customers": people, "orders": orders}
    request = {
        "measures": ["Customers.count", "Orders.count", "Orders.totalAmount", "Orders.averageAmount"],
        "dimensions": ["Customers.region"],
    }
    got = sorted(rows(metrics.run(CUBES, data, request, require_security=False)))
    assert got == [("x", 2, 3, 45, 15.0), ("y", 1, 0, None, None)]


def test_empty_input_counts_zero(data):
    nothing = {**data, "orders": data["orders"].limit(0)}
    assert rows(ask(nothing, {"measures": ["Orders.count", "Orders.totalAmount"]})) == [(0, None)]
    assert rows(ask(nothing, {"measures": ["Orders.completedShare"]})) == [(None,)]


def test_cube_from_schema(spark):
    schema = "id bigint, name string, at timestamp, ok boolean, amount decimal(10,2), tags array<string>"
    df = spark.createDataFrame([], schema)
    cube = cube_from_schema("T", "t", df.schema)
    assert [d.type for d in cube.dimensions] == ["number", "string", "time", "boolean", "number", "string"]
    assert [d.primary_key for d in cube.dimensions] == [True] + [False] * 5
    assert [m.type for m in cube.measures] == ["count"]


def test_date_ranges():
    as_of = datetime(2024, 3, 10, 12)
    assert date_range("last 7 days", as_of) == (datetime(2024, 3, 3, 12), as_of)
    assert date_range(["2024-01-01", "2024-01-31"], None) == (datetime(2024, 1, 1), datetime(2024, 2, 1))
    assert date_range("2024-01-05", None) == (datetime(2024, 1, 5), datetime(2024, 1, 6))
    with pytest.raises(MetricError):
        date_range("last 7 days", None)


def test_refresh_drops_nothing(spark, data):
    from lakeloom.session import scratch_path
    from lakeloom.sources.layout import PartitionField
    from lakeloom.sources.datasets import Dataset

    rollup, orders = ORDERS.rollups[0], data["orders"]
    table = Dataset(spark, scratch_path(spark, "r"), [PartitionField("createdAt", "month")])
    table.append(metrics.build_rollup(ORDERS, rollup, orders.where("order_id % 3 <> 0")))
    metrics.refresh_rollup(table, ORDERS, rollup, orders, orders.where("order_id % 3 = 0"))
    total = metrics.finish_rollup(ORDERS, rollup, table.scan()).agg(F.sum("count")).first()[0]
    assert total == orders.count()


def test_running_total_over_years_with_gaps(spark):
    data = [(1, "a", "2020-12-30", 5), (2, "a", "2021-01-02", 7), (3, "a", "2023-05-05", None), (4, None, "2021-01-01", 3)]
    orders = spark.createDataFrame(data, "order_id bigint, region string, d string, total_amount int")
    frames_ = {"orders": orders.withColumn("created_at", F.col("d").cast("timestamp_ntz"))}
    request = {
        "measures": ["Orders.runningAmount", "Orders.totalAmount"],
        "dimensions": ["Orders.region"],
        "timeDimensions": [{"dimension": "Orders.createdAt", "granularity": "day"}],
    }
    got = {(r[0], str(r[1])[:10]): (r[2], r[3]) for r in metrics.run(CUBES, frames_, request, require_security=False).collect()}
    assert got == {
        ("a", "2020-12-30"): (5, 5),
        ("a", "2021-01-02"): (12, 7),
        ("a", "2023-05-05"): (12, None),
        (None, "2021-01-01"): (3, 3),
    }
    plain = {**request, "dimensions": []}
    totals = [r[1] for r in metrics.run(CUBES, frames_, plain, require_security=False).orderBy("Orders_createdAt").collect()]
    assert totals == [5, 8, 15, 15]
