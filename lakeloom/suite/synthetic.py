"""Generated entities, sized by the given tables, and injected defects."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.operators import defects, generate, partitions
from lakeloom.operators.defects import Defects
from lakeloom.suite import draw_sql
from lakeloom.suite.base import Tables, query
from lakeloom.suite.ctes import sql
from lakeloom.suite.scalars import DAILY_SQL, WEEKLY_SQL


def ids(t: Tables, table: str, key: str) -> DataFrame:
    """Ids from one on, one per row of a given table's key."""
    return t.given(table).select((F.col(key) + 1).alias("id"))


def size(t: Tables, table: str) -> Column:
    return t.given(table).agg(F.count("*")).scalar()


@query("gen_customers", draw_sql.CUSTOMERS)
def gen_customers(t: Tables) -> DataFrame:
    return generate.customers(ids(t, "customer", "c_custkey"))


@query("gen_orders", draw_sql.ORDERS)
def gen_orders(t: Tables) -> DataFrame:
    return generate.orders(ids(t, "orders", "o_orderkey"), size(t, "customer"))


@query("gen_orders_inherited", draw_sql.ORDERS_INHERITED)
def gen_orders_inherited(t: Tables) -> DataFrame:
    """Orders that take the region of their customer."""
    return generate.orders(
        ids(t, "orders", "o_orderkey"), size(t, "customer"), inherit_customer_region=True
    )


@query("gen_products", draw_sql.PRODUCTS)
def gen_products(t: Tables) -> DataFrame:
    return generate.products(ids(t, "part", "p_partkey"))


@query("gen_order_items", draw_sql.ORDER_ITEMS)
def gen_order_items(t: Tables) -> DataFrame:
    keys = t.given("lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber") + 1).alias("id")
    ).distinct()
    return generate.order_items(keys, size(t, "orders"), size(t, "part"))


@query("gen_organizations", draw_sql.ORGANIZATIONS)
def gen_organizations(t: Tables) -> DataFrame:
    return generate.organizations(ids(t, "supplier", "s_suppkey"))


def _users(t: Tables) -> DataFrame:
    return generate.users(ids(t, "customer", "c_custkey"), n_organizations=size(t, "supplier"))


@query("gen_users", draw_sql.USERS)
def gen_users(t: Tables) -> DataFrame:
    return _users(t)


@query("gen_events", draw_sql.EVENTS)
def gen_events(t: Tables) -> DataFrame:
    return generate.events(ids(t, "events", "event_id"), size(t, "customer"))


@query("gen_subscriptions", draw_sql.SUBSCRIPTIONS)
def gen_subscriptions(t: Tables) -> DataFrame:
    return generate.subscriptions(_users(t))


@query("gen_timestamps", draw_sql.timestamps(datetime(2024, 1, 1), datetime(2024, 2, 1), DAILY_SQL))
def gen_timestamps(t: Tables) -> DataFrame:
    return generate.timestamps(
        ids(t, "events", "event_id"), datetime(2024, 1, 1), datetime(2024, 2, 1)
    )


@query("gen_stream", f"SELECT *, CAST(floor((order_id - 1) / 1000) AS BIGINT) AS batch FROM ({draw_sql.ORDERS})")
def gen_stream(t: Tables) -> DataFrame:
    """Orders in batches of a thousand with continuing ids."""
    return generate.with_batches(gen_orders_rows(t), "order_id", 1000)


def gen_orders_rows(t: Tables) -> DataFrame:
    return generate.orders(ids(t, "orders", "o_orderkey"), size(t, "customer"))


@query("gen_daily_partitions", draw_sql.daily_orders(20, WEEKLY_SQL))
def gen_daily_partitions(t: Tables) -> DataFrame:
    """A few orders for every day the order table covers, fewer on weekends."""
    keys = partitions.time_keys_of(t.given("orders"), "o_orderdate", "day")
    days = keys.select(F.to_date("partition_key").alias("day"))
    return generate.daily_orders(days, size(t, "customer"), base_count=20)


# --- defects ---------------------------------------------------------------

KEYS = ["customer_id"]
_U = {name: draw_sql.u(name, "customer_id") for name in ("null.email", "null.name", "null.region", "duplicate", "late", "late.hours")}
_HOURS = draw_sql.whole(24, 168, _U["late.hours"])


def _defects_sql(nulls: dict[str, float], duplicates: float, late: float) -> str:
    """Clean customers with cells nulled, rows doubled and times moved back, at the given rates."""
    cells = ", ".join(
        f"CASE WHEN {_U[f'null.{c}']} >= {draw_sql.number(nulls[c])} THEN {c} END AS {c}" if c in nulls else c for c in ("name", "email", "region")
    )
    at = f"CASE WHEN {_U['late']} < {draw_sql.number(late)} THEN created_at - to_hours({_HOURS}) ELSE created_at END AS created_at"
    copies = f"CASE WHEN {_U['duplicate']} < {draw_sql.number(duplicates)} THEN 2 ELSE 1 END"
    return sql(f"SELECT customer_id, {cells}, {at} FROM (SELECT *, unnest(range({copies})) AS copy FROM stg_customers)")


@query("inject_nulls", _defects_sql({"email": 0.2}, 0.0, 0.0))
def inject_nulls(t: Tables) -> DataFrame:
    rates = Defects(null_rate=0.2, null_columns=("email",))
    return defects.inject_nulls(t.stg("customers"), KEYS, rates)


@query("inject_duplicates", _defects_sql({}, 0.3, 0.0))
def inject_duplicates(t: Tables) -> DataFrame:
    return defects.inject_duplicates(t.stg("customers"), KEYS, Defects(duplicate_rate=0.3))


@query("inject_late", _defects_sql({}, 0.0, 0.25))
def inject_late(t: Tables) -> DataFrame:
    return defects.inject_late(t.stg("customers"), KEYS, Defects(late_rate=0.25))


@query("inject_all", _defects_sql({"name": 0.1, "email": 0.1, "region": 0.1}, 0.1, 0.1))
def inject_all(t: Tables) -> DataFrame:
    rates = Defects(null_rate=0.1, duplicate_rate=0.1, late_rate=0.1)
    return defects.inject(t.stg("customers"), KEYS, rates)
