from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from lakeloom.functions.draws import draw, draw_int, weighted
from lakeloom.functions.temporal import adjusted_count
from lakeloom.operators import defects, generate, quality
from lakeloom.operators.defects import Defects

N = 4000


def ids(spark, n=N, parts=4):
    return generate.id_range(spark, n).repartition(parts)


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


MAKERS = {
    "customers": lambda i, seed: generate.customers(i, seed),
    "orders": lambda i, seed: generate.orders(i, 500, seed),
    "products": lambda i, seed: generate.products(i, seed),
    "order_items": lambda i, seed: generate.order_items(i, 900, 70, seed),
    "organizations": lambda i, seed: generate.organizations(i, seed),
    "users": lambda i, seed: generate.users(i, seed, n_organizations=40),
    "events": lambda i, seed: generate.events(i, 60, seed),
    "subscriptions": lambda i, seed: generate.subscriptions(generate.users(i, seed), seed),
}


@pytest.mark.parametrize("name", list(MAKERS))
def test_same_rows_for_any_partitioning_and_other_rows_for_other_seeds(spark, name):
    make = MAKERS[name]
    rows = make(ids(spark, 800, 2), 42)
    assert same(rows, make(ids(spark, 800, 7), 42))
    assert not same(rows, make(ids(spark, 800, 2), 43))
    assert rows.count() == 800


def test_entities_keep_their_rules(spark):
    users = MAKERS["users"](ids(spark), 42)
    for rows, rules in [
        (MAKERS["customers"](ids(spark), 42), quality.customer_rules()),
        (MAKERS["orders"](ids(spark), 42), quality.order_rules()),
        (MAKERS["products"](ids(spark), 42), quality.product_rules()),
        (MAKERS["order_items"](ids(spark), 42), quality.order_item_rules()),
        (users, quality.user_rules()),
        (MAKERS["events"](ids(spark), 42), quality.event_rules()),
        (generate.subscriptions(users), quality.subscription_rules()),
    ]:
        bad = quality.rule_counts(rows, rules).where("n_failed > 0").collect()
        assert bad == []


def test_ranges_and_foreign_keys(spark):
    orders = MAKERS["orders"](ids(spark), 42)
    row = orders.agg(
        F.min("customer_id"), F.max("customer_id"), F.min("total_amount"), F.max("total_amount"),
        F.count_distinct("customer_id"),
    ).first()
    assert row[0] >= 1 and row[1] <= 500 and row[2] >= 10 and row[3] <= 1000 and row[4] > 480
    items = MAKERS["order_items"](ids(spark), 42)
    assert items.where(
        "quantity not between 1 and 5 or discount not between 0 and 50 or product_id > 70"
        " or abs(subtotal - (quantity * price - discount)) > 0.006"
    ).isEmpty()
    shifted = generate.orders(ids(spark), 10, first_customer=101)
    assert shifted.where("customer_id not between 101 and 110").isEmpty()


def test_inherited_region_is_the_customers(spark):
    people = generate.customers(ids(spark, 500), 7)
    orders = generate.orders(ids(spark), 500, 7, inherit_customer_region=True)
    both = orders.join(people.select("customer_id", F.col("region").alias("own")), "customer_id")
    assert both.count() == N and both.where("region <> own").isEmpty()


@pytest.mark.parametrize(
    "weights", [generate.STATUS_WEIGHTS, generate.PLAN_WEIGHTS, generate.EVENT_WEIGHTS, {"only": 3}]
)
def test_weights_hold(spark, weights):
    n = 20000
    got = dict(
        spark.range(n).groupBy(weighted(weights, draw(1, "w", "id")).alias("v")).count().collect()
    )
    total = sum(weights.values())
    assert set(got) <= set(weights)
    for value, weight in weights.items():
        expected = n * weight / total
        assert abs(got.get(value, 0) - expected) < 5 * expected**0.5 + 5


def test_draws_are_uniform_and_independent(spark):
    df = spark.range(20000).select(draw(1, "a", "id").alias("a"), draw(1, "b", "id").alias("b"))
    row = df.agg(F.avg("a"), F.stddev("a"), F.corr("a", "b"), F.min("a"), F.max("a")).first()
    assert abs(row[0] - 0.5) < 0.01 and abs(row[1] - 0.2887) < 0.01 and abs(row[2]) < 0.03
    assert 0 <= row[3] and row[4] < 1
    dice = spark.range(6000).groupBy(draw_int(1, 6, draw(2, "d", "id")).alias("d")).count().collect()
    assert sorted(r.d for r in dice) == [1, 2, 3, 4, 5, 6]


def test_users_and_subscriptions(spark):
    users = MAKERS["users"](ids(spark), 42)
    assert users.where("last_active_at < signup_date or organization_id is null").isEmpty()
    assert generate.users(ids(spark)).where("organization_id is not null").isEmpty()
    subs = generate.subscriptions(users)
    assert subs.join(users, ["user_id", "plan"]).count() == N
    assert subs.where(
        "(status in ('churned', 'cancelled')) <> (ended_at is not null) or ended_at < started_at"
        " or (status = 'trial') <> (trial_ends_at is not null)"
        " or trial_ends_at <> started_at + interval 14 days"
    ).isEmpty()
    prices = {r.plan: r.mrr for r in subs.select("plan", "mrr").distinct().collect()}
    assert prices == generate.PLAN_MRR


def test_event_properties_fit_their_type(spark):
    events = MAKERS["events"](ids(spark), 42)
    kinds = {"page": "page_view", "feature": "feature_use", "endpoint": "api_call"}
    for key, kind in kinds.items():
        has = F.get_json_object("properties", f"$.{key}").isNotNull()
        assert events.where(has != (F.col("event_type") == kind)).isEmpty()
    assert events.where("session_id is null and event_type = 'login'").isEmpty()


def test_timestamps_prefer_peaks_and_are_sorted(spark):
    start, end = datetime(2024, 1, 1), datetime(2024, 2, 1)
    rows = generate.timestamps(ids(spark), start, end).collect()
    times = [r.ts for r in rows]
    assert times == sorted(times) and start <= times[0] and times[-1] < datetime(2024, 2, 2)
    peak = sum(t.hour in (10, 14, 18, 21) for t in times) / N
    night = sum(t.hour < 6 for t in times) / N
    assert peak > 0.4 and night < 0.05


def test_daily_counts_follow_the_factors(spark):
    days = spark.range(60).selectExpr("date_add(date'2024-01-01', cast(id as int)) AS day")
    rows = generate.daily_orders(days, 50, base_count=100, noise=0.0)
    counts = {r.partition_key: r["count"] for r in rows.groupBy("partition_key").count().collect()}
    assert counts["2024-01-01"] == 90 and counts["2024-01-02"] == 100 and counts["2024-01-06"] == 30
    assert rows.where("date_format(created_at, 'yyyy-MM-dd') <> partition_key").isEmpty()
    assert rows.count() == rows.select("order_id").distinct().count()
    grown = generate.daily_orders(days, 50, 100, monthly_trend=0.5, noise=0.0, base=date(2024, 1, 1))
    assert grown.where("partition_key = '2024-02-01'").count() == 150
    noisy = generate.daily_orders(days, 50, 1000, noise=0.1).where("partition_key = '2024-01-02'").count()
    assert 900 <= noisy <= 1100


def test_adjusted_count_is_at_least_one(spark):
    assert spark.range(1).select(adjusted_count(10, F.lit(0.001))).first()[0] == 1


def test_batches_continue_their_ids(spark):
    rows = generate.with_batches(MAKERS["orders"](ids(spark), 42), "order_id", 1000)
    got = rows.groupBy("batch").agg(F.min("order_id"), F.max("order_id"), F.count("*")).orderBy("batch")
    assert [tuple(r) for r in got.collect()] == [(b, b * 1000 + 1, b * 1000 + 1000, 1000) for b in range(4)]


# --- defects ---------------------------------------------------------------


@pytest.fixture(scope="module")
def clean(spark):
    return generate.customers(ids(spark), 42).cache()


def test_zero_rates_change_nothing(clean):
    assert same(defects.inject(clean, ["customer_id"], Defects()), clean)


def test_full_rates_change_everything(clean):
    rows = defects.inject(clean, ["customer_id"], Defects(1.0, ("email",), 1.0, 1.0))
    assert rows.count() == 2 * N and rows.where("email is not null or name is null").isEmpty()


@pytest.mark.parametrize("rate", [0.2, 0.5])
def test_rates_hold(clean, rate):
    keys = ["customer_id"]
    nulls = defects.inject_nulls(clean, keys, Defects(null_rate=rate, null_columns=("email",)))
    tolerance = 5 * (N * rate * (1 - rate)) ** 0.5
    assert abs(nulls.where("email is null").count() - N * rate) < tolerance
    assert nulls.where("name is null or region is null").isEmpty()
    twice = defects.inject_duplicates(clean, keys, Defects(duplicate_rate=rate))
    assert abs(twice.count() - N * (1 + rate)) < tolerance and twice.distinct().count() == N
    late = defects.inject_late(clean, keys, Defects(late_rate=rate)).withColumnRenamed("created_at", "moved")
    hours = F.timestamp_diff("HOUR", "moved", "created_at")
    both = late.join(clean.select("customer_id", "created_at"), "customer_id").withColumn("h", hours)
    assert abs(both.where("h <> 0").count() - N * rate) < tolerance
    assert both.where("h <> 0 and h not between 24 and 168").isEmpty()


def test_defaults_and_missing_columns(clean):
    rows = defects.inject_nulls(clean, ["customer_id"], Defects(null_rate=1.0))
    assert rows.where("name is not null or email is not null or region is not null").isEmpty()
    assert rows.where("created_at is null").isEmpty()
    other = Defects(late_rate=1.0, timestamp_column="no_such_column")
    assert same(defects.inject_late(clean, ["customer_id"], other), clean)
    nothing = clean.withColumn("created_at", F.lit(None).cast("timestamp_ntz"))
    assert same(defects.inject_late(nothing, ["customer_id"], Defects(late_rate=1.0)), nothing)


def test_defects_depend_on_the_seed_only(clean):
    rates = Defects(0.3, (), 0.3, 0.3)
    first = defects.inject(clean, ["customer_id"], rates, 42)
    assert same(first, defects.inject(clean.repartition(9), ["customer_id"], rates, 42))
    assert not same(first, defects.inject(clean, ["customer_id"], rates, 99))


def test_bad_rates_are_errors():
    for bad in [{"null_rate": 1.5}, {"late_rate": -0.1}, {"late_hours": (5, 2)}]:
        with pytest.raises(ValueError):
            Defects(**bad)
