"""Synthetic entities: one row per id, every column a draw from the id."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions.draws import draw, draw_cents, draw_int, draw_time, pick, weighted
from lakeloom.functions.temporal import (
    PEAK_HOURS,
    adjusted_count,
    daily_factor,
    trend_factor,
    weekly_factor,
)
from lakeloom.operators.sessions import sessionize

# Relative frequency of each value.
STATUS_WEIGHTS = {"completed": 60, "processing": 20, "pending": 15, "cancelled": 5}
REGION_WEIGHTS = {"north": 25, "south": 25, "east": 25, "west": 25}
PLAN_WEIGHTS = {"free": 50, "starter": 25, "pro": 20, "enterprise": 5}
SUBSCRIPTION_WEIGHTS = {"active": 70, "trial": 15, "churned": 10, "cancelled": 3, "past_due": 2}
EVENT_WEIGHTS = {
    "page_view": 50,
    "feature_use": 25,
    "api_call": 15,
    "login": 5,
    "logout": 3,
    "signup": 1,
    "upgrade": 0.5,
    "downgrade": 0.5,
}

# Monthly price of each plan.
PLAN_MRR = {"free": 0.0, "starter": 19.0, "pro": 49.0, "enterprise": 199.0}

# Attribute values of generated entities.
CATEGORIES = ["electronics", "clothing", "home", "sports", "books"]
INDUSTRIES = ["technology", "finance", "healthcare", "retail", "manufacturing", "education"]
SIZES = ["startup", "small", "medium", "large", "enterprise"]
PAGES = ["/dashboard", "/settings", "/billing", "/reports", "/profile"]
REFERRERS = ["direct", "search", "social", "email"]
FEATURES = ["export", "filter", "chart", "share", "notification"]
ENDPOINTS = ["/api/v1/data", "/api/v1/users", "/api/v1/reports"]
STATUS_CODES = {"200": 3, "201": 1, "400": 1, "401": 1, "500": 1}
PRODUCT_NOUNS = {
    "electronics": ["Phone", "Tablet", "Laptop", "Headphones", "Speaker"],
    "clothing": ["T-Shirt", "Jacket", "Pants", "Dress", "Shoes"],
    "home": ["Lamp", "Chair", "Table", "Rug", "Pillow"],
    "sports": ["Ball", "Racket", "Weights", "Mat", "Gear"],
    "books": ["Guide", "Story", "Manual", "Handbook", "Journey"],
}

# Our own small word lists.
FIRST = "Ada Ben Chi Dora Emil Fay Gus Hana Ivo June Kai Lena Milo Nora Otis Pia Quin Rosa".split()
LAST = "Abel Brook Cole Dahl Eames Frost Gale Holt Irwin Jarvis Kerr Lund Marsh Nash Olsen".split()
WORDS = "amber birch cedar delta ember fjord glade haven inlet jade kelp lumen mesa north".split()
HOSTS = ["example.com", "example.org", "example.net"]
AGENTS = ["desktop/1.0", "mobile/1.0", "tablet/1.0", "api-client/1.0"]

START, END = datetime(2023, 1, 1), datetime(2025, 1, 1)


def id_range(spark: SparkSession, count: int, start: int = 1) -> DataFrame:
    return spark.range(start, start + count)


def _person(seed: int, entity: str) -> tuple[Column, Column]:
    first = pick(FIRST, draw(seed, f"{entity}.first", "id"))
    last = pick(LAST, draw(seed, f"{entity}.last", "id"))
    host = pick(HOSTS, draw(seed, f"{entity}.host", "id"))
    local = F.concat_ws(".", F.lower(first), F.lower(last), F.col("id").cast("string"))
    return F.concat_ws(" ", first, last), F.concat(local, F.lit("@"), host)


def _customer_region(seed: int, customer_id: Column, weights: Mapping[str, float]) -> Column:
    return weighted(weights, draw(seed, "customers.region", customer_id))


def customers(
    ids: DataFrame,
    seed: int = 42,
    region_weights: Mapping[str, float] = REGION_WEIGHTS,
    start: datetime = START,
    end: datetime = END,
) -> DataFrame:
    name, email = _person(seed, "customers")
    return ids.select(
        F.col("id").alias("customer_id"),
        name.alias("name"),
        email.alias("email"),
        _customer_region(seed, F.col("id"), region_weights).alias("region"),
        draw_time(start, end, draw(seed, "customers.created", "id")).alias("created_at"),
    )


def orders(
    ids: DataFrame,
    n_customers: int | Column,
    seed: int = 42,
    first_customer: int = 1,
    status_weights: Mapping[str, float] = STATUS_WEIGHTS,
    region_weights: Mapping[str, float] = REGION_WEIGHTS,
    amounts: tuple[float, float] = (10.0, 1000.0),
    start: datetime = START,
    end: datetime = END,
    inherit_customer_region: bool = False,
) -> DataFrame:
    """An inherited region is drawn again from the customer id, so no join is needed."""
    last = F.lit(n_customers) + (first_customer - 1)
    customer = draw_int(F.lit(first_customer), last, draw(seed, "orders.customer", "id"))
    region = (
        _customer_region(seed, F.col("customer_id"), region_weights)
        if inherit_customer_region
        else weighted(region_weights, draw(seed, "orders.region", "id"))
    )
    rows = ids.withColumn("customer_id", customer)
    return rows.select(
        F.col("id").alias("order_id"),
        "customer_id",
        weighted(status_weights, draw(seed, "orders.status", "id")).alias("status"),
        region.alias("region"),
        draw_cents(*amounts, draw(seed, "orders.amount", "id")).alias("total_amount"),
        draw_time(start, end, draw(seed, "orders.created", "id")).alias("created_at"),
    )


def products(
    ids: DataFrame,
    seed: int = 42,
    prices: tuple[float, float] = (5.0, 500.0),
    start: datetime = START,
    end: datetime = END,
) -> DataFrame:
    category = F.col("category")
    noun = F.lit(None).cast("string")
    for kind, nouns in PRODUCT_NOUNS.items():
        noun = F.when(category == kind, pick(nouns, draw(seed, "products.noun", "id"))).otherwise(noun)
    word = F.initcap(pick(WORDS, draw(seed, "products.word", "id")))
    code = draw_int(100, 999, draw(seed, "products.code", "id")).cast("string")
    return ids.withColumn("category", pick(CATEGORIES, draw(seed, "products.category", "id"))).select(
        F.col("id").alias("product_id"),
        F.concat_ws(" ", word, noun).alias("name"),
        "category",
        draw_cents(*prices, draw(seed, "products.price", "id")).alias("price"),
        F.concat_ws("-", F.upper(F.substring("category", 1, 3)), code).alias("sku"),
        draw_time(start, end, draw(seed, "products.created", "id")).alias("created_at"),
    )


def order_items(
    ids: DataFrame,
    n_orders: int | Column,
    n_products: int | Column,
    seed: int = 42,
    first_order: int = 1,
    first_product: int = 1,
    quantities: tuple[int, int] = (1, 5),
    discounts: tuple[float, float] = (0.0, 50.0),
    start: datetime = START,
    end: datetime = END,
) -> DataFrame:
    def foreign(first: int, n: int | Column, name: str) -> Column:
        return draw_int(F.lit(first), F.lit(n) + (first - 1), draw(seed, name, "id"))

    price = draw_cents(5.0, 500.0, draw(seed, "items.price", "id"))
    discount = draw_cents(*discounts, draw(seed, "items.discount", "id"))
    rows = ids.select(
        F.col("id").alias("order_item_id"),
        foreign(first_order, n_orders, "items.order").alias("order_id"),
        foreign(first_product, n_products, "items.product").alias("product_id"),
        draw_int(*quantities, draw(seed, "items.quantity", "id")).alias("quantity"),
        price.alias("price"),
        discount.alias("discount"),
        draw_time(start, end, draw(seed, "items.created", "id")).alias("created_at"),
    )
    subtotal = F.round(F.col("quantity") * F.col("price") - F.col("discount"), 2)
    return rows.withColumn("subtotal", subtotal)


def organizations(ids: DataFrame, seed: int = 42) -> DataFrame:
    words = [F.initcap(pick(WORDS, draw(seed, f"orgs.word{i}", "id"))) for i in (1, 2)]
    return ids.select(
        F.col("id").alias("organization_id"),
        F.concat_ws(" ", *words).alias("name"),
        pick(INDUSTRIES, draw(seed, "orgs.industry", "id")).alias("industry"),
        pick(SIZES, draw(seed, "orgs.size", "id")).alias("size"),
    )


def users(
    ids: DataFrame,
    seed: int = 42,
    n_organizations: int | Column | None = None,
    plan_weights: Mapping[str, float] = PLAN_WEIGHTS,
    start: datetime = START,
    end: datetime = END,
) -> DataFrame:
    name, email = _person(seed, "users")
    organization = (
        F.lit(None).cast("bigint")
        if n_organizations is None
        else draw_int(F.lit(1), F.lit(n_organizations), draw(seed, "users.org", "id"))
    )
    signup = draw_time(start, end, draw(seed, "users.signup", "id"))
    until = F.lit(str(end)).cast("timestamp_ntz")
    return ids.withColumn("signup_date", signup).select(
        F.col("id").alias("user_id"),
        email.alias("email"),
        name.alias("name"),
        weighted(plan_weights, draw(seed, "users.plan", "id")).alias("plan"),
        organization.alias("organization_id"),
        "signup_date",
        draw_time(F.col("signup_date"), until, draw(seed, "users.active", "id")).alias("last_active_at"),
    )


def _properties(seed: int) -> Column:
    def u(name: str) -> Column:
        return draw(seed, f"events.{name}", "id")

    kind = F.col("event_type")
    plans = list(PLAN_MRR)
    by_kind = {
        "page": ("page_view", pick(PAGES, u("page"))),
        "referrer": ("page_view", pick(REFERRERS, u("referrer"))),
        "feature": ("feature_use", pick(FEATURES, u("feature"))),
        "duration_ms": ("feature_use", draw_int(100, 30000, u("duration"))),
        "endpoint": ("api_call", pick(ENDPOINTS, u("endpoint"))),
        "status_code": ("api_call", weighted(STATUS_CODES, u("code")).cast("int")),
        "latency_ms": ("api_call", draw_int(10, 500, u("latency"))),
        "from_plan": ("upgrade downgrade", pick(plans, u("from"))),
        "to_plan": ("upgrade downgrade", pick(plans, u("to"))),
    }
    fields = [
        F.when(kind.isin(*kinds.split()), value).alias(name)
        for name, (kinds, value) in by_kind.items()
    ]
    return F.to_json(F.struct(*fields, pick(AGENTS, u("agent")).alias("user_agent")))


def events(
    ids: DataFrame,
    n_users: int | Column,
    seed: int = 42,
    first_user: int = 1,
    type_weights: Mapping[str, float] = EVENT_WEIGHTS,
    start: datetime = START,
    end: datetime = END,
) -> DataFrame:
    """Activity with JSON properties and a session id carried from login to logout."""
    last = F.lit(n_users) + (first_user - 1)
    kind = weighted(type_weights, draw(seed, "events.type", "id"))
    rows = ids.withColumn("event_type", kind).select(
        F.col("id").alias("event_id"),
        draw_int(F.lit(first_user), last, draw(seed, "events.user", "id")).alias("user_id"),
        "event_type",
        _properties(seed).alias("properties"),
        draw_time(start, end, draw(seed, "events.time", "id")).alias("timestamp"),
    )
    return sessionize(rows)


def trial_end(status: Column, started_at: Column) -> Column:
    return F.when(status == "trial", started_at + F.expr("interval 14 days"))


def subscriptions(
    user_rows: DataFrame,
    seed: int = 42,
    status_weights: Mapping[str, float] = SUBSCRIPTION_WEIGHTS,
    start: datetime = START,
    end: datetime = END,
) -> DataFrame:
    """One subscription per user, priced by the user's plan."""
    mrr = F.create_map(*[F.lit(v) for pair in PLAN_MRR.items() for v in pair])
    until = F.lit(str(end)).cast("timestamp_ntz")
    started = draw_time(start, end, draw(seed, "subs.start", "user_id"))
    rows = user_rows.select("user_id", "plan").withColumns(
        {
            "status": weighted(status_weights, draw(seed, "subs.status", "user_id")),
            "started_at": started,
        }
    )
    ended = draw_time(F.col("started_at"), until, draw(seed, "subs.end", "user_id"))
    return rows.select(
        F.col("user_id").alias("subscription_id"),
        "user_id",
        "plan",
        mrr[F.col("plan")].alias("mrr"),
        "status",
        "started_at",
        F.when(F.col("status").isin("churned", "cancelled"), ended).alias("ended_at"),
        trial_end(F.col("status"), F.col("started_at")).alias("trial_ends_at"),
    )


def timestamps(
    ids: DataFrame, start: datetime, end: datetime, seed: int = 42, peaks: tuple = PEAK_HOURS
) -> DataFrame:
    """Instants pulled toward the peak hours, in order."""
    ts = draw_time(start, end, draw(seed, "times.at", "id"))
    kept = draw(seed, "times.keep", "id") < daily_factor(F.hour("ts"), peaks)
    hour = pick([str(p) for p in peaks], draw(seed, "times.peak", "id")).cast("int")
    minute = draw_int(0, 59, draw(seed, "times.minute", "id")).cast("int")
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    moved = day + F.make_dt_interval(F.lit(0), hour, minute, F.second("ts").cast("decimal(18,6)"))
    return (
        ids.withColumn("ts", ts).select("id", F.when(kept, F.col("ts")).otherwise(moved).alias("ts"))
    ).orderBy("ts", "id")


def with_batches(rows: DataFrame, id_column: str, batch_size: int, first_id: int = 1) -> DataFrame:
    """Number of the batch a row would be streamed in."""
    return rows.withColumn("batch", F.floor((F.col(id_column) - first_id) / batch_size))


def daily_orders(
    days: DataFrame,
    n_customers: int | Column,
    base_count: int = 1000,
    seed: int = 42,
    monthly_trend: float = 0.0,
    noise: float = 0.1,
    base: date = date(2024, 1, 1),
) -> DataFrame:
    """Orders of every day in ``days(day)``, as many as the day's factors ask for."""
    day = F.col("day")
    wobble = 1.0 + (draw(seed, "daily.noise", day) * 2 - 1) * noise
    factor = weekly_factor(F.weekday(day)) * trend_factor(day, monthly_trend, base) * wobble
    spread = days.repartition("day")  # a day table often sits in one partition
    rows = spread.select("day", F.explode(F.sequence(F.lit(1), adjusted_count(base_count, factor))).alias("n"))
    key = ("day", "n")
    second = draw_int(0, 86399, draw(seed, "daily.second", *key)).cast("decimal(18,6)")
    return rows.select(
        F.date_format("day", "yyyy-MM-dd").alias("partition_key"),
        (F.unix_date("day").cast("bigint") * 10_000_000 + F.col("n")).alias("order_id"),
        draw_int(F.lit(1), F.lit(n_customers), draw(seed, "daily.customer", *key)).alias("customer_id"),
        weighted(STATUS_WEIGHTS, draw(seed, "daily.status", *key)).alias("status"),
        draw_cents(10.0, 1000.0, draw(seed, "daily.amount", *key)).alias("total_amount"),
        (
            day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), second)
        ).alias("created_at"),
    )
