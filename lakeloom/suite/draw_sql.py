"""The draws of ``functions.draws`` and the generators' columns as SQL text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from lakeloom.operators import generate as g


def number(value: float) -> str:
    """A double literal."""
    return f"{value!r}e0"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def u(name: str, *ids: str, seed: int = 42) -> str:
    joined = " || '|' || ".join([f"'{seed}|{name}'", *[f"CAST({i} AS VARCHAR)" for i in ids]])
    return f"(('0x' || substr(md5({joined}), 1, 13))::BIGINT / 4503599627370496.0e0)"


def whole(low: int | str, high: int | str, draw: str) -> str:
    return f"CAST(floor(({low}) + {draw} * (({high}) - ({low}) + 1)) AS BIGINT)"


def cents(low: float, high: float, draw: str) -> str:
    return f"({whole(round(low * 100), round(high * 100), draw)} / 100.0e0)"


def pick(values: Sequence[str], draw: str) -> str:
    return f"([{', '.join(map(text, values))}])[CAST(floor({draw} * {len(values)}) AS INTEGER) + 1]"


def weighted(weights: Mapping[str, float], draw: str) -> str:
    total, reached, steps = float(sum(weights.values())), 0.0, ""
    *head, last = weights
    for value in head:
        reached += weights[value]
        steps += f" WHEN {draw} < {number(reached / total)} THEN {text(value)}"
    return f"CASE{steps} ELSE {text(last)} END"


def at(start: datetime | str, end: datetime | str, draw: str) -> str:
    start, end = (f"TIMESTAMP '{v}'" if isinstance(v, datetime) else v for v in (start, end))
    seconds = f"floor({draw} * (date_diff('microsecond', {start}, {end}) // 1000000 + 1))"
    return f"({start} + to_seconds(CAST({seconds} AS BIGINT)))"


def capital(value: str) -> str:
    return f"(upper(substr({value}, 1, 1)) || substr({value}, 2))"


def person(entity: str) -> tuple[str, str]:
    first, last, host = (pick(v, u(f"{entity}.{n}", "id")) for v, n in ((g.FIRST, "first"), (g.LAST, "last"), (g.HOSTS, "host")))
    name = f"({first} || ' ' || {last})"
    return name, f"(lower({first}) || '.' || lower({last}) || '.' || id || '@' || {host})"


_NAME, _EMAIL = person("customers")
CUSTOMERS = f"""SELECT id AS customer_id, {_NAME} AS name, {_EMAIL} AS email,
    {weighted(g.REGION_WEIGHTS, u("customers.region", "id"))} AS region,
    {at(g.START, g.END, u("customers.created", "id"))} AS created_at
    FROM (SELECT c_custkey + 1 AS id FROM customer)"""


def orders(region: str) -> str:
    return f"""SELECT id AS order_id, customer_id, {weighted(g.STATUS_WEIGHTS, u("orders.status", "id"))} AS status,
    {weighted(g.REGION_WEIGHTS, region)} AS region, {cents(10.0, 1000.0, u("orders.amount", "id"))} AS total_amount,
    {at(g.START, g.END, u("orders.created", "id"))} AS created_at
    FROM (SELECT id, {whole(1, "(SELECT count(*) FROM customer)", u("orders.customer", "id"))} AS customer_id
          FROM (SELECT o_orderkey + 1 AS id FROM orders))"""


ORDERS = orders(u("orders.region", "id"))
ORDERS_INHERITED = orders(u("customers.region", "customer_id"))

_NOUN = "CASE category" + "".join(
    f" WHEN {text(kind)} THEN {pick(nouns, u('products.noun', 'id'))}" for kind, nouns in g.PRODUCT_NOUNS.items()
) + " END"
PRODUCTS = f"""SELECT id AS product_id, {capital(pick(g.WORDS, u("products.word", "id")))} || ' ' || {_NOUN} AS name, category,
    {cents(5.0, 500.0, u("products.price", "id"))} AS price,
    upper(substr(category, 1, 3)) || '-' || {whole(100, 999, u("products.code", "id"))} AS sku,
    {at(g.START, g.END, u("products.created", "id"))} AS created_at
    FROM (SELECT id, {pick(g.CATEGORIES, u("products.category", "id"))} AS category FROM (SELECT p_partkey + 1 AS id FROM part))"""

ORDER_ITEMS = f"""SELECT *, round(quantity * price - discount, 2) AS subtotal FROM (SELECT id AS order_item_id,
    {whole(1, "(SELECT count(*) FROM orders)", u("items.order", "id"))} AS order_id,
    {whole(1, "(SELECT count(*) FROM part)", u("items.product", "id"))} AS product_id,
    {whole(1, 5, u("items.quantity", "id"))} AS quantity, {cents(5.0, 500.0, u("items.price", "id"))} AS price,
    {cents(0.0, 50.0, u("items.discount", "id"))} AS discount, {at(g.START, g.END, u("items.created", "id"))} AS created_at
    FROM (SELECT DISTINCT l_orderkey * 10 + l_linenumber + 1 AS id FROM lineitem))"""

ORGANIZATIONS = f"""SELECT id AS organization_id,
    {capital(pick(g.WORDS, u("orgs.word1", "id")))} || ' ' || {capital(pick(g.WORDS, u("orgs.word2", "id")))} AS name,
    {pick(g.INDUSTRIES, u("orgs.industry", "id"))} AS industry, {pick(g.SIZES, u("orgs.size", "id"))} AS size
    FROM (SELECT s_suppkey + 1 AS id FROM supplier)"""

_NAME, _EMAIL = person("users")
USERS = f"""SELECT id AS user_id, {_EMAIL} AS email, {_NAME} AS name, {weighted(g.PLAN_WEIGHTS, u("users.plan", "id"))} AS plan,
    {whole(1, "(SELECT count(*) FROM supplier)", u("users.org", "id"))} AS organization_id, signup_date,
    {at("signup_date", g.END, u("users.active", "id"))} AS last_active_at
    FROM (SELECT id, {at(g.START, g.END, u("users.signup", "id"))} AS signup_date FROM (SELECT c_custkey + 1 AS id FROM customer))"""


def _event(name: str) -> str:
    return u(f"events.{name}", "id")


def _field(name: str, value: str, quoted: bool = True) -> str:
    return f"""'"{name}":' || """ + (f"""'"' || {value} || '"'""" if quoted else value)


_PLANS = list(g.PLAN_MRR)
_CHANGE = _field("from_plan", pick(_PLANS, _event("from"))) + " || ',' || " + _field("to_plan", pick(_PLANS, _event("to")))
_BY_KIND = {
    "page_view": _field("page", pick(g.PAGES, _event("page"))) + " || ',' || " + _field("referrer", pick(g.REFERRERS, _event("referrer"))),
    "feature_use": _field("feature", pick(g.FEATURES, _event("feature")))
    + " || ',' || "
    + _field("duration_ms", whole(100, 30000, _event("duration")), False),
    "api_call": _field("endpoint", pick(g.ENDPOINTS, _event("endpoint")))
    + " || ',' || "
    + _field("status_code", f"({weighted(g.STATUS_CODES, _event('code'))})", False)
    + " || ',' || "
    + _field("latency_ms", whole(10, 500, _event("latency")), False),
    "upgrade": _CHANGE,
    "downgrade": _CHANGE,
}
_KINDS = "".join(f" WHEN {text(kind)} THEN {fields} || ','" for kind, fields in _BY_KIND.items())
_MARK = "CASE event_type WHEN 'login' THEN event_id * 2 + 1 WHEN 'logout' THEN event_id * 2 END"
EVENTS = f"""SELECT * EXCLUDE (mark), CASE WHEN event_type = 'login' THEN 'sess_' || event_id
        WHEN mark % 2 = 1 THEN 'sess_' || (mark // 2) END AS session_id
    FROM (SELECT *, max({_MARK}) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark
      FROM (SELECT id AS event_id, {whole(1, "(SELECT count(*) FROM customer)", _event("user"))} AS user_id, event_type,
        '{{' || CASE event_type{_KINDS} ELSE '' END || {_field("user_agent", pick(g.AGENTS, _event("agent")))} || '}}' AS properties,
        {at(g.START, g.END, _event("time"))} AS "timestamp"
        FROM (SELECT id, {weighted(g.EVENT_WEIGHTS, _event("type"))} AS event_type FROM (SELECT event_id + 1 AS id FROM events))))"""

_MRR = "CASE plan" + "".join(f" WHEN {text(k)} THEN {number(v)}" for k, v in g.PLAN_MRR.items()) + " END"
SUBSCRIPTIONS = f"""SELECT user_id AS subscription_id, user_id, plan, {_MRR} AS mrr, status, started_at,
    CASE WHEN status IN ('churned', 'cancelled') THEN {at("started_at", g.END, u("subs.end", "user_id"))} END AS ended_at,
    CASE WHEN status = 'trial' THEN started_at + INTERVAL 14 DAY END AS trial_ends_at
    FROM (SELECT user_id, plan, {weighted(g.SUBSCRIPTION_WEIGHTS, u("subs.status", "user_id"))} AS status,
          {at(g.START, g.END, u("subs.start", "user_id"))} AS started_at FROM ({USERS}))"""


def timestamps(start: datetime, end: datetime, daily: str) -> str:
    hour = f"CAST({pick([str(p) for p in g.PEAK_HOURS], u('times.peak', 'id'))} AS BIGINT)"
    moved = f"""date_trunc('day', ts)::TIMESTAMP + to_hours({hour}) + to_minutes({whole(0, 59, u("times.minute", "id"))})
        + to_seconds(CAST(second(ts) AS BIGINT))"""
    return f"""SELECT id, CASE WHEN {u("times.keep", "id")} < {daily} THEN ts ELSE {moved} END AS ts
        FROM (SELECT id, {at(start, end, u("times.at", "id"))} AS ts FROM (SELECT event_id + 1 AS id FROM events))"""


def daily_orders(base_count: int, weekly: str) -> str:
    key = ("day", "n")
    noise = f"(1.0e0 + ({u('daily.noise', 'day')} * 2 - 1) * 0.1e0)"
    count = f"greatest(1, CAST(floor({base_count} * (({weekly}) * 1.0e0 * {noise})) AS BIGINT))"
    return f"""SELECT strftime(day, '%Y-%m-%d') AS partition_key, date_diff('day', DATE '1970-01-01', day) * 10000000 + n AS order_id,
        {whole(1, "(SELECT count(*) FROM customer)", u("daily.customer", *key))} AS customer_id,
        {weighted(g.STATUS_WEIGHTS, u("daily.status", *key))} AS status, {cents(10.0, 1000.0, u("daily.amount", *key))} AS total_amount,
        CAST(day AS TIMESTAMP) + to_seconds({whole(0, 86399, u("daily.second", *key))}) AS created_at
        FROM (SELECT day, unnest(generate_series(1, {count})) AS n FROM (SELECT CAST(ts AS DATE) AS day, ts FROM (
          SELECT unnest(generate_series(CAST(date_trunc('day', min(o_orderdate)) AS TIMESTAMP), max(o_orderdate), INTERVAL 1 DAY)) AS ts
          FROM orders)))"""
