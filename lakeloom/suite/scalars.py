"""Scalar expressions, sessions and late rows over the given tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.functions import clean, temporal
from lakeloom.functions.draws import draw, draw_int, weighted
from lakeloom.functions.redact import FORBIDDEN_ATTRIBUTES, SECRET_PATTERNS, redact, safe_attributes
from lakeloom.operators import generate, quality, sessions
from lakeloom.suite import draw_sql
from lakeloom.suite.base import Tables, query
from lakeloom.suite.ctes import define, sql


@query(
    "scalar_normalize",
    sql(
        """SELECT customer_id, lower(trim(email)) AS email, upper(email) AS loud, trim(name) AS name
           FROM raw_customers"""
    ),
)
def scalar_normalize(t: Tables) -> DataFrame:
    return t.raw("customers").select(
        "customer_id",
        clean.normalize("email").alias("email"),
        F.upper("email").alias("loud"),
        F.trim("name").alias("name"),
    )


@query(
    "scalar_casts",
    """SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS quantity,
              CAST(CAST(l_extendedprice AS DECIMAL(10,2)) AS DOUBLE) AS price,
              CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, l_shipdate AS at,
              TRY_CAST(l_returnflag AS BIGINT) AS bad FROM lineitem""",
)
def scalar_casts(t: Tables) -> DataFrame:
    return t.given("lineitem").select(
        "l_orderkey",
        F.col("l_quantity").cast("int").alias("quantity"),
        clean.money("l_extendedprice").alias("price"),
        F.col("l_shipdate").cast("date").alias("day"),
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").cast("timestamp_ntz").alias("at"),
        F.expr("try_cast(l_returnflag as bigint)").alias("bad"),
    )


@query(
    "scalar_subtotal",
    """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CAST(
         CAST(l_quantity AS INTEGER) * CAST(l_extendedprice AS DECIMAL(10,2)) - CAST(l_discount AS DECIMAL(10,2))
         AS DOUBLE) AS subtotal FROM lineitem""",
)
def scalar_subtotal(t: Tables) -> DataFrame:
    items = t.given("lineitem").withColumnRenamed("l_quantity", "quantity")
    return quality.with_subtotal(items, "l_extendedprice", "l_discount").select(
        "l_orderkey", "l_linenumber", "subtotal"
    )


@query(
    "sequence_rows",
    """SELECT l_orderkey, count(*) AS n_units, CAST(sum(unit) AS BIGINT) AS unit_sum FROM (
         SELECT l_orderkey, unnest(range(1, CAST(l_quantity AS BIGINT) + 1)) AS unit FROM lineitem)
       GROUP BY l_orderkey""",
)
def sequence_rows(t: Tables) -> DataFrame:
    """Every line becomes one row per unit sold, then units are counted per order."""
    units = F.sequence(F.lit(1), F.col("l_quantity").cast("int"))
    rows = t.given("lineitem").select("l_orderkey", F.explode(units).alias("unit"))
    return rows.groupBy("l_orderkey").agg(
        F.count("*").alias("n_units"), F.sum("unit").alias("unit_sum")
    )


@query(
    "trial_end",
    """SELECT event_id, CASE WHEN event_type = 'signup' THEN ts + INTERVAL 14 DAY END AS trial_ends_at FROM events""",
)
def trial_end(t: Tables) -> DataFrame:
    status = F.when(F.col("event_type") == "signup", "trial").otherwise("active")
    ends = generate.trial_end(status, F.col("timestamp"))
    return t.raw("events").select("event_id", ends.alias("trial_ends_at"))


@query(
    "event_props",
    """SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, props->>'$.k' AS k_text FROM events""",
)
def event_props(t: Tables) -> DataFrame:
    parsed = F.from_json("properties", "k bigint")
    return t.raw("events").select(
        "event_id", parsed["k"].alias("k"), F.get_json_object("properties", "$.k").alias("k_text")
    )


_MESSAGE_SQL = """(
    SELECT 'd' || doc_id AS id, text AS message FROM documents
    UNION ALL SELECT 'c' || c_custkey, 'failed: SELECT 1 FROM t WHERE c_name = ''' || c_name || ''' LIMIT 1; PASSWORD = "'
      || c_mktsegment || '" authorization: Bearer ' || c_custkey || 'x' FROM customer)"""
_REDACTED = "message"
for _pattern in SECRET_PATTERNS:
    _REDACTED = (
        f"regexp_replace({_REDACTED}, '(?i){_pattern.replace(chr(39), chr(39) * 2)}', '[REDACTED]', 'g')"
    )


@query(
    "redact_messages",
    f"SELECT id, {_REDACTED} AS message FROM {_MESSAGE_SQL}",
)
def redact_messages(t: Tables) -> DataFrame:
    """Whole document texts, and error messages made of customers, that carry secrets."""
    texts = t.given("documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("message")
    )
    key = F.col("c_custkey").cast("string")
    errors = t.given("customer").select(
        F.concat(F.lit("c"), key).alias("id"),
        F.concat(
            F.lit("failed: SELECT 1 FROM t WHERE c_name = '"),
            "c_name",
            F.lit("' LIMIT 1; PASSWORD = \""),
            "c_mktsegment",
            F.lit('" authorization: Bearer '),
            key,
            F.lit("x"),
        ).alias("message"),
    )
    return texts.unionByName(errors).select("id", redact("message").alias("message"))


_FORBIDDEN = " OR ".join(f"contains(lower(k), '{word}')" for word in FORBIDDEN_ATTRIBUTES)


@query(
    "redact_attributes",
    f"""SELECT event_id, string_agg(k || '=' || v, ',' ORDER BY k) AS attributes FROM (
          SELECT event_id, unnest(['event_type', 'User_Email', 'x_session_id', event_type || '_count', event_type || '_Token'])
                   AS k,
                 unnest([event_type, 'u' || user_id, 's' || event_id, CAST(user_id AS VARCHAR), 'abc']) AS v FROM events)
        WHERE NOT ({_FORBIDDEN}) GROUP BY event_id""",
)
def redact_attributes(t: Tables) -> DataFrame:
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    attributes = F.create_map(
        F.lit("event_type"), kind,
        F.lit("User_Email"), F.concat(F.lit("u"), user),
        F.lit("x_session_id"), F.concat(F.lit("s"), F.col("event_id").cast("string")),
        F.concat(kind, F.lit("_count")), user,
        F.concat(kind, F.lit("_Token")), F.lit("abc"),
    )
    entries = F.array_sort(F.map_entries(safe_attributes(attributes)))
    text = F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return t.raw("events").select("event_id", text.alias("attributes"))


@query(
    "valid_email",
    sql(
        r"""SELECT customer_id, regexp_matches(email, '^[\w.\-+]+@[\w.\-]+\.\w+$') AS raw_valid,
                  regexp_matches(lower(trim(email)), '^[\w.\-+]+@[\w.\-]+\.\w+$') AS clean_valid FROM raw_customers"""
    ),
)
def valid_email(t: Tables) -> DataFrame:
    return t.raw("customers").select(
        "customer_id",
        clean.is_email("email").alias("raw_valid"),
        clean.is_email(clean.normalize("email")).alias("clean_valid"),
    )


# --- draws and factors -----------------------------------------------------


@query(
    "hash_draw",
    f"""SELECT o_orderkey, {draw_sql.u("u", "o_orderkey")} AS u, {draw_sql.whole(1, 6, draw_sql.u("die", "o_orderkey"))} AS die
        FROM orders""",
)
def hash_draw(t: Tables) -> DataFrame:
    """A draw in [0, 1) and a whole number per order."""
    return t.given("orders").select(
        "o_orderkey",
        draw(42, "u", "o_orderkey").alias("u"),
        draw_int(1, 6, draw(42, "die", "o_orderkey")).alias("die"),
    )


@query(
    "weighted_draw",
    f"""SELECT {draw_sql.weighted(generate.STATUS_WEIGHTS, draw_sql.u("status", "o_orderkey"))} AS status, count(*) AS n
        FROM orders GROUP BY 1""",
)
def weighted_draw(t: Tables) -> DataFrame:
    """Orders per drawn status."""
    status = weighted(generate.STATUS_WEIGHTS, draw(42, "status", "o_orderkey"))
    return t.given("orders").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


DAILY_SQL = """CASE WHEN hour(ts) < 6 THEN 0.1 WHEN hour(ts) < 9 THEN 0.5::DOUBLE + (hour(ts) - 6) * 0.15::DOUBLE
    WHEN hour(ts) IN (10, 14, 18, 21) THEN 1.0 WHEN hour(ts) < 18 THEN 0.7 WHEN hour(ts) < 22 THEN 0.8
    ELSE 0.3 END::DOUBLE"""
WEEKLY_SQL = """CASE WHEN isodow(ts) >= 6 THEN 0.3 WHEN isodow(ts) = 1 THEN 0.9 WHEN isodow(ts) = 5 THEN 0.85
    ELSE 1.0 END::DOUBLE"""


@query("daily_factor", f"SELECT event_id, {DAILY_SQL} AS factor FROM events")
def daily_factor(t: Tables) -> DataFrame:
    factor = temporal.daily_factor(F.hour("timestamp"))
    return t.raw("events").select("event_id", factor.alias("factor"))


@query("weekly_factor", f"SELECT event_id, {WEEKLY_SQL} AS factor FROM events")
def weekly_factor(t: Tables) -> DataFrame:
    factor = temporal.weekly_factor(F.weekday("timestamp"))
    return t.raw("events").select("event_id", factor.alias("factor"))


_TREND_SQL = "1.0::DOUBLE + 0.02::DOUBLE * ((year(ts) - 2020) * 12 + (month(ts) - 1))"


@query("trend_factor", f"SELECT event_id, {_TREND_SQL} AS factor FROM events")
def trend_factor(t: Tables) -> DataFrame:
    factor = temporal.trend_factor(F.to_date("timestamp"), 0.02, date(2020, 1, 1))
    return t.raw("events").select("event_id", factor.alias("factor"))


@query(
    "adjusted_count",
    f"""SELECT event_id, greatest(1, CAST(floor(1000 * (({DAILY_SQL}) * ({WEEKLY_SQL}) * ({_TREND_SQL})))
          AS BIGINT)) AS n FROM events""",
)
def adjusted_count(t: Tables) -> DataFrame:
    """Records asked for at each event's instant, without noise."""
    ts = F.col("timestamp")
    factor = (
        temporal.daily_factor(F.hour(ts))
        * temporal.weekly_factor(F.weekday(ts))
        * temporal.trend_factor(F.to_date(ts), 0.02, date(2020, 1, 1))
    )
    return t.raw("events").select("event_id", temporal.adjusted_count(1000, factor).alias("n"))


# --- sessions and late rows ------------------------------------------------

define(
    "sessions",
    """SELECT event_id, user_id, event_type, "timestamp",
              CASE WHEN event_type = 'signup' THEN 'sess_' || event_id
                   WHEN last_open > coalesce(last_close, -1) THEN 'sess_' || last_open END AS session_id
       FROM (SELECT *,
               max(CASE WHEN event_type = 'signup' THEN event_id END) OVER w AS last_open,
               max(CASE WHEN event_type = 'error' THEN event_id END) OVER w AS last_close
             FROM raw_events
             WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
)


@query("sessionize_login", sql('SELECT event_id, user_id, event_type, "timestamp", session_id FROM sessions'))
def sessionize_login(t: Tables) -> DataFrame:
    """Sessions from signup to error."""
    events = t.raw("events").select("event_id", "user_id", "event_type", "timestamp")
    return sessions.sessionize(events, opens="signup", closes="error")


# A share of the events is put back in time, by days that follow from their id.
define(
    "late_events",
    """SELECT event_id, user_id, event_type, CASE WHEN event_id % 5 = 0
         THEN "timestamp" - to_days(CAST(event_id % 17 AS INTEGER)) ELSE "timestamp" END AS "timestamp"
       FROM raw_events""",
)


def late_events(t: Tables) -> DataFrame:
    moved = F.expr("timestamp - make_dt_interval(cast(event_id % 17 as int))")
    ts = F.when(F.col("event_id") % 5 == 0, moved).otherwise(F.col("timestamp"))
    return t.raw("events").select("event_id", "user_id", "event_type", ts.alias("timestamp"))


@query(
    "late_split",
    sql(
        """SELECT event_id, "timestamp", coalesce("timestamp" < newest - INTERVAL 7 DAY, false) AS is_late FROM (
             SELECT *, max("timestamp") OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest
             FROM late_events)"""
    ),
)
def late_split(t: Tables) -> DataFrame:
    return sessions.late_split(late_events(t), "timestamp", 7).select("event_id", "timestamp", "is_late")


@query(
    "window_tumbling_day",
    """SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2""",
)
def window_tumbling_day(t: Tables) -> DataFrame:
    day = F.window("timestamp", "1 day")["start"]
    return t.raw("events").groupBy(day.alias("day"), "event_type").agg(F.count("*").alias("n"))
