"""Streaming jobs run over the event table, checked against their batch twins."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.session import scratch_path
from lakeloom.sources.layout import PartitionField
from lakeloom.sources.datasets import Dataset
from lakeloom.streaming import jobs
from lakeloom.suite.base import Tables, query
from lakeloom.suite.ctes import define, sql
from lakeloom.suite.scalars import late_events


def _table(t: Tables, name: str, *fields: PartitionField) -> Dataset:
    return Dataset(t.spark, scratch_path(t.spark, name), fields)


def _checkpoint(t: Tables, name: str) -> str:
    return scratch_path(t.spark, f"checkpoint-{name}")


# Files of each arriving part, and files that a batch takes: each part is one batch.
FILES = 4
PARTS = 3


def _arrivals(t: Tables, rows: DataFrame) -> Dataset:
    """Event rows arriving in three loads, in event id order."""
    table = _table(t, "arrivals")
    high = t.given("events").agg(F.max("event_id")).first()[0] + 1
    edges = [high * i // PARTS for i in range(PARTS + 1)]
    for i, (low, top) in enumerate(zip(edges, edges[1:])):
        part = rows.where((F.col("event_id") >= low) & (F.col("event_id") < top))
        table.append(part.repartition(FILES), batch=f"load-{i}")
    return table


def _event_files(t: Tables, rows: DataFrame | None = None) -> DataFrame:
    """The events as a stream of several batches."""
    return jobs.arrivals(_arrivals(t, t.given("events") if rows is None else rows), FILES)


@query("stream_ingest", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def stream_ingest(t: Tables) -> DataFrame:
    table, checkpoint, source = _table(t, "ingest"), _checkpoint(t, "ingest"), _arrivals(t, t.given("events"))
    jobs.ingest(jobs.arrivals(source, FILES), table, checkpoint).awaitTermination()
    # Started again, the job finds no new file and adds nothing.
    jobs.ingest(jobs.arrivals(source, FILES), table, checkpoint).awaitTermination()
    return table.scan()


@query(
    "stream_bronze_to_silver",
    sql(
        """SELECT event_id, user_id, upper(event_type) AS event_type, "timestamp" FROM raw_events WHERE value >= 1"""
    ),
)
def stream_bronze_to_silver(t: Tables) -> DataFrame:
    """Each new bronze load runs the silver step for its own rows."""
    bronze, silver = _arrivals(t, t.raw("events")), _table(t, "silver")

    def clean(rows: DataFrame) -> DataFrame:
        kind = F.upper("event_type").alias("event_type")
        return rows.where("value >= 1").select("event_id", "user_id", kind, "timestamp")

    jobs.refine(bronze, clean, silver, _checkpoint(t, "refine"), FILES).awaitTermination()
    return silver.scan()


# Rows are late when older than the newest earlier load's time minus seven days.
define(
    "arrival_batches",
    """SELECT e.*, CAST(floor(e.event_id * 3 / (SELECT max(event_id) + 1 FROM events)) AS INTEGER) AS batch
       FROM late_events e""",
)
define(
    "late_batches",
    """SELECT a.*, coalesce(a."timestamp" < (SELECT max(b."timestamp") FROM accepted_max b WHERE b.batch < a.batch)
              - INTERVAL 7 DAY, false) AS late FROM arrival_batches a""",
)
define("accepted_max", """SELECT batch, max("timestamp") AS "timestamp" FROM arrival_batches GROUP BY batch""")


@query(
    "stream_merge",
    sql(
        """SELECT 'target' AS side, event_id, user_id, event_type, "timestamp" FROM late_batches WHERE NOT late
           UNION ALL SELECT 'late', event_id, user_id, event_type, "timestamp" FROM late_batches WHERE late"""
    ),
)
def stream_merge(t: Tables) -> DataFrame:
    """Upserts with rows up to seven days late; older ones are kept aside."""
    source = _arrivals(t, late_events(t))
    target, aside = _table(t, "target", PartitionField("timestamp", "month")), _table(t, "late")
    newest, checkpoint = _table(t, "newest"), _checkpoint(t, "merge")
    jobs.merge_late(
        source, target, aside, newest, ["event_id"], "timestamp", 7, checkpoint, FILES
    ).awaitTermination()
    sides = [
        table.scan().select(F.lit(name).alias("side"), "event_id", "user_id", "event_type", "timestamp")
        for name, table in (("target", target), ("late", aside))
    ]
    return sides[0].unionByName(sides[1])


define(
    "order_changes",
    """SELECT 1 AS batch, order_id, 'completed' AS status, top + INTERVAL 1 DAY AS ts
       FROM stg_orders, (SELECT max(created_at) AS top FROM stg_orders) WHERE order_id % 3 = 0
       UNION ALL SELECT 1, order_id, 'checked', created_at + INTERVAL 1 HOUR FROM stg_orders WHERE order_id % 5 = 1
       UNION ALL SELECT 2, order_id, 'returned', top + INTERVAL 2 DAY
       FROM stg_orders, (SELECT max(created_at) AS top FROM stg_orders) WHERE order_id % 6 = 0""",
)


@query(
    "stream_merge_orders",
    sql(
        """WITH marked AS (SELECT *, batch = 1 AND ts < (SELECT max(created_at) FROM stg_orders) - INTERVAL 7 DAY AS late FROM order_changes)
           SELECT 'target' AS side, order_id, arg_max(status, ts) AS status, max(ts) AS updated_at FROM (
             SELECT order_id, 'pending' AS status, created_at AS ts FROM stg_orders
             UNION ALL SELECT order_id, status, ts FROM marked WHERE NOT late) GROUP BY order_id
           UNION ALL SELECT 'late', order_id, status, ts FROM marked WHERE late"""
    ),
)
def stream_merge_orders(t: Tables) -> DataFrame:
    """Orders of years change in later batches; each is found and replaced wherever it is, and changes that are too old go aside."""
    orders = t.stg("orders").select("order_id", F.col("created_at").alias("updated_at"))
    top = orders.agg(F.max("updated_at")).scalar()
    day = F.make_dt_interval(F.lit(1))
    source = _table(t, "order-changes")
    loads = [
        orders.select("order_id", F.lit("pending").alias("status"), "updated_at"),
        orders.where("order_id % 3 = 0")
        .select("order_id", F.lit("completed").alias("status"), (top + day).alias("updated_at"))
        .unionByName(
            orders.where("order_id % 5 = 1").select(
                "order_id", F.lit("checked").alias("status"), F.expr("updated_at + interval 1 hour").alias("updated_at")
            )
        ),
        orders.where("order_id % 6 = 0").select("order_id", F.lit("returned").alias("status"), (top + day + day).alias("updated_at")),
    ]
    target, aside = _table(t, "orders-now", PartitionField("order_id", "truncate", 5000)), _table(t, "orders-late")
    newest, checkpoint = _table(t, "orders-newest"), _checkpoint(t, "merge-orders")
    for i, rows in enumerate(loads):
        source.append(rows, batch=f"load-{i}")
        # The job is started anew for every load and goes on where it was.
        jobs.merge_late(source, target, aside, newest, ["order_id"], "updated_at", 7, checkpoint).awaitTermination()
    sides = [
        table.scan().select(F.lit(name).alias("side"), "order_id", "status", "updated_at")
        for name, table in (("target", target), ("late", aside))
    ]
    return sides[0].unionByName(sides[1])


@query(
    "stream_rollup",
    """SELECT date_trunc('day', ts - to_days(CAST(CASE WHEN event_id % 5 = 0 THEN event_id % 17 ELSE 0 END AS INTEGER)))::TIMESTAMP
              AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2""",
)
def stream_rollup(t: Tables) -> DataFrame:
    """Daily counts over three batches with late rows in each."""
    moved = F.expr("ts - make_dt_interval(cast(if(event_id % 5 = 0, event_id % 17, 0) as int))")
    table, events = _table(t, "rollup"), t.given("events").withColumn("ts", moved)
    jobs.rollup_by_day(_event_files(t, events), "ts", ["event_type"], table, _checkpoint(t, "rollup")).awaitTermination()
    return jobs.rollup_total(table, ["event_type"])


@query("stream_dedupe", "SELECT event_id, ts, user_id, event_type FROM events")
def stream_dedupe(t: Tables) -> DataFrame:
    """Every event arrives twice, some copies in a later batch, and is kept once."""
    events = t.given("events").select("event_id", "ts", "user_id", "event_type")
    source = _arrivals(t, events)
    source.append(events.repartition(FILES), batch="again")
    table = _table(t, "once")
    jobs.dedupe(
        jobs.arrivals(source, FILES), ["event_id"], "ts", 1, table, _checkpoint(t, "dedupe")
    ).awaitTermination()
    return table.scan()


def _accepted(t: Tables, source: Dataset, days: int) -> tuple[Dataset, Dataset]:
    """The source's rows, parted by a job of its own: accepted ones, and those too far behind."""
    accepted, aside = _table(t, "accepted"), _table(t, "aside")
    ts = "timestamp" if "timestamp" in source.schema().names else "ts"
    jobs.divert_late(source, accepted, aside, _table(t, "clock"), ts, days, _checkpoint(t, "divert"), FILES).awaitTermination()
    return accepted, aside


@query(
    "stream_dedupe_state",
    """WITH e AS (SELECT nullif(event_id, CASE WHEN event_id % 50 = 0 THEN event_id END) AS event_id, ts, user_id, event_type,
                 ts < (SELECT max(ts) FROM events) - INTERVAL 3 DAY AS late FROM events)
       SELECT 'once' AS side, event_id, ts, user_id, event_type FROM e
       UNION ALL SELECT 'once', event_id, ts, user_id, event_type FROM e WHERE event_id IS NULL AND NOT late
       UNION ALL SELECT 'late', event_id, ts, user_id, event_type FROM e WHERE late""",
)
def stream_dedupe_state(t: Tables) -> DataFrame:
    """All events arrive again: copies of the last days are found in the state, older rows go aside, rows without a key are kept."""
    key = F.when(F.col("event_id") % 50 != 0, F.col("event_id")).alias("event_id")
    events = t.given("events").select(key, "ts", "user_id", "event_type")
    source = _table(t, "arrivals")
    third = t.given("events").agg(F.max("event_id")).first()[0] // PARTS + 1
    for i in range(PARTS):
        part = t.given("events").where(F.floor(F.col("event_id") / third) == i)
        source.append(part.select(key, "ts", "user_id", "event_type").repartition(FILES), batch=f"load-{i}")
    source.append(events.repartition(FILES), batch="load-again")
    accepted, aside = _accepted(t, source, 3)
    once = _table(t, "once")
    jobs.once_within(accepted, ["event_id"], 3, once, _checkpoint(t, "within")).awaitTermination()
    return once.scan().select(F.lit("once").alias("side"), "*").unionByName(aside.scan().select(F.lit("late").alias("side"), "*"))


IDLE = timedelta(hours=36)

define(
    "idle_segments",
    """SELECT *, sum(CASE WHEN "timestamp" - before > INTERVAL 36 HOUR THEN 1 ELSE 0 END)
              OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS segment
       FROM (SELECT *, lag("timestamp") OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM raw_events)""",
)
define(
    "idle_sessions",
    """SELECT event_id, user_id, event_type, "timestamp", last_row,
              CASE WHEN event_type = 'signup' THEN 'sess_' || event_id
                   WHEN last_open > coalesce(last_close, -1) THEN 'sess_' || last_open END AS session_id
       FROM (SELECT *,
               max(CASE WHEN event_type = 'signup' THEN event_id END) OVER w AS last_open,
               max(CASE WHEN event_type = 'error' THEN event_id END) OVER w AS last_close,
               event_id = max(event_id) OVER (PARTITION BY user_id, segment) AS last_row
             FROM idle_segments
             WINDOW w AS (PARTITION BY user_id, segment ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
)


@query(
    "stream_sessions_idle",
    sql(
        """SELECT event_id, user_id, event_type, "timestamp", session_id FROM idle_sessions
           UNION ALL SELECT NULL, user_id, 'expired', "timestamp" + INTERVAL 36 HOUR, session_id FROM idle_sessions
           WHERE last_row AND event_type <> 'error' AND session_id IS NOT NULL
             AND "timestamp" + INTERVAL 36 HOUR < (SELECT max("timestamp") FROM raw_events)"""
    ),
)
def stream_sessions_idle(t: Tables) -> DataFrame:
    """Sessions in the state store over three loads with a restart at each; a timer closes those that are idle."""
    events, target, checkpoint = t.raw("events").drop("properties", "value"), _table(t, "sessions-idle"), _checkpoint(t, "idle")
    source, accepted = _table(t, "arrivals"), _table(t, "accepted")
    clock, aside, splits = _table(t, "clock"), _table(t, "aside"), _checkpoint(t, "divert")
    third = t.given("events").agg(F.max("event_id")).first()[0] // PARTS + 1
    for i in range(PARTS):
        source.append(events.where(F.floor(F.col("event_id") / third) == i).repartition(FILES), batch=f"load-{i}")
        jobs.divert_late(source, accepted, aside, clock, "timestamp", 1, splits).awaitTermination()
        jobs.sessions_in_state(accepted, target, checkpoint, IDLE, 0, "signup", "error").awaitTermination()
    return target.scan()


@query(
    "stream_sessions",
    sql('SELECT event_id, user_id, event_type, "timestamp", session_id FROM sessions'),
)
def stream_sessions(t: Tables) -> DataFrame:
    """Sessions carried over three batches equal those of one pass."""
    source = _arrivals(t, t.raw("events"))
    target, state = _table(t, "sessions"), jobs.session_state(t.spark, scratch_path(t.spark, "state"))
    jobs.sessions(
        source, target, state, _checkpoint(t, "sessions"), "signup", "error", FILES
    ).awaitTermination()
    return target.scan()
