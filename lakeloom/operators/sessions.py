"""State carried along an order, without one task per user or per table.

Rows are cut into chunks at quantiles of the event ids, so a chunk holds its
share of the rows however active a user is and however far apart the ids are. A
window inside each chunk is completed by the state the earlier chunks end with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.operators.ranking import with_chunks


def sessionize(
    events: DataFrame,
    opens: str = "login",
    closes: str = "logout",
    chunks: int | None = None,
) -> DataFrame:
    """Add ``session_id``, per user in event id order.

    An opening event starts a session or replaces the current one; a closing
    event still belongs to the session it ends; other events carry it.
    """
    own = F.concat(F.lit("sess_"), F.col("event_id").cast("string"))
    state = F.when(F.col("event_type") == opens, F.struct(own.alias("id"))).when(
        F.col("event_type") == closes, F.struct(F.lit(None).cast("string").alias("id"))
    )
    rows = with_chunks(events.withColumn("_state", state), events, "event_id", chunks)
    before = (
        Window.partitionBy("user_id", "_chunk")
        .orderBy("event_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    earlier_chunks = (
        Window.partitionBy("user_id")
        .orderBy("_chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        rows.groupBy("user_id", "_chunk")
        .agg(
            F.max_by(
                "_state", F.when(F.col("_state").isNotNull(), F.col("event_id"))
            ).alias("_last")
        )
        .withColumn("_carried", F.last("_last", ignorenulls=True).over(earlier_chunks))
        .drop("_last")
    )
    current = F.coalesce("_local", "_carried")
    return (
        rows.withColumn("_local", F.last("_state", ignorenulls=True).over(before))
        .join(carried, ["user_id", "_chunk"])
        .withColumn(
            "session_id",
            F.when(F.col("event_type") == opens, own).otherwise(current.getField("id")),
        )
        .select(*events.columns, "session_id")
    )


def late_split(
    events: DataFrame, ts: str, days: int, chunks: int | None = None
) -> DataFrame:
    """Add ``is_late``: older than the newest earlier arrival minus ``days``.

    Arrival order is event id order.
    """
    rows = with_chunks(events, events, "event_id", chunks)
    before = (
        Window.partitionBy("_chunk").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    )
    # One row per chunk, so a single window over them stays small.
    earlier_chunks = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy("_chunk")
        .agg(F.max(ts).alias("_last"))
        .withColumn("_carried", F.max("_last").over(earlier_chunks))
        .drop("_last")
    )
    newest = F.greatest("_local", "_carried")
    limit = newest - F.make_dt_interval(F.lit(days))
    return (
        rows.withColumn("_local", F.max(ts).over(before))
        .join(carried, "_chunk")
        .withColumn("is_late", F.coalesce(F.col(ts) < limit, F.lit(False)))
        .select(*events.columns, "is_late")
    )
