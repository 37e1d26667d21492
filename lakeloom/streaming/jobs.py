"""Incremental jobs on Structured Streaming.

Every job runs in micro-batches over new files. A batch is written under its
own number, so a batch that is run again after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timedelta
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType, StructField, StructType

from lakeloom.operators.joins import shuffled_again
from lakeloom.operators.runs import EVENT_SCHEMA, run_status_since
from lakeloom.operators.sessions import sessionize
from lakeloom.session import materialize
from lakeloom.sources.datasets import BATCH, Dataset
from lakeloom.sources.layout import PartitionField, with_partitions

Handler = Callable[[DataFrame, int], None]

# Folders of finished batches that are brought together, in datasets that no stream reads.
FOLD = 32


def file_stream(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    pattern: str = "*.parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """Files that match a glob pattern, each taken once, oldest first."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def each_batch(
    stream: DataFrame, checkpoint: str, handle: Handler, every: str | None = None, mode: str = "append"
) -> StreamingQuery:
    """Start a job; without ``every`` it takes what is there and stops."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return writer.trigger(**trigger).foreachBatch(handle).start()


def ingest(
    stream: DataFrame, table: Dataset, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Append every batch to a folder of its own."""

    def handle(batch: DataFrame, number: int) -> None:
        table.append(batch, batch=f"ingest-{number}")

    return each_batch(stream, checkpoint, handle, every)


def arrivals(source: Dataset, files_per_batch: int | None = None) -> DataFrame:
    """Rows of a dataset as its files arrive: a new load of the layer below triggers the job above."""
    schema = StructType(source.schema().fields + [StructField(n, StringType()) for n in source.folders])
    return file_stream(source.spark, source.path, schema, files_per_batch=files_per_batch).drop(*source.folders)


def refine(
    source: Dataset,
    transform: Callable[[DataFrame], DataFrame],
    target: Dataset,
    checkpoint: str,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Run a layer for the rows each new load of the layer below brings."""

    def handle(rows: DataFrame, number: int) -> None:
        target.append(transform(rows), batch=f"refine-{number}")

    return each_batch(arrivals(source, files_per_batch), checkpoint, handle)


def _slot(tag: str, number: int) -> str:
    """Where a batch leaves what only the next one needs: two folders in turn, so one that is run again finds its predecessor's."""
    return f"{tag}-{number % 2}"


def _before(table: Dataset, tag: str, number: int) -> DataFrame | None:
    """The rows that the batch before this one left for it."""
    if not table.exists() or not number:
        return None
    return table.rows().where(F.col(BATCH) == _slot(tag, number - 1)).drop(BATCH)


def merge_late(
    source: Dataset,
    target: Dataset,
    rejected: Dataset,
    newest: Dataset,
    keys: Sequence[str],
    ts: str,
    days: int,
    checkpoint: str,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Upsert new rows; those more than ``days`` behind the newest known time go aside.

    ``newest`` holds the newest time up to the last batch and the one before. A key is looked up wherever it is stored, however
    old: give the target a layout by the key, then an update's partition follows from it and no other is read.
    """

    def handle(rows: DataFrame, number: int) -> None:
        rows = materialize(rows, "arrived")
        mark = _before(newest, "merge", number)
        known = mark.first() if mark is not None else None
        accepted = rows
        if known is not None and known.newest is not None:
            limit = F.lit(str(known.newest)).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
            late = F.coalesce(F.col(ts) < limit, F.lit(False))
            rejected.append(rows.where(late), batch=f"merge-{number}")
            accepted = rows.where(~late)
        target.merge(accepted, keys, ts)
        last = F.lit(str(known.newest) if known is not None and known.newest is not None else None).cast("timestamp_ntz")
        newest.append(rows.agg(F.greatest(F.max(ts), last).alias("newest")), batch=_slot("merge", number))

    return each_batch(arrivals(source, files_per_batch), checkpoint, handle)


# The newest time known when a row was accepted: it never goes back, so no watermark on it leaves a row behind.
CLOCK = "_clock"


def divert_late(
    source: Dataset, accepted: Dataset, aside: Dataset, newest: Dataset, ts: str, days: int, checkpoint: str, files_per_batch: int | None = None
) -> StreamingQuery:
    """Part rows that are more than ``days`` behind the newest known time from those that stateful jobs may take.

    Both sides of a batch are written by that batch, so no row vanishes; rows without a time are accepted. ``newest`` holds the newest time up to the last batch. Accepted
    rows get the newest time as a clock, by which the state of later jobs is kept and dropped.
    """

    def handle(rows: DataFrame, number: int) -> None:
        rows = materialize(rows, "arrived")
        mark = _before(newest, "split", number)
        known = mark.first() if mark is not None else None
        before = F.lit(str(known.newest) if known is not None and known.newest is not None else None).cast("timestamp_ntz")
        late = F.coalesce(F.col(ts) < before - F.make_dt_interval(F.lit(days)), F.lit(False))
        newest.append(rows.agg(F.greatest(F.max(ts), before).alias("newest")), batch=_slot("split", number))
        clock = F.lit(str(_before(newest, "split", number + 1).first().newest)).cast("timestamp_ntz")
        aside.append(rows.where(late), batch=f"split-{number}")
        accepted.append(rows.where(~late).withColumn(CLOCK, clock), batch=f"split-{number}")

    return each_batch(arrivals(source, files_per_batch), checkpoint, handle)


def _with_clock(rows: DataFrame, days: int) -> DataFrame:
    return rows.withColumn(CLOCK, F.col(CLOCK).cast("timestamp")).withWatermark(CLOCK, f"{days} days")


def once_within(
    source: Dataset, keys: Sequence[str], days: int, table: Dataset, checkpoint: str, files_per_batch: int | None = None
) -> StreamingQuery:
    """Append each key of accepted rows once; the keys are kept in Spark's state store for ``days`` of the clock and dropped then.

    Every copy whose time lies within ``days`` of the first one's is found if both were accepted with that limit. Rows with a null in their key do
    not go through the state and are all kept.
    """
    whole = reduce(and_, [F.col(k).isNotNull() for k in keys])
    rows = arrivals(source, files_per_batch)
    once = _with_clock(rows.where(whole), days).dropDuplicatesWithinWatermark(list(keys))
    every = once.unionByName(_with_clock(rows.where(~whole), days)).drop(CLOCK)

    def handle(batch: DataFrame, number: int) -> None:
        table.append(batch, batch=f"within-{number}")

    return each_batch(every, checkpoint, handle)


STATE_OF_SESSION = "session_id string, last timestamp"


def _carry_session(opens: str, closes: str, idle: timedelta):
    """One step of a user's session: new rows in event id order, or the timer of an open session that saw none."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session, last = state.get if state.exists else (None, None)
        out: list[tuple] = []
        if not state.hasTimedOut:
            rows = pd.concat(list(frames)).sort_values("event_id")
            for event, kind, at in zip(rows["event_id"], rows["event_type"], rows["timestamp"], strict=True):
                if session is not None and at - last > idle:
                    out.append((None, "expired", last + idle, session))
                    session = None
                if kind == opens:
                    session = f"sess_{event}"
                out.append((event, kind, at, session))
                session, last = (None if kind == closes else session), at
        watermark = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
        if session is not None and (state.hasTimedOut or last + idle <= watermark):
            out.append((None, "expired", last + idle, session))
            session = None
        if session is not None:
            state.update((session, last))
            state.setTimeoutTimestamp(int((last + idle).timestamp() * 1000))
        elif state.exists:
            state.remove()
        frame = pd.DataFrame(out, columns=["event_id", "event_type", "timestamp", "session_id"]).astype({"event_id": "Int64"})
        frame.insert(1, "user_id", pd.array([key[0]] * len(frame), dtype="Int64"))
        yield frame

    return step


def sessions_in_state(
    source: Dataset,
    target: Dataset,
    checkpoint: str,
    idle: timedelta,
    days: int = 0,
    opens: str = "login",
    closes: str = "logout",
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Session ids carried in Spark's state store, with a timer that closes a session of which nothing was heard for ``idle``.

    Takes accepted rows (``divert_late``) with ``event_id, user_id, event_type, timestamp``; their clock drives the timers, ``days`` behind. Closed
    sessions come out as rows of type ``expired`` at the moment they ran out, without an event id, once each: before the user's next event, or when the
    timer fires. A task holds one user's rows of a batch, which ``files_per_batch`` bounds; users who fill more than that are cut by ``sessions``.
    """
    columns = ["event_id", "user_id", "event_type", "timestamp"]
    rows = _with_clock(arrivals(source, files_per_batch).select(*columns, CLOCK), days)
    rows = rows.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    schema = "event_id bigint, user_id bigint, event_type string, timestamp timestamp, session_id string"
    step = _carry_session(opens, closes, idle)
    carried = rows.groupBy("user_id").applyInPandasWithState(step, schema, STATE_OF_SESSION, "append", GroupStateTimeout.EventTimeTimeout)

    def handle(batch: DataFrame, number: int) -> None:
        target.append(batch.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")), batch=f"state-{number}")

    return each_batch(carried, checkpoint, handle)


def rollup_by_day(
    stream: DataFrame, ts: str, dimensions: Sequence[str], table: Dataset, checkpoint: str, fold: int = FOLD
) -> StreamingQuery:
    """Daily counts of each batch, in a folder of its own. No state and no watermark: a row counts however late it comes.

    Folders of ``fold`` finished batches are added up into one, and those again, so what ``rollup_total`` reads stays small.
    """

    def added(counts: DataFrame) -> DataFrame:
        return counts.groupBy("day", *dimensions).agg(F.sum("n").alias("n"))

    def handle(batch: DataFrame, number: int) -> None:
        table.fold("rollup", number, fold, added)
        day = F.date_trunc("day", F.col(ts).cast("timestamp_ntz")).cast("timestamp_ntz")
        counts = batch.groupBy(day.alias("day"), *dimensions).agg(F.count("*").alias("n"))
        table.append(counts, batch=f"rollup-{number}")

    return each_batch(stream, checkpoint, handle)


def rollup_total(table: Dataset, dimensions: Sequence[str]) -> DataFrame:
    """The counts of all batches together."""
    return table.scan().groupBy("day", *dimensions).agg(F.sum("n").alias("n"))


def dedupe(
    stream: DataFrame, keys: Sequence[str], ts: str, delay_days: int, table: Dataset, checkpoint: str, fold: int = FOLD
) -> StreamingQuery:
    """Append rows whose key was not seen before. Copies come within ``delay_days`` of each other's time, so only stored rows
    from that long before the batch's earliest time are compared; a late row that is no copy is kept. Rows with a null in their
    key are copies of nothing and all kept."""
    whole = reduce(and_, [F.col(k).isNotNull() for k in keys])

    def handle(batch: DataFrame, number: int) -> None:
        table.fold("once", number, fold)
        tag = f"once-{number}"
        keyless = batch.where(~whole)
        batch = materialize(batch.where(whole).dropDuplicates(list(keys)).unionByName(keyless), "arrived")
        if table.exists():
            earliest = batch.agg(F.min(ts)).scalar() - F.make_dt_interval(F.lit(delay_days))
            seen = table.rows().where((F.col(BATCH) != tag) & (F.col(ts) >= earliest)).select(*keys)
            batch = batch.join(shuffled_again(seen, keys[0]), list(keys), "left_anti")  # a null key equals none
        table.append(batch, batch=tag)

    return each_batch(stream, checkpoint, handle)


# Folders that the state of sessions is spread over; a batch rewrites those of its users.
STATE_FOLDERS = 64


def session_state(spark: SparkSession, path: str, folders: int = STATE_FOLDERS) -> Dataset:
    """One row per user: the session left open, and the one before the batch that changed it last."""
    return Dataset(spark, path, [PartitionField("user_id", "bucket", folders)])


def sessions(
    source: Dataset,
    target: Dataset,
    state: Dataset,
    checkpoint: str,
    opens: str = "login",
    closes: str = "logout",
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Session ids across batches: the last state of each user is carried in a table.

    Kept as a table and not as keyed streaming state, because a batch of one
    very active user is then still cut into chunks. A batch that is run again
    finds the state from before its first run.
    """

    def handle(rows: DataFrame, number: int) -> None:
        columns = ["event_id", "user_id", "event_type", "timestamp"]
        rows = materialize(rows.select(*columns), "arrived")
        local = sessionize(rows, opens, closes)
        # A user's first state change in the batch ends what earlier batches left open.
        changes = rows.where(F.col("event_type").isin(opens, closes)).groupBy("user_id").agg(
            F.min("event_id").alias("_first"),
            F.max("event_id").alias("_last"),
            F.max_by("event_type", "event_id").alias("_kind"),
        )
        users = rows.select("user_id").distinct().join(changes, "user_id", "left")
        if state.exists():
            known = state.rows()
            folder = [f.name for f in state.partition_by]
            mine = with_partitions(users.select("user_id"), state.partition_by).select(*folder).distinct()
            known = materialize(known.join(mine, folder, "left_semi").drop(*folder), "known-state")
        else:
            known = rows.sparkSession.createDataFrame([], "user_id bigint, batch bigint, session_id string, earlier string")
        left_open = F.when(F.col("batch") == number, F.col("earlier")).otherwise(F.col("session_id"))
        users = materialize(
            users.join(known.select("user_id", left_open.alias("_open")), "user_id", "left"), "batch-users"
        )
        before = F.col("_first").isNull() | (F.col("event_id") < F.col("_first"))
        ends = (F.col("event_id") == F.col("_first")) & (F.col("event_type") == closes)
        done = local.join(users, "user_id", "left").withColumn(
            "session_id", F.when(before | ends, F.col("_open")).otherwise(F.col("session_id"))
        )
        target.append(done.select(*columns, "session_id"), batch=f"sessions-{number}")
        opened = F.concat(F.lit("sess_"), F.col("_last").cast("string"))
        changed = users.where("_first is not null").select(
            "user_id",
            F.lit(number).cast("bigint").alias("batch"),
            F.when(F.col("_kind") == opens, opened).alias("session_id"),
            F.col("_open").alias("earlier"),
        )
        same = known.join(changed.select("user_id"), "user_id", "left_anti").select(*changed.columns)
        state.overwrite_partitions(same.unionByName(changed))

    return each_batch(arrivals(source, files_per_batch), checkpoint, handle)


def watch_runs(spark: SparkSession, log_path: str, status: str, jobs: Sequence[str] | None = None) -> DataFrame:
    """Stream of run events with a status; the checkpoint is the cursor."""
    events = file_stream(spark, log_path, EVENT_SCHEMA)
    return run_status_since(events, status, datetime(1970, 1, 1), jobs)
