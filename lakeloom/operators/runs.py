"""Run and lineage records as datasets."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime
from functools import wraps

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lakeloom.functions.redact import redact_message
from lakeloom.session import materialize, scratch_path

EVENT_COLUMNS = {
    "run_id": "string",
    "job": "string",
    "event_type": "string",
    "event_time": "timestamp",
    "inputs": "array<string>",
    "outputs": "array<string>",
    "n_rows": "bigint",
    "error": "string",
}
EVENT_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in EVENT_COLUMNS.items())


@dataclass
class Run:
    run_id: str
    job: str
    attributes: dict = field(default_factory=dict)
    n_rows: int | None = None


class RunLog:
    """Append-only dataset of run events."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def read(self) -> DataFrame:
        return self.spark.read.schema(EVENT_SCHEMA).parquet(self.path)

    def _write(self, run: Run, events: Sequence[tuple], inputs: list[str], outputs: list[str]) -> None:
        """The events (type, time, rows, error) of a run in one file."""
        rows = F.array(
            *[
                F.struct(
                    *[
                        F.lit(value).cast(of_type).alias(name)
                        for value, (name, of_type) in zip(
                            (run.run_id, run.job, kind, at, inputs, outputs, n_rows, error), EVENT_COLUMNS.items(), strict=True
                        )
                    ]
                )
                for kind, at, n_rows, error in events
            ]
        )
        written = self.spark.range(0, 1, 1, 1).select(F.inline(rows))
        written.withColumn("error", redact_message("error")).write.mode("append").parquet(self.path)

    @contextmanager
    def asset_run(
        self, job: str, outputs: Sequence[str] = (), inputs: Sequence[str] = (), **attributes
    ) -> Iterator[Run]:
        """START with the time before the block, COMPLETE or FAIL after it, written together; an error is passed on."""
        run, started = Run(uuid.uuid4().hex, job, dict(attributes)), datetime.now()

        def end(kind: str, error: str | None = None) -> None:
            events = [("START", started, None, None), (kind, datetime.now(), run.n_rows, error)]
            self._write(run, events, list(inputs), list(outputs))

        try:
            yield run
        except Exception as error:
            end("FAIL", str(error))
            raise
        end("COMPLETE")

    def asset(
        self, outputs: Sequence[str] = (), inputs: Sequence[str] = ()
    ) -> Callable[[Callable], Callable]:
        """Decorator: every call of the function is a recorded run named after it.

        A function that returns a commit gives the run its row count.
        """

        def wrap(fn: Callable) -> Callable:
            @wraps(fn)
            def call(*args, **kwargs):
                with self.asset_run(fn.__name__, outputs, inputs) as run:
                    result = fn(*args, **kwargs)
                    if isinstance(result, Row) and "n_rows" in result:
                        run.n_rows = result.n_rows
                return result

            return call

        return wrap


def run_summary(events: DataFrame) -> DataFrame:
    """Start, end, duration, rows and status of every run."""
    finished = F.col("event_type").isin("COMPLETE", "FAIL")
    return (
        events.groupBy("run_id")
        .agg(
            F.min(F.when(F.col("event_type") == "START", F.col("event_time"))).alias("started_at"),
            F.max(F.when(finished, F.col("event_time"))).alias("ended_at"),
            F.max(F.when(finished, F.col("event_type"))).alias("status"),
            F.max("n_rows").alias("n_rows"),
        )
        .withColumn("status", F.coalesce("status", F.lit("RUNNING")))
        .withColumn("seconds", F.timestamp_diff("SECOND", "started_at", "ended_at"))
    )


def run_status_since(
    events: DataFrame, status: str, since: datetime, jobs: Sequence[str] | None = None
) -> DataFrame:
    """Events of one status after a cursor, for the watched jobs."""
    cursor = F.lit(str(since)).cast(events.schema["event_time"].dataType)
    rows = events.where((F.col("event_type") == status) & (F.col("event_time") > cursor))
    return rows if jobs is None else rows.where(F.col("job").isin(*jobs))


def upstream(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """All ancestors of each given target with their least distance, whatever the depth of the graph.

    The result has a row per target and ancestor, so targets are meant to be some nodes and not all. One join per level;
    each level is written, so a lost executor does not replay the earlier ones. A node that was met on a shorter way is
    left out, so circles end.
    """
    spark = edges.sparkSession
    path = scratch_path(spark, "upstream")
    links = materialize(edges.select("child", "parent").distinct(), "edges")
    level = targets.select(F.col("node").alias("target"), F.col("node").alias("ancestor"))
    schema = StructType([*level.schema.fields, StructField("depth", IntegerType())])
    depth = 0
    while True:
        depth += 1
        step = (
            level.join(links, F.col("ancestor") == F.col("child"))
            .select("target", F.col("parent").alias("ancestor"))
            .distinct()
        )
        if depth > 1:
            known = spark.read.schema(schema).parquet(path).select("target", "ancestor")
            step = step.join(known, ["target", "ancestor"], "left_anti")
        step.write.parquet(f"{path}/depth={depth}")
        level = spark.read.schema(step.schema).parquet(f"{path}/depth={depth}")
        if level.isEmpty():
            return spark.read.schema(schema).parquet(path)


def closure(edges: DataFrame) -> DataFrame:
    """Every node with all of its ancestors and their least distance, by doubling: ``node, ancestor, depth``.

    A round joins the ways of exactly 2^k steps to those of at most as many: the first 2^k steps of a least way are a least way, so every longer one up
    to twice the length is found, and mostly once. A chain of a thousand takes ten rounds; each round is
    written. Nodes of a circle are ancestors of themselves. The result has a row per pair, which is what is asked for: for the ancestors of a few nodes
    in a wide graph use ``upstream``.
    """
    ways = edges.where("child is not null and parent is not null").select(
        F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth")
    )
    ways, steps = materialize(ways.distinct(), "ways"), 1
    while not (ends := ways.where(F.col("depth") == steps)).isEmpty():
        further = ways.select(F.col("node").alias("_by"), F.col("ancestor").alias("_up"), F.col("depth").alias("_more"))
        longer = ends.join(further, F.col("ancestor") == F.col("_by")).select("node", F.col("_up").alias("ancestor"), (F.col("depth") + F.col("_more")).alias("depth"))
        ways = materialize(ways.unionByName(longer).groupBy("node", "ancestor").agg(F.min("depth").alias("depth")), "ways")
        steps *= 2
    return ways


def circles(ways: DataFrame) -> DataFrame:
    """Nodes of a closure that depend on themselves, each with the least node it shares its circles with: ``node, circle``."""
    # Only such a node is its own ancestor, so ways of and to others are left out before ways are held against each other.
    own = ways.where("node = ancestor").select("node").distinct()
    inside = ways.select("node", "ancestor").join(own, "node", "left_semi")
    inside = inside.join(own.select(F.col("node").alias("ancestor")), "ancestor", "left_semi")
    back = inside.select(F.col("ancestor").alias("node"), F.col("node").alias("ancestor"))
    mutual = inside.join(back, ["node", "ancestor"])
    return mutual.groupBy("node").agg(F.min("ancestor").alias("circle"))


def schema_facet(df: DataFrame, dataset: str) -> DataFrame:
    """Name, type and description of every column, with the values it holds."""
    counts = df.agg(*[F.count(f"`{f.name}`").alias(f"n_{i}") for i, f in enumerate(df.schema.fields)])
    rows = F.array(
        *[
            F.struct(
                F.lit(dataset).alias("dataset"),
                F.lit(f.name).alias("name"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.lit(f.metadata.get("description")).cast("string").alias("description"),
                F.col(f"n_{i}").alias("n_values"),
            )
            for i, f in enumerate(df.schema.fields)
        ]
    )
    return counts.select(F.inline(rows))
