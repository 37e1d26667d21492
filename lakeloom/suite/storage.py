"""Scans, sinks, layouts, loads and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.session import scratch_path
from lakeloom.sources import layout, scan
from lakeloom.sources.layout import PartitionField
from lakeloom.sources.datasets import (
    BATCH,
    Dataset,
    high_water,
    materialize_report,
    upsert,
    write_table,
)
from lakeloom.suite.base import Tables, query
from lakeloom.suite.ctes import define, sql

ORDER_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
SPLIT = "1998-01-01 00:00:00"
OLD = f"o_orderdate < timestamp_ntz'{SPLIT}'"
OLD_SQL = f"o_orderdate < TIMESTAMP '{SPLIT}'"


def fresh(t: Tables, name: str, *partition_by: PartitionField) -> Dataset:
    return Dataset(t.spark, scratch_path(t.spark, name), partition_by)


# --- scans -----------------------------------------------------------------


@query("scan_full", f"SELECT {ORDER_COLUMNS} FROM orders")
def scan_full(t: Tables) -> DataFrame:
    return scan.scan(t.given("orders"))


@query("scan_project", "SELECT o_orderkey, o_totalprice FROM orders")
def scan_project(t: Tables) -> DataFrame:
    return scan.scan(t.given("orders"), columns=["o_orderkey", "o_totalprice"])


@query("scan_filter_eq", f"SELECT {ORDER_COLUMNS} FROM orders WHERE o_orderstatus = 'F'")
def scan_filter_eq(t: Tables) -> DataFrame:
    return scan.scan(t.given("orders"), row_filter="o_orderstatus = 'F'")


@query("scan_filter_range", f"SELECT {ORDER_COLUMNS} FROM orders WHERE o_totalprice > 200.0")
def scan_filter_range(t: Tables) -> DataFrame:
    return scan.scan(t.given("orders"), row_filter="o_totalprice > 200.0")


@query("scan_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def scan_limit(t: Tables) -> DataFrame:
    ordered = t.given("orders").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return scan.scan(ordered, ["o_orderkey", "o_totalprice"], limit=100)


@query(
    "read_table",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'"
    " ORDER BY o_orderkey LIMIT 500",
)
def read_table(t: Tables) -> DataFrame:
    ordered = t.given("orders").orderBy("o_orderkey")
    return scan.scan(ordered, ["o_orderkey", "o_custkey"], "o_orderpriority = '1-URGENT'", 500)


@query("read_layer", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0")
def read_layer(t: Tables) -> DataFrame:
    path = scan.layer_path({"bronze": t.sf_dir}, "bronze", "customer.parquet")
    return scan.scan(
        t.spark.read.parquet(path), ["c_custkey", "c_mktsegment"], "c_acctbal > 0"
    )


@query(
    "load_partition_input",
    f"""SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1997-03-01'
        AND o_orderdate < TIMESTAMP '1997-04-01' AND o_totalprice > 1000""",
)
def load_partition_input(t: Tables) -> DataFrame:
    metadata = {"columns": ["o_orderkey", "o_orderdate"], "row_filter": "o_totalprice > 1000"}
    return scan.load_input(t.given("orders"), metadata, "1997-03", "o_orderdate")


@query(
    "partition_filter",
    """SELECT event_id, ts FROM events
       WHERE ts >= TIMESTAMP '2024-01-15 12:00:00' AND ts < TIMESTAMP '2024-01-15 13:00:00'
       UNION ALL SELECT event_id, ts FROM events
       WHERE ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-21'""",
)
def partition_filter(t: Tables) -> DataFrame:
    """An hour key and a day key over the event time."""
    events = t.given("events").select("event_id", "ts")
    hour = scan.in_partition(events, "ts", "2024-01-15-12")
    return hour.union(scan.in_partition(events, "ts", "2024-01-20"))


@query("scan_glob", "SELECT r_regionkey, r_name FROM region")
def scan_glob(t: Tables) -> DataFrame:
    return scan.scan_glob(t.spark, f"{t.sf_dir}/regio*.parquet")


# --- writes ----------------------------------------------------------------


@query("append_rows", f"SELECT {ORDER_COLUMNS} FROM orders")
def append_rows(t: Tables) -> DataFrame:
    """Two appends; the table holds both."""
    table, orders = fresh(t, "append"), t.given("orders")
    table.append(orders.where(OLD))
    table.append(orders.where(f"not ({OLD})"))
    return table.scan()


@query("overwrite_rows", f"SELECT {ORDER_COLUMNS} FROM orders WHERE {OLD_SQL}")
def overwrite_rows(t: Tables) -> DataFrame:
    table, orders = fresh(t, "overwrite"), t.given("orders")
    table.append(orders)
    table.overwrite(orders.where(OLD))
    return table.scan()


@query(
    "overwrite_partitions",
    f"""SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE NOT {OLD_SQL}
        UNION ALL SELECT o_orderkey, o_orderdate, 0.0::DOUBLE FROM orders
        WHERE {OLD_SQL} AND o_orderstatus = 'F'""",
)
def overwrite_partitions(t: Tables) -> DataFrame:
    """Every year up to the split is replaced, the later years are not touched."""
    table = fresh(t, "partitions", PartitionField("o_orderdate", "year"))
    orders = t.given("orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    table.append(orders)
    done = t.given("orders").where(OLD).where("o_orderstatus = 'F'")
    table.overwrite_partitions(
        done.select("o_orderkey", "o_orderdate", F.lit(0.0).alias("o_totalprice"))
    )
    return table.scan()


@query("write_table", f"SELECT {ORDER_COLUMNS} FROM orders")
def write_table_query(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "write")
    write_table(t.spark, path, t.given("orders").where(OLD))
    write_table(t.spark, path, t.given("orders").where(f"not ({OLD})"), mode="append")
    return Dataset(t.spark, path).scan()


@query("write_layer", "SELECT c_custkey, c_name FROM customer")
def write_layer(t: Tables) -> DataFrame:
    layers = {"bronze": scratch_path(t.spark, "bronze"), "gold": scratch_path(t.spark, "gold")}
    path = scan.layer_path(layers, "gold", "customer")
    write_table(t.spark, path, t.given("customer").select("c_custkey", "c_name"))
    return Dataset(t.spark, path).scan()


@query(
    "materialize_report",
    """SELECT 'demo.orders' AS "table", count(*) AS n_rows, 'append' AS write_mode, false AS schema_evolved FROM orders
       UNION ALL SELECT 'demo.orders', count(*), 'overwrite', true FROM orders""",
)
def materialize_report_query(t: Tables) -> DataFrame:
    path, orders = scratch_path(t.spark, "report"), t.given("orders")
    name = scan.table_name(["demo", "orders"])
    reports = [
        materialize_report(t.spark, path, name, orders.drop("o_orderpriority")),
        materialize_report(t.spark, path, name, orders, {"write_mode": "overwrite"}),
    ]
    return t.spark.createDataFrame(
        reports,
        "table string, n_rows bigint, write_mode string, schema_evolved boolean",
    )


@query(
    "schema_evolve",
    f"""SELECT o_orderkey, o_totalprice, CASE WHEN {OLD_SQL} THEN NULL ELSE o_orderpriority END
          AS o_orderpriority FROM orders""",
)
def schema_evolve(t: Tables) -> DataFrame:
    table, orders = fresh(t, "evolve"), t.given("orders")
    table.append(orders.where(OLD).select("o_orderkey", "o_totalprice"))
    table.append(
        orders.where(f"not ({OLD})").select("o_orderkey", "o_totalprice", "o_orderpriority")
    )
    return table.scan()


@query(
    "schema_widen",
    f"""SELECT o_orderkey, CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE) AS price,
               CAST(CAST(o_totalprice AS DECIMAL(10,2)) AS DOUBLE) AS amount FROM orders WHERE {OLD_SQL}
        UNION ALL SELECT o_orderkey, o_totalprice, CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS DOUBLE)
        FROM orders WHERE NOT {OLD_SQL}""",
)
def schema_widen(t: Tables) -> DataFrame:
    """int to bigint, float to double and a wider decimal, read back as one table."""
    table, orders = fresh(t, "widen"), t.given("orders")
    table.append(
        orders.where(OLD).select(
            F.col("o_orderkey").cast("int").alias("o_orderkey"),
            F.col("o_totalprice").cast("float").alias("price"),
            F.col("o_totalprice").cast("decimal(10,2)").alias("amount"),
        )
    )
    table.append(
        orders.where(f"not ({OLD})").select(
            "o_orderkey",
            F.col("o_totalprice").alias("price"),
            F.col("o_totalprice").cast("decimal(14,2)").alias("amount"),
        )
    )
    return table.scan()


@query(
    "append_batches",
    "SELECT 3 AS n_batches, count(*) AS n_rows FROM orders",
)
def append_batches(t: Tables) -> DataFrame:
    table, orders = fresh(t, "batches"), t.given("orders")
    for status in ("F", "O", "P"):
        table.append(orders.where(F.col("o_orderstatus") == status), batch=f"status-{status}")
    table.append(orders.where("o_orderstatus = 'F'"), batch="status-F")  # a repeated batch replaces itself
    return table.partitions().agg(F.count("*").alias("n_batches"), F.sum("n_rows").alias("n_rows"))


@query("ctas", sql("SELECT customer_id, name, email FROM stg_customers"))
def ctas(t: Tables) -> DataFrame:
    """Create or replace a table from a model."""
    table = fresh(t, "ctas")
    table.overwrite(t.stg("customers").select("customer_id"))
    table.overwrite(t.stg("customers").select("customer_id", "name", "email"))
    return table.scan()


# --- layouts ---------------------------------------------------------------


def _layout_query(transform: str, pattern: str) -> None:
    @query(
        f"part_{transform}",
        f"""SELECT strftime(ts, '{pattern}') AS part, count(*) AS n_rows, sum(event_id)::BIGINT AS ids
            FROM events GROUP BY 1""",
    )
    def run(t: Tables) -> DataFrame:
        field = PartitionField("ts", transform)
        rows = layout.with_partitions(t.given("events").select("event_id", "ts"), [field])
        return rows.groupBy(F.col(field.name).alias("part")).agg(
            F.count("*").alias("n_rows"), F.sum("event_id").alias("ids")
        )


_layout_query("year", "%Y")
_layout_query("month", "%Y-%m")
_layout_query("day", "%Y-%m-%d")
_layout_query("hour", "%Y-%m-%d-%H")


@query("part_identity", "SELECT event_type AS part, count(*) AS n_rows FROM events GROUP BY 1")
def part_identity(t: Tables) -> DataFrame:
    field = PartitionField("event_type")
    return layout.partition_counts(t.given("events"), [field]).select(
        F.col(field.name).alias("part"), "n_rows"
    )


@query(
    "part_bucket",
    """SELECT ('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 13))::BIGINT % 16 AS bucket, count(*) AS n_rows FROM events GROUP BY 1""",
)
def part_bucket(t: Tables) -> DataFrame:
    """Rows per hash bucket of the user id."""
    field = PartitionField("user_id", "bucket", 16)
    return layout.partition_counts(t.given("events"), [field]).select(
        F.col(field.name).cast("int").alias("bucket"), "n_rows"
    )


@query(
    "part_truncate",
    """SELECT CAST(event_id - event_id % 1000 AS VARCHAR) AS id_part, substr(event_type, 1, 2) AS type_part,
              count(*) AS n_rows FROM events GROUP BY 1, 2""",
)
def part_truncate(t: Tables) -> DataFrame:
    fields = [PartitionField("event_id", "truncate", 1000), PartitionField("event_type", "truncate", 2)]
    return layout.partition_counts(t.given("events"), fields).select(
        F.col(fields[0].name).alias("id_part"), F.col(fields[1].name).alias("type_part"), "n_rows"
    )


@query(
    "part_default",
    "SELECT strftime(ts, '%Y-%m-%d') AS part, count(*) AS n_rows FROM events GROUP BY 1",
)
def part_default(t: Tables) -> DataFrame:
    fields = layout.default_partitioning(t.given("events"), "ts")
    return layout.partition_counts(t.given("events"), fields).select(
        F.col(fields[0].name).alias("part"), "n_rows"
    )


@query(
    "inspect_partitions",
    "SELECT strftime(o_orderdate, '%Y') AS part, count(*) AS n_rows FROM orders GROUP BY 1",
)
def inspect_partitions(t: Tables) -> DataFrame:
    """Rows per folder of a written table, from its partition column alone."""
    field = PartitionField("o_orderdate", "year")
    table = fresh(t, "inspect", field)
    table.append(t.given("orders"))
    return table.partitions().select(F.col(field.name).alias("part"), "n_rows")


# --- loads -----------------------------------------------------------------
# Each load is a folder of its own, so earlier states are plain filters on it.


def _loads(t: Tables, name: str, *parts: DataFrame) -> Dataset:
    table = fresh(t, name)
    for number, part in enumerate(parts, 1):
        table.append(part, batch=str(number))
    return table


def _two_loads(t: Tables, name: str) -> Dataset:
    orders = t.given("orders")
    return _loads(t, name, orders.where(OLD), orders.where(f"not ({OLD})"))


def _load() -> Column:
    return F.col(BATCH).cast("bigint")


@query("time_travel_id", f"SELECT {ORDER_COLUMNS} FROM orders WHERE {OLD_SQL}")
def time_travel_id(t: Tables) -> DataFrame:
    """The rows up to the first load."""
    return _two_loads(t, "travel").rows().where(_load() <= 1).drop(BATCH)


@query("time_travel_ts", f"SELECT {ORDER_COLUMNS} FROM orders WHERE {OLD_SQL}")
def time_travel_ts(t: Tables) -> DataFrame:
    """The rows in files that were there when the first load had ended."""
    rows = _two_loads(t, "travel").rows()
    written = F.col("_metadata.file_modification_time")
    ended = rows.where(_load() == 1).agg(F.max(written)).scalar()
    return rows.where(written <= ended).drop(BATCH)


def _history(table: Dataset) -> DataFrame:
    return table.partitions().select(_load().alias("snapshot_id"), F.lit("append").alias("operation"), "n_rows")


@query(
    "list_snapshots",
    f"""SELECT 2 AS snapshot_id, 'append' AS operation, count(*) AS n_rows FROM orders WHERE NOT {OLD_SQL}
        UNION ALL SELECT 1, 'append', count(*) FROM orders WHERE {OLD_SQL}""",
)
def list_snapshots(t: Tables) -> DataFrame:
    """Loads, newest first."""
    return _history(_two_loads(t, "list")).orderBy(F.desc("snapshot_id"))


@query(
    "current_snapshot",
    f"SELECT 2 AS snapshot_id, 'append' AS operation, count(*) AS n_rows FROM orders WHERE NOT {OLD_SQL}",
)
def current_snapshot(t: Tables) -> DataFrame:
    return _history(_two_loads(t, "current")).orderBy(F.desc("snapshot_id")).limit(1)


def _by_status(t: Tables, name: str) -> Dataset:
    """A load for each status, then the finished orders once more."""
    orders = t.given("orders")
    return _loads(t, name, *[orders.where(F.col("o_orderstatus") == s) for s in ("F", "O", "P", "F")])


@query(
    "expire_snapshots",
    """SELECT CASE o_orderstatus WHEN 'F' THEN 1 ELSE 2 END AS snapshot_id, 'append' AS operation,
              count(*) AS n_rows FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1""",
)
def expire_snapshots(t: Tables) -> DataFrame:
    """The loads that a rule which keeps the last two takes away."""
    history = _history(_by_status(t, "expire"))
    return history.where(F.col("snapshot_id") <= history.agg(F.max("snapshot_id") - 2).scalar())


@query(
    "vacuum_plan",
    """SELECT CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS snapshot_id,
              count(*) AS n_rows FROM orders GROUP BY 1""",
)
def vacuum_plan(t: Tables) -> DataFrame:
    """Loads that nothing reads once the last one holds all there is."""
    history = _history(_by_status(t, "vacuum")).drop("operation")
    return history.where(F.col("snapshot_id") < history.agg(F.max("snapshot_id")).scalar())


@query("compact_files", f"SELECT {ORDER_COLUMNS} FROM orders")
def compact_files(t: Tables) -> DataFrame:
    """Ten small loads are rewritten as one; the rows stay the same."""
    orders = t.given("orders")
    small = _loads(t, "small", *[orders.where(F.pmod("o_custkey", F.lit(10)) == i) for i in range(10)])
    large = fresh(t, "compact")
    large.append(small.scan().hint("rebalance"))
    return large.scan()


# --- upserts ---------------------------------------------------------------

define(
    "order_updates",
    """SELECT order_id, customer_id, 'completed' AS status, created_at + INTERVAL 1 HOUR AS created_at,
              total_amount FROM stg_orders WHERE created_at >= TIMESTAMP '2001-07-02'""",
)


def _updates(t: Tables) -> DataFrame:
    """Orders of the last thirty days, now completed."""
    return (
        t.stg("orders")
        .where("created_at >= timestamp_ntz'2001-07-02'")
        .select(
            "order_id",
            "customer_id",
            F.lit("completed").alias("status"),
            F.expr("created_at + interval 1 hour").alias("created_at"),
            "total_amount",
        )
    )


@query(
    "merge_upsert",
    sql(
        """WITH target AS (
             SELECT order_id, customer_id, status, created_at, total_amount FROM stg_orders
             UNION ALL SELECT order_id, customer_id, status, created_at, total_amount FROM stg_orders WHERE order_id % 7 = 0
             UNION ALL SELECT NULL, customer_id, status, created_at, total_amount FROM stg_orders WHERE order_id % 11 = 0)
           SELECT order_id, customer_id, status, created_at, CAST(total_amount AS DOUBLE) AS total_amount FROM target
           WHERE order_id IS NULL OR order_id NOT IN (SELECT order_id FROM order_updates)
           UNION ALL SELECT order_id, customer_id, status, created_at, CAST(total_amount AS DOUBLE) FROM order_updates"""
    ),
)
def merge_upsert(t: Tables) -> DataFrame:
    """Upsert into a table partitioned by month; only the touched months are rewritten.

    The target has repeated keys and null keys in months that change and in others; every row without an update stays.
    """
    table = fresh(t, "merge", PartitionField("created_at", "month"))
    orders = t.stg("orders").select("order_id", "customer_id", "status", "created_at", "total_amount")
    none = orders.where("order_id % 11 = 0").withColumn("order_id", F.lit(None).cast("bigint"))
    table.append(orders.unionByName(orders.where("order_id % 7 = 0")).unionByName(none))
    table.merge(_updates(t), ["order_id"], "created_at")
    return table.scan()


@query(
    "scan_pruned_by_row_filter",
    """SELECT event_id, user_id, event_type, ts FROM events
       WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-09 12:00:00' AND user_id = 5""",
)
def scan_pruned_by_row_filter(t: Tables) -> DataFrame:
    """A row filter on the columns that the layout is derived from opens the folders of five days and one bucket."""
    table = fresh(t, "events", PartitionField("ts", "day"), PartitionField("user_id", "bucket", 8))
    table.append(t.given("events"))
    wanted = "ts >= timestamp_ntz'2024-01-05' and ts < timestamp_ntz'2024-01-09 12:00:00' and user_id = 5"
    return table.scan(["event_id", "user_id", "event_type", "ts"], wanted)


@query(
    "incremental_high_water",
    sql(
        """SELECT order_id, customer_id, status, created_at, CAST(total_amount AS DOUBLE) AS total_amount
           FROM stg_orders"""
    ),
)
def incremental_high_water(t: Tables) -> DataFrame:
    columns = ["order_id", "customer_id", "status", "created_at", "total_amount"]
    orders = t.stg("orders").select(*columns)
    loaded = orders.where("created_at < timestamp_ntz'2000-01-01'")
    return upsert(loaded, high_water(orders, loaded, "created_at"), ["order_id"], "created_at")
