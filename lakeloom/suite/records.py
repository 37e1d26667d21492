"""Partition keys, backfill, and run and lineage records."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.operators import partitions, runs
from lakeloom.session import scratch_path
from lakeloom.sources.layout import PartitionField
from lakeloom.sources.scan import in_partition
from lakeloom.sources.datasets import Dataset
from lakeloom.suite.base import Tables, query
from lakeloom.suite.ctes import define, sql

define(
    "month_keys",
    """SELECT strftime(stamp, '%Y-%m') AS partition_key, row_number() OVER (ORDER BY stamp) - 1 AS idx
       FROM (SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)),
                           date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH)) AS stamp FROM orders)""",
)


def _keys(t: Tables, frequency: str) -> DataFrame:
    return partitions.time_keys_of(t.given("orders"), "o_orderdate", frequency)


def _time_keys(name: str, frequency: str, step: str, fmt: str) -> None:
    @query(
        name,
        f"""SELECT strftime(stamp, '{fmt}') AS partition_key, row_number() OVER (ORDER BY stamp) - 1 AS "index"
            FROM (SELECT unnest(generate_series(CAST(date_trunc('{frequency}', min(o_orderdate)) AS TIMESTAMP),
                  max(o_orderdate), INTERVAL {step})) AS stamp FROM orders)""",
    )
    def run(t: Tables) -> DataFrame:
        return _keys(t, frequency)


_time_keys("partition_keys_hourly", "hour", "1 HOUR", "%Y-%m-%d-%H")
_time_keys("partition_keys_daily", "day", "1 DAY", "%Y-%m-%d")
_time_keys("partition_keys_weekly", "week", "7 DAY", "%Y-%m-%d")
_time_keys("partition_keys_monthly", "month", "1 MONTH", "%Y-%m")


@query(
    "partition_keys_static",
    """SELECT partition_key, count(o_orderkey) AS n_rows
       FROM (VALUES ('F'), ('O'), ('P'), ('X')) k(partition_key)
       LEFT JOIN orders ON o_orderstatus = partition_key GROUP BY 1""",
)
def partition_keys_static(t: Tables) -> DataFrame:
    """Rows per static key, keys without rows included."""
    keys = partitions.static_keys(t.spark, ["F", "O", "P", "X"])
    held = t.given("orders").groupBy(F.col("o_orderstatus").alias("partition_key")).agg(
        F.count("*").alias("n")
    )
    return keys.join(held, "partition_key", "left").select(
        "partition_key", F.coalesce("n", F.lit(0)).alias("n_rows")
    )


@query(
    "partition_keys_multi",
    sql(
        """SELECT partition_key || '|' || region AS partition_key, region
           FROM month_keys, (VALUES ('ASIA'), ('EUROPE')) r(region)"""
    ),
)
def partition_keys_multi(t: Tables) -> DataFrame:
    return partitions.multi_keys(_keys(t, "month"), {"region": ["ASIA", "EUROPE"]})


@query(
    "partition_keys_dynamic",
    "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS partition_key FROM orders WHERE o_custkey IS NOT NULL",
)
def partition_keys_dynamic(t: Tables) -> DataFrame:
    return partitions.dynamic_keys(t.given("orders"), "o_custkey")


@query(
    "partition_latest",
    sql(
        """SELECT 'latest' AS selector, max(partition_key) AS first_key, count(DISTINCT 1) AS n FROM month_keys
           UNION ALL SELECT 'all', min(partition_key), count(*) FROM month_keys"""
    ),
)
def partition_latest(t: Tables) -> DataFrame:
    keys = _keys(t, "month")
    parts = [
        partitions.select_keys(keys, s).agg(
            F.lit(s).alias("selector"),
            F.min("partition_key").alias("first_key"),
            F.count("*").alias("n"),
        )
        for s in ("latest", "all")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "backfill_plan",
    sql(
        """SELECT partition_key, CAST(floor((row_number() OVER (ORDER BY partition_key) - 1) / 5) AS BIGINT) AS batch
           FROM month_keys WHERE partition_key BETWEEN '1996-03' AND '1999-10'"""
    ),
)
def backfill_plan(t: Tables) -> DataFrame:
    return partitions.backfill_plan(_keys(t, "month"), "1996-03", "1999-10", 5)


@query(
    "backfill_run",
    sql(
        """SELECT strftime(o_orderdate, '%Y') AS partition_key, count(*) AS n_rows
           FROM orders WHERE strftime(o_orderdate, '%Y') BETWEEN '1996' AND '1999' GROUP BY 1"""
    ),
)
def backfill_run(t: Tables) -> DataFrame:
    """Four years in batches of two; one job per batch."""
    years = partitions.time_keys_of(t.given("orders"), "o_orderdate", "month", "yyyy")
    keys = years.groupBy("partition_key").agg(F.floor(F.min("index") / 12).alias("index"))
    field = PartitionField("o_orderdate", "year")
    table = Dataset(t.spark, scratch_path(t.spark, "backfill"), [field])
    orders = t.given("orders")

    def load(batch: list[str]) -> None:
        table.overwrite_partitions(in_partition(orders, "o_orderdate", batch[0], batch[-1]))

    partitions.run_backfill(partitions.backfill_plan(keys, "1996", "1999", 2), load)
    return table.partitions().select(F.col(field.name).alias("partition_key"), "n_rows")


@query(
    "backfill_resumed",
    sql(
        """SELECT partition_key, n_rows, runs FROM (
             SELECT strftime(o_orderdate, '%Y') AS partition_key, count(*) AS n_rows, 1 AS runs
             FROM orders WHERE strftime(o_orderdate, '%Y') BETWEEN '1995' AND '2000' GROUP BY 1)"""
    ),
)
def backfill_resumed(t: Tables) -> DataFrame:
    """A backfill of six years breaks in its second batch; run again, two batches at a time, it does what is left and no year twice."""
    years = partitions.time_keys_of(t.given("orders"), "o_orderdate", "month", "yyyy")
    keys = years.groupBy("partition_key").agg(F.floor(F.min("index") / 12).alias("index"))
    plan = partitions.backfill_plan(keys, "1995", "2000", 2)
    table = Dataset(t.spark, scratch_path(t.spark, "resumed"), [PartitionField("o_orderdate", "year")])
    done, runs_of = (Dataset(t.spark, scratch_path(t.spark, name)) for name in ("done", "runs-of"))
    table.overwrite_partitions(t.given("orders").limit(0))

    def load(batch: list[str], breaks: str = "") -> None:
        if breaks in batch:
            raise RuntimeError("lost the driver")
        table.overwrite_partitions(in_partition(t.given("orders"), "o_orderdate", batch[0], batch[-1]))
        runs_of.append(t.spark.createDataFrame([(k,) for k in batch], "partition_key string"))

    try:
        partitions.run_backfill(plan, lambda batch: load(batch, "1998"), done)
    except RuntimeError:
        pass
    partitions.run_backfill(plan, load, done, together=2)
    times = runs_of.scan().groupBy("partition_key").agg(F.count("*").alias("runs"))
    counts = table.partitions().select(F.col("_p_o_orderdate_year").alias("partition_key"), "n_rows")
    return counts.join(times, "partition_key", "left")


@query(
    "missing_partitions",
    """SELECT strftime(stamp, '%Y-%m-%d') AS partition_key
       FROM (SELECT unnest(generate_series(CAST(date_trunc('day', min(o_orderdate)) AS TIMESTAMP),
             max(o_orderdate), INTERVAL 1 DAY)) AS stamp FROM orders)
       WHERE stamp NOT IN (SELECT date_trunc('day', o_orderdate) FROM orders WHERE o_totalprice > 250000)""",
)
def missing_partitions(t: Tables) -> DataFrame:
    """Days without a large order."""
    large = t.given("orders").where("o_totalprice > 250000")
    return partitions.missing_keys(
        _keys(t, "day"), large, F.date_format("o_orderdate", "yyyy-MM-dd")
    )


@query(
    "partition_isolation",
    """SELECT o_orderkey, o_orderdate, CASE WHEN strftime(o_orderdate, '%Y-%m') = '1997-03'
         THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders""",
)
def partition_isolation(t: Tables) -> DataFrame:
    """A second run for one month doubles its amounts and touches nothing else."""
    table = Dataset(
        t.spark, scratch_path(t.spark, "isolation"), [PartitionField("o_orderdate", "month")]
    )
    orders = t.given("orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    table.append(orders)
    month = in_partition(orders, "o_orderdate", "1997-03")
    table.overwrite_partitions(month.withColumn("o_totalprice", F.col("o_totalprice") * 2))
    return table.scan()


# --- runs ------------------------------------------------------------------

# One run per user and day: its first event starts it, its last one ends it.
define(
    "run_log",
    """SELECT user_id, CAST(ts AS DATE) AS day, user_id || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id,
              min_by(ts, (ts, event_id)) AS started_at, max_by(ts, (ts, event_id)) AS ended_at,
              CASE WHEN max_by(event_type, (ts, event_id)) = 'error' THEN 'FAIL' ELSE 'COMPLETE' END AS status,
              count(*) AS n_rows
       FROM events GROUP BY 1, 2, 3""",
)


def run_log(t: Tables) -> DataFrame:
    """Run events derived from the activity table."""
    order = F.struct("timestamp", "event_id")
    ends = (
        t.raw("events")
        .groupBy("user_id", F.to_date("timestamp").alias("day"))
        .agg(
            F.min("timestamp").alias("first"),
            F.max("timestamp").alias("last"),
            F.max_by("event_type", order).alias("kind"),
            F.count("*").alias("n"),
        )
    )
    run_id = F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("day", "yyyy-MM-dd"))
    end_type = F.when(F.col("kind") == "error", "FAIL").otherwise("COMPLETE")
    none = F.lit(None).cast("bigint")
    pair = F.array(
        F.struct(F.lit("START").alias("event_type"), F.col("first").alias("event_time"), none.alias("n_rows")),
        F.struct(end_type.alias("event_type"), F.col("last").alias("event_time"), F.col("n").alias("n_rows")),
    )
    job = F.concat(F.lit("user_"), F.col("user_id").cast("string"))
    return ends.select(run_id.alias("run_id"), job.alias("job"), F.inline(pair))


@query(
    "run_summary",
    sql(
        """SELECT run_id, started_at, ended_at, status, n_rows,
                  date_diff('microsecond', started_at, ended_at) // 1000000 AS seconds FROM run_log"""
    ),
)
def run_summary(t: Tables) -> DataFrame:
    return runs.run_summary(run_log(t))


@query(
    "run_status_since",
    sql(
        """SELECT run_id, 'user_' || user_id AS job, ended_at AS event_time FROM run_log
           WHERE status = 'FAIL' AND ended_at > TIMESTAMP '2024-01-15' AND user_id IN (1, 2, 3, 5, 8)"""
    ),
)
def run_status_since(t: Tables) -> DataFrame:
    jobs = [f"user_{i}" for i in (1, 2, 3, 5, 8)]
    rows = runs.run_status_since(run_log(t), "FAIL", datetime(2024, 1, 15), jobs)
    return rows.select("run_id", "job", "event_time")


@query(
    "run_events",
    """SELECT 'customers' AS job, 'START' AS event_type, NULL::BIGINT AS n_rows, NULL::VARCHAR AS error
       UNION ALL SELECT 'customers', 'COMPLETE', count(*), NULL FROM customer
       UNION ALL SELECT 'orders', 'START', NULL, NULL
       UNION ALL SELECT 'orders', 'FAIL', NULL, 'login failed: [REDACTED]'""",
)
def run_events(t: Tables) -> DataFrame:
    """One step that completes and one that fails; the secret in its error is removed."""
    log = runs.RunLog(t.spark, scratch_path(t.spark, "runs"))
    table = Dataset(t.spark, scratch_path(t.spark, "customers"))
    with log.asset_run("customers", outputs=["bronze.customers"]) as run:
        run.n_rows = table.append(t.given("customer")).n_rows
    try:
        with log.asset_run("orders", inputs=["bronze.customers"]):
            raise RuntimeError("login failed: password = 'hunter2'")
    except RuntimeError:
        pass
    return log.read().select("job", "event_type", "n_rows", "error")


@query(
    "lineage_upstream",
    """WITH RECURSIVE up(target, ancestor, depth) AS (
         SELECT c_custkey, c_custkey // 2, 1 FROM customer
         WHERE c_custkey > 0 AND c_custkey NOT IN (SELECT c_custkey // 2 FROM customer WHERE c_custkey > 0)
         UNION ALL SELECT target, ancestor // 2, depth + 1 FROM up WHERE ancestor > 0)
       SELECT target, ancestor, CAST(depth AS BIGINT) AS depth FROM up""",
)
def lineage_upstream(t: Tables) -> DataFrame:
    """Every ancestor of the models nothing depends on; a model's parent is half its key."""
    edges = t.given("customer").where("c_custkey > 0").select(
        F.col("c_custkey").alias("child"), F.expr("c_custkey div 2").alias("parent")
    )
    leaves = edges.join(
        edges.select(F.col("parent").alias("used")), F.col("child") == F.col("used"), "left_anti"
    )
    return runs.upstream(edges, leaves.select(F.col("child").alias("node")))


# A model depends on the model of half its number; the first three of every hundred also on each other in a circle.
LINEAGE = """links AS (
    SELECT c_custkey AS node, c_custkey // 2 AS ancestor FROM customer WHERE c_custkey > 1
    UNION SELECT -c_custkey, -CASE WHEN c_custkey % 100 = 3 THEN c_custkey - 2 ELSE c_custkey + 1 END
    FROM customer WHERE c_custkey % 100 IN (1, 2, 3) AND (c_custkey // 100) * 100 + 3 <= (SELECT max(c_custkey) FROM customer))"""


def _links(t: Tables) -> DataFrame:
    keys = t.given("customer").select("c_custkey")
    top = keys.agg(F.max("c_custkey")).scalar()
    tree = keys.where("c_custkey > 1").selectExpr("c_custkey AS child", "c_custkey div 2 AS parent")
    ring = keys.where("c_custkey % 100 in (1, 2, 3)").where(F.expr("(c_custkey div 100) * 100 + 3") <= top)
    return tree.unionByName(ring.selectExpr("-c_custkey AS child", "-if(c_custkey % 100 = 3, c_custkey - 2, c_custkey + 1) AS parent"))


@query(
    "lineage_closure",
    f"""WITH RECURSIVE {LINEAGE},
        ways(node, ancestor, depth) AS (SELECT node, ancestor, 1 FROM links
          UNION SELECT w.node, l.ancestor, w.depth + 1 FROM ways w JOIN links l ON w.ancestor = l.node WHERE w.depth < 40 AND (w.node > 0 OR w.depth < 3))
        SELECT node, ancestor, CAST(min(depth) AS BIGINT) AS depth FROM ways GROUP BY node, ancestor""",
)
def lineage_closure(t: Tables) -> DataFrame:
    """All ancestors of all models with their least distance, by doubling; circles among them."""
    return runs.closure(_links(t))


@query(
    "lineage_circles",
    f"""WITH {LINEAGE} SELECT node, -((-node) // 100 * 100 + 3) AS circle FROM links WHERE node < 0""",
)
def lineage_circles(t: Tables) -> DataFrame:
    """Models that depend on themselves, named by the least of their circle."""
    return runs.circles(runs.closure(_links(t)))


@query(
    "schema_facet",
    """SELECT 'demo.region' AS dataset, 'r_regionkey' AS name, 'int' AS type, NULL::VARCHAR AS description,
              count(r_regionkey) AS n_values FROM region
       UNION ALL SELECT 'demo.region', 'r_name', 'string', 'Name of the region', count(r_name) FROM region
       UNION ALL SELECT 'demo.customer', c, k, NULL, n FROM (
         SELECT unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) AS c,
                unnest(['bigint', 'string', 'int', 'double', 'string']) AS k,
                unnest([count(c_custkey), count(c_name), count(c_nationkey), count(c_acctbal), count(c_mktsegment)]) AS n
         FROM customer)""",
)
def schema_facet(t: Tables) -> DataFrame:
    described = t.given("region").withColumn(
        "r_name", F.col("r_name").alias("r_name", metadata={"description": "Name of the region"})
    )
    return runs.schema_facet(described, "demo.region").unionByName(
        runs.schema_facet(t.given("customer"), "demo.customer")
    )
