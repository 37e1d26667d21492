"""Data quality and governance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeloom.operators import generate, governance, quality
from lakeloom.operators.governance import Action, Policy
from lakeloom.session import scratch_path
from lakeloom.suite import draw_sql
from lakeloom.suite.base import Tables, query
from lakeloom.suite.ctes import sql

AS_OF = "2001-08-02 00:00:00"
STATUSES = ["completed", "pending", "cancelled", "failed"]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE"]


def _result(check: str, table: str, column: str, failed: str, source: str) -> str:
    return f"""SELECT '{check}' AS "check", '{table}' AS "table", '{column}' AS "column",
        count(*) AS n_rows, count(*) FILTER (WHERE {failed}) AS n_failed FROM {source}"""


DIRTY_SQL = "(SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_name END AS name, c_mktsegment FROM customer)"


def _dirty_customers(t: Tables) -> DataFrame:
    """Customers in debt lose their name."""
    return t.given("customer").select(
        "c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("name"), "c_mktsegment"
    )


@query(
    "dq_not_null",
    " UNION ALL ".join(
        _result("not_null", "customers", c, f"{c} IS NULL", DIRTY_SQL)
        for c in ("c_custkey", "name", "c_mktsegment")
    ),
)
def dq_not_null(t: Tables) -> DataFrame:
    columns = ["c_custkey", "name", "c_mktsegment"]
    checks = [quality.not_null(c) for c in columns]
    return quality.check_rows(_dirty_customers(t), "customers", checks)


@query(
    "dq_unique",
    sql(
        """SELECT 'unique' AS "check", 'raw_order_items' AS "table", 'order_item_id' AS "column",
             CAST(sum(n) AS BIGINT) AS n_rows, count(*) FILTER (WHERE n > 1) AS n_failed
           FROM (SELECT order_item_id, count(*) AS n FROM raw_order_items GROUP BY 1)
           UNION ALL
           SELECT 'unique', 'stg_order_items', 'order_item_id', CAST(sum(n) AS BIGINT), count(*) FILTER (WHERE n > 1)
           FROM (SELECT order_item_id, count(*) AS n FROM stg_order_items GROUP BY 1)"""
    ),
)
def dq_unique(t: Tables) -> DataFrame:
    raw = quality.unique(t.raw("order_items"), "raw_order_items", ["order_item_id"])
    clean = quality.unique(t.stg("order_items"), "stg_order_items", ["order_item_id"])
    return raw.unionByName(clean)


@query(
    "dq_unique_composite",
    """SELECT 'unique' AS "check", 'lineitem' AS "table", 'l_orderkey,l_partkey' AS "column",
         CAST(sum(n) AS BIGINT) AS n_rows, count(*) FILTER (WHERE n > 1) AS n_failed
       FROM (SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2)""",
)
def dq_unique_composite(t: Tables) -> DataFrame:
    return quality.unique(t.given("lineitem"), "lineitem", ["l_orderkey", "l_partkey"])


@query(
    "dq_accepted_values",
    sql(
        _result(
            "accepted_values", "orders", "status", "status NOT IN ('completed', 'pending', 'cancelled', 'failed')",
            "stg_orders",
        )
        + " UNION ALL "
        + _result(
            "accepted_values", "orders", "region", "region NOT IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE')",
            "stg_orders",
        )
    ),
)
def dq_accepted_values(t: Tables) -> DataFrame:
    checks = [
        quality.accepted_values("status", STATUSES),
        quality.accepted_values("region", REGIONS),
    ]
    return quality.check_rows(t.stg("orders"), "orders", checks)


@query(
    "dq_relationships",
    sql(
        """SELECT 'relationships' AS "check", 'lineitem' AS "table", 'l_orderkey' AS "column", count(*) AS n_rows,
             count(*) FILTER (WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'))
               AS n_failed FROM lineitem
           UNION ALL
           SELECT 'relationships', 'orders', 'o_custkey', count(*),
             count(*) FILTER (WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) FROM orders"""
    ),
)
def dq_relationships(t: Tables) -> DataFrame:
    """Lines of open and finished orders, and customers of orders."""
    known = t.given("orders").where("o_orderstatus <> 'P'")
    lines = quality.relationships(t.given("lineitem"), "lineitem", "l_orderkey", known, "o_orderkey")
    people = quality.relationships(
        t.given("orders"), "orders", "o_custkey", t.given("customer"), "c_custkey"
    )
    return lines.unionByName(people)


@query(
    "dq_orphan_rows",
    """SELECT o_orderkey, o_custkey FROM orders
       WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
)
def dq_orphan_rows(t: Tables) -> DataFrame:
    parents = t.given("customer").where("c_acctbal > 0")
    rows = t.given("orders").select("o_orderkey", "o_custkey")
    return quality.orphans(rows, "o_custkey", parents, "c_custkey")


@query(
    "dq_schema",
    """SELECT 'o_comment' AS "column", 'missing' AS problem, 'string' AS expected, NULL::VARCHAR AS actual, count(*) AS n_rows FROM orders
       UNION ALL SELECT 'o_orderpriority', 'unexpected', NULL, 'string', count(*) FROM orders
       UNION ALL SELECT 'o_totalprice', 'type', 'decimal(10,2)', 'double', count(*) FROM orders""",
)
def dq_schema(t: Tables) -> DataFrame:
    expected = StructType.fromDDL(
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice decimal(10,2),"
        " o_orderdate timestamp_ntz, o_comment string"
    )
    return quality.schema_drift(t.given("orders"), expected)


@query(
    "dq_null_pct",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS n_rows, count(*) FILTER (WHERE {c} IS NULL) AS n_null,
            count(*) FILTER (WHERE {c} IS NULL) * 100.0::DOUBLE / count(*) AS pct,
            count(*) FILTER (WHERE {c} IS NULL) * 100.0::DOUBLE / count(*) > 5 AS failed FROM {DIRTY_SQL}"""
        for c in ("c_custkey", "name", "c_mktsegment")
    ),
)
def dq_null_pct(t: Tables) -> DataFrame:
    return quality.null_percentage(_dirty_customers(t), ["c_custkey", "name", "c_mktsegment"], 5)


@query(
    "dq_value_range",
    _result("value_range", "lineitem", "l_quantity", "l_quantity < 1 OR l_quantity > 45", "lineitem")
    + " UNION ALL "
    + _result("value_range", "lineitem", "l_discount", "l_discount > 0.08", "lineitem"),
)
def dq_value_range(t: Tables) -> DataFrame:
    checks = [quality.value_range("l_quantity", 1, 45), quality.value_range("l_discount", high=0.08)]
    return quality.check_rows(t.given("lineitem"), "lineitem", checks)


@query(
    "dq_freshness",
    f"""SELECT max(o_orderdate) AS newest,
          date_diff('second', max(o_orderdate), TIMESTAMP '{AS_OF}') / 3600.0::DOUBLE AS age_hours,
          date_diff('second', max(o_orderdate), TIMESTAMP '{AS_OF}') / 3600.0::DOUBLE > 12 AS failed FROM orders""",
)
def dq_freshness(t: Tables) -> DataFrame:
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    return quality.freshness(t.given("orders"), "o_orderdate", as_of, 12)


RULE_SQL = {
    "customer_id": "customer_id >= 1",
    "name": "length(name) BETWEEN 1 AND 200",
    "email": r"length(email) BETWEEN 5 AND 254 AND regexp_matches(email, '^[\w.\-+]+@[\w.\-]+\.\w+$')",
    "region": "region IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE')",
    "created_at": "created_at IS NOT NULL",
}


@query(
    "dq_row_rules",
    sql(
        " UNION ALL ".join(
            f"""SELECT '{rule}' AS rule, count(*) AS n_rows,
                count(*) FILTER (WHERE NOT coalesce({condition}, false)) AS n_failed FROM raw_customers"""
            for rule, condition in RULE_SQL.items()
        )
    ),
)
def dq_row_rules(t: Tables) -> DataFrame:
    return quality.rule_counts(t.raw("customers"), quality.customer_rules(REGIONS))


@query(
    "dq_checked_write",
    sql(
        " UNION ALL ".join(
            f"""SELECT '{rule}' AS rule, count(*) AS n_rows,
                count(*) FILTER (WHERE NOT coalesce({condition}, false)) AS n_failed FROM stg_customers"""
            for rule, condition in RULE_SQL.items()
        )
        + " UNION ALL SELECT 'any', count(*), count(*) FILTER (WHERE NOT ("
        + " AND ".join(f"coalesce({condition}, false)" for condition in RULE_SQL.values())
        + ")) FROM stg_customers"
    ),
)
def dq_checked_write(t: Tables) -> DataFrame:
    """Counts observed by the write that parts kept and broken rows, beside what was written."""
    done = quality.write_checked(t.stg("customers"), quality.customer_rules(REGIONS), scratch_path(t.spark, "checked"))
    written = done.broken.select(F.lit(1).alias("bad")).unionByName(done.kept.select(F.lit(0).alias("bad")))
    return done.counts().unionByName(written.agg(F.lit("any").alias("rule"), F.count("*").alias("n_rows"), F.sum("bad").alias("n_failed")))


@query(
    "quarantine_rows",
    sql(
        "SELECT * FROM (SELECT customer_id, email, concat_ws(',', "
        + ", ".join(
            f"CASE WHEN NOT coalesce({condition}, false) THEN '{rule}' END"
            for rule, condition in RULE_SQL.items()
        )
        + ") AS failed_rules FROM stg_customers) WHERE failed_rules <> ''"
    ),
)
def quarantine_rows(t: Tables) -> DataFrame:
    _, bad = quality.quarantine(t.stg("customers"), quality.customer_rules(REGIONS))
    return bad.select("customer_id", "email", F.array_join("failed_rules", ",").alias("failed_rules"))


@query(
    "valid_rows",
    sql(
        """SELECT order_id, status FROM stg_orders WHERE order_id >= 1 AND customer_id >= 1
           AND status IN ('pending', 'processing', 'completed', 'cancelled')
           AND region IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE')"""
    ),
)
def valid_rows(t: Tables) -> DataFrame:
    good, _ = quality.quarantine(t.stg("orders"), quality.order_rules(REGIONS))
    return good.select("order_id", "status")


# --- governance ------------------------------------------------------------

CLASSES = {
    "name": {"classification": "pii", "pii_type": "name", "sensitivity": "high"},
    "email": {"classification": "pii", "pii_type": "email", "sensitivity": "high"},
    "region": {"classification": "internal"},
}


def _classified(t: Tables) -> DataFrame:
    return governance.classify(t.stg("customers"), CLASSES)


CLASS_ROWS = [
    ("name", "pii", "'name'", "high"),
    ("email", "pii", "'email'", "high"),
    ("region", "internal", "NULL::VARCHAR", "medium"),
]


@query(
    "column_classes",
    sql(
        " UNION ALL ".join(
            f"""SELECT 'customers' AS "table", '{c}' AS "column", '{k}' AS class, {p} AS pii_type,
                '{s}' AS sensitivity, count({c}) AS n_values FROM stg_customers"""
            for c, k, p, s in CLASS_ROWS
        )
    ),
)
def column_classes(t: Tables) -> DataFrame:
    return governance.column_classes(_classified(t), "customers")


@query(
    "class_facet",
    sql(
        """SELECT 'customers' AS "table", 'email:pii,name:pii,region:internal' AS classes
           FROM stg_customers HAVING count(*) > 0"""
    ),
)
def class_facet(t: Tables) -> DataFrame:
    facet = governance.class_facet(governance.column_classes(_classified(t), "customers"))
    entries = F.transform("classes", lambda c: F.concat_ws(":", c["column"], c["class"]))
    return facet.select("table", F.array_join(entries, ",").alias("classes"))


@query(
    "mask_email",
    sql("SELECT customer_id, '***' || substr(email, strpos(email, '@')) AS email FROM stg_customers"),
)
def mask_email(t: Tables) -> DataFrame:
    return t.stg("customers").select("customer_id", governance.mask_email("email").alias("email"))


@query(
    "mask_keep_last",
    sql(
        """SELECT customer_id, repeat('*', CAST(greatest(length(name) - 4, 0) AS INTEGER)) || right(name, 4) AS name
           FROM stg_customers"""
    ),
)
def mask_keep_last(t: Tables) -> DataFrame:
    return t.stg("customers").select("customer_id", governance.mask_keep_last("name").alias("name"))


@query("hash_column", sql("SELECT customer_id, sha256('pepper' || email) AS email FROM stg_customers"))
def hash_column(t: Tables) -> DataFrame:
    hashed = governance.hash_value("email", "pepper")
    return t.stg("customers").select("customer_id", hashed.alias("email"))


@query("redact_column", sql("SELECT customer_id, NULL::VARCHAR AS email, region FROM stg_customers"))
def redact_column(t: Tables) -> DataFrame:
    customers = t.stg("customers")
    kind = customers.schema["email"].dataType
    return customers.select("customer_id", governance.redact(kind).alias("email"), "region")


@query("restrict_columns", sql("SELECT customer_id, region, created_at FROM stg_customers"))
def restrict_columns(t: Tables) -> DataFrame:
    needed = {"name": ["data_owner"], "email": ["data_owner", "compliance"], "region": ["analyst"]}
    return governance.restrict(t.stg("customers"), needed, ["analyst"])


def _fake(column: str, words: list[str], name: str) -> str:
    return draw_sql.pick(words, draw_sql.u(name, column))


@query(
    "synthesize_column",
    sql(
        f"""SELECT customer_id, {_fake("name", generate.FIRST, "first")} || ' ' || {_fake("name", generate.LAST, "last")} AS name,
                   lower({_fake("email", generate.FIRST, "first")}) || '.' || lower({_fake("email", generate.LAST, "last")})
                     || {draw_sql.whole(0, 9999, draw_sql.u("number", "email"))} || '@' || {_fake("email", generate.HOSTS, "host")} AS email
            FROM stg_customers"""
    ),
)
def synthesize_column(t: Tables) -> DataFrame:
    """Made-up names and addresses, the same for the same customer."""
    return t.stg("customers").select(
        "customer_id",
        governance.synthesize("name").alias("name"),
        governance.synthesize("email", pii_type="email").alias("email"),
    )


@query(
    "apply_policy",
    sql(
        """SELECT customer_id, '***' || substr(email, strpos(email, '@')) AS email,
                  NULL::VARCHAR AS region, created_at, sha256('pepper' || customer_id) AS account_code
           FROM stg_customers"""
    ),
)
def apply_policy(t: Tables) -> DataFrame:
    """Names are restricted, addresses masked, regions redacted, codes hashed by their name."""
    classes = {
        "name": {"classification": "pii"},
        "email": {"classification": "contact"},
        "region": {"classification": "internal"},
    }
    rows = t.stg("customers").withColumn("account_code", F.col("customer_id").cast("string"))
    policies = {
        "pii": Policy(Action("restrict", ("data_owner",)), Action("synthesize")),
        "contact": Policy(Action("mask"), Action("redact")),
        "internal": Policy(Action("redact")),
    }
    return governance.apply_policies(
        governance.classify(rows, classes),
        policies,
        "production",
        roles=["analyst"],
        patterns=[("*code*", "hash")],
        salt="pepper",
    )


@query(
    "retention_split",
    sql(
        f"""SELECT disposition, count(*) AS n FROM (
             SELECT CASE WHEN date_diff('day', CAST(created_at AS DATE), DATE '2001-08-02') > 1825 THEN 'drop'
                         WHEN date_diff('day', CAST(created_at AS DATE), DATE '2001-08-02') > 730 THEN 'archive'
                         ELSE 'keep' END AS disposition FROM stg_orders) GROUP BY 1"""
    ),
)
def retention_split(t: Tables) -> DataFrame:
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    split = governance.retention_split(t.stg("orders"), "created_at", as_of, 1825, 730)
    return split.groupBy("disposition").agg(F.count("*").alias("n"))


@query(
    "class_violations",
    sql(
        """SELECT * FROM (
             SELECT 'name' AS "column", 'pii' AS class, 'masking_required' AS requirement, count(name) AS n_rows FROM stg_customers
             UNION ALL SELECT 'name', 'pii', 'retention', count(*) FILTER (WHERE date_diff('day', CAST(created_at AS DATE), DATE '1995-02-01') > 365) FROM stg_customers
             UNION ALL SELECT 'email', 'pii', 'retention', count(*) FILTER (WHERE date_diff('day', CAST(created_at AS DATE), DATE '1995-02-01') > 365) FROM stg_customers
             UNION ALL SELECT 'region', 'internal', 'retention', count(*) FILTER (WHERE date_diff('day', CAST(created_at AS DATE), DATE '1995-02-01') > 730) FROM stg_customers)
           WHERE n_rows > 0"""
    ),
)
def class_violations(t: Tables) -> DataFrame:
    as_of = F.lit("1995-02-01 00:00:00").cast("timestamp_ntz")
    return governance.class_violations(_classified(t), {"email": "mask"}, "created_at", as_of)
