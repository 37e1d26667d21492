"""Data-quality checks as one small table of counts, and row rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeloom.functions.clean import EMAIL_PATTERN
from lakeloom.operators.generate import (
    CATEGORIES,
    EVENT_WEIGHTS,
    PLAN_WEIGHTS,
    REGION_WEIGHTS,
    STATUS_WEIGHTS,
    SUBSCRIPTION_WEIGHTS,
)

RESULT = ["check", "table", "column", "n_rows", "n_failed"]


class QualityError(ValueError):
    """At least one check failed and the caller asked to stop on that."""


@dataclass(frozen=True)
class RowCheck:
    """A condition every row must meet; a null outcome counts as met."""

    check: str
    column: str
    condition: Column


def not_null(column: str) -> RowCheck:
    return RowCheck("not_null", column, F.col(column).isNotNull())


def accepted_values(column: str, values: Sequence) -> RowCheck:
    return RowCheck("accepted_values", column, F.col(column).isin(*values))


def value_range(column: str, low=None, high=None) -> RowCheck:
    condition = F.lit(True)
    if low is not None:
        condition = condition & (F.col(column) >= F.lit(low))
    if high is not None:
        condition = condition & (F.col(column) <= F.lit(high))
    return RowCheck("value_range", column, condition)


def check_rows(df: DataFrame, table: str, checks: Sequence[RowCheck]) -> DataFrame:
    """All row checks of a table in one pass over it."""
    failed = [
        F.count_if(~F.coalesce(c.condition, F.lit(True))).alias(f"f{i}")
        for i, c in enumerate(checks)
    ]
    counts = df.agg(F.count("*").alias("n"), *failed)
    rows = F.array(
        *[
            F.struct(
                F.lit(c.check).alias("check"),
                F.lit(table).alias("table"),
                F.lit(c.column).alias("column"),
                F.col("n").alias("n_rows"),
                F.col(f"f{i}").alias("n_failed"),
            )
            for i, c in enumerate(checks)
        ]
    )
    return counts.select(F.inline(rows))


def unique(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; keys with a null are not compared."""
    keys = df.dropna(subset=list(columns)).groupBy(*columns).agg(F.count("*").alias("n"))
    return keys.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count_if(F.col("n") > 1).alias("n_failed")
    ).select(
        F.lit("unique").alias("check"),
        F.lit(table).alias("table"),
        F.lit(",".join(columns)).alias("column"),
        "n_rows",
        "n_failed",
    )


def relationships(
    child: DataFrame, table: str, column: str, parent: DataFrame, field: str
) -> DataFrame:
    """Child rows without a parent. Rows are counted per key before the join."""
    keys = child.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    known = parent.select(F.col(field).alias("_parent"), F.lit(True).alias("_found")).distinct()
    matched = keys.join(known, F.col(column) == F.col("_parent"), "left")
    return matched.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("_found").isNull(), F.col("n"))), F.lit(0)).alias("n_failed"),
    ).select(
        F.lit("relationships").alias("check"),
        F.lit(table).alias("table"),
        F.lit(column).alias("column"),
        "n_rows",
        "n_failed",
    )


def orphans(child: DataFrame, column: str, parent: DataFrame, field: str) -> DataFrame:
    """The child rows themselves; null keys are not orphans."""
    present = child.where(F.col(column).isNotNull())
    return present.join(parent, present[column] == parent[field], "left_anti")


def null_percentage(df: DataFrame, columns: Sequence[str], threshold: float) -> DataFrame:
    """Share of nulls per column, and whether it is above the threshold."""
    counts = df.agg(
        F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col("n").alias("n_rows"),
                F.col(f"null_{c}").alias("n_null"),
                F.try_divide(F.col(f"null_{c}") * 100.0, F.col("n")).alias("pct"),
            )
            for c in columns
        ]
    )
    return counts.select(F.inline(rows)).withColumn("failed", F.col("pct") > threshold)


def freshness(df: DataFrame, column: str, as_of: Column, max_hours: float) -> DataFrame:
    newest = df.agg(F.max(column).alias("newest"))
    age = F.timestamp_diff("SECOND", F.col("newest"), as_of) / 3600.0
    return newest.withColumn("age_hours", age).withColumn(
        "failed", F.coalesce(F.col("age_hours") > max_hours, F.lit(True))
    )


def schema_drift(df: DataFrame, expected: StructType) -> DataFrame:
    """Columns that are missing, unexpected or of another type, with the rows concerned."""
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    wanted = {f.name: f.dataType.simpleString() for f in expected.fields}
    problems = [
        (name, "missing" if name not in actual else "unexpected" if name not in wanted else "type",
         wanted.get(name), actual.get(name))
        for name in sorted({*actual, *wanted})
        if actual.get(name) != wanted.get(name)
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("column"),
                F.lit(problem).alias("problem"),
                F.lit(want).cast("string").alias("expected"),
                F.lit(got).cast("string").alias("actual"),
            )
            for name, problem, want, got in problems
        ]
    )
    if not problems:
        rows = rows.cast("array<struct<column:string,problem:string,expected:string,actual:string>>")
    return df.agg(F.count("*").alias("n_rows")).select("n_rows", F.inline(rows))


def enforce(results: DataFrame, fail_on_error: bool = True) -> DataFrame:
    """Stop on a failed check, or only hand the report on."""
    if fail_on_error:
        failed = results.where("n_failed > 0").collect()  # one row per check
        if failed:
            raise QualityError("; ".join(f"{r.check} {r.table}.{r.column}: {r.n_failed}" for r in failed))
    return results


# --- row rules -------------------------------------------------------------

# What the entity rules accept: the values that generated entities take.
REGIONS = list(REGION_WEIGHTS)
ORDER_STATUSES = list(STATUS_WEIGHTS)
PLANS = list(PLAN_WEIGHTS)
SUBSCRIPTION_STATUSES = list(SUBSCRIPTION_WEIGHTS)
EVENT_TYPES = list(EVENT_WEIGHTS)


def _length(column: str, low: int, high: int) -> Column:
    return F.length(column).between(low, high)


def _amount(column: str) -> Column:
    value = F.col(column).cast("double")
    return (value >= 0) & (F.abs(value * 100 - F.round(value * 100)) < 1e-6)


def _id(column: str) -> Column:
    return F.col(column) >= 1


def customer_rules(regions: Sequence[str] = REGIONS) -> dict[str, Column]:
    return {
        "customer_id": _id("customer_id"),
        "name": _length("name", 1, 200),
        "email": _length("email", 5, 254) & F.col("email").rlike(EMAIL_PATTERN),
        "region": F.col("region").isin(*regions),
        "created_at": F.col("created_at").isNotNull(),
    }


def order_rules(
    regions: Sequence[str] = REGIONS, statuses: Sequence[str] = ORDER_STATUSES
) -> dict[str, Column]:
    return {
        "order_id": _id("order_id"),
        "customer_id": _id("customer_id"),
        "status": F.col("status").isin(*statuses),
        "region": F.col("region").isin(*regions),
        "total_amount": _amount("total_amount"),
        "created_at": F.col("created_at").isNotNull(),
    }


def order_item_rules() -> dict[str, Column]:
    return {
        "order_item_id": _id("order_item_id"),
        "order_id": _id("order_id"),
        "product_id": _id("product_id"),
        "quantity": F.col("quantity") >= 1,
        "price": _amount("price"),
        "discount": _amount("discount"),
    }


def product_rules() -> dict[str, Column]:
    return {
        "product_id": _id("product_id"),
        "name": _length("name", 1, 200),
        "category": F.col("category").isin(*CATEGORIES),
        "price": _amount("price"),
        "sku": _length("sku", 1, 50) & F.col("sku").rlike(r"^[A-Z0-9\-]+$"),
    }


def user_rules() -> dict[str, Column]:
    return {
        "user_id": _id("user_id"),
        "email": _length("email", 5, 254) & F.col("email").rlike(EMAIL_PATTERN),
        "name": _length("name", 1, 200),
        "plan": F.col("plan").isin(*PLANS),
        "organization_id": F.col("organization_id").isNull() | _id("organization_id"),
        "signup_date": F.col("signup_date").isNotNull(),
        "last_active_at": F.col("last_active_at").isNotNull(),
    }


def event_rules(types: Sequence[str] = EVENT_TYPES) -> dict[str, Column]:
    return {
        "event_id": _id("event_id"),
        "user_id": _id("user_id"),
        "event_type": F.col("event_type").isin(*types),
        "timestamp": F.col("timestamp").isNotNull(),
        "session_id": F.col("session_id").isNull() | (F.length("session_id") <= 100),
    }


def subscription_rules() -> dict[str, Column]:
    return {
        "subscription_id": _id("subscription_id"),
        "user_id": _id("user_id"),
        "plan": F.col("plan").isin(*PLANS),
        "mrr": _amount("mrr"),
        "status": F.col("status").isin(*SUBSCRIPTION_STATUSES),
        "started_at": F.col("started_at").isNotNull(),
    }


def failed_rules(rules: Mapping[str, Column]) -> Column:
    """Names of the rules a row breaks; a rule that comes out null is broken."""
    return F.array_compact(
        F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])
    )


def quarantine(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep every rule, and the others with the names of those they break."""
    marked = df.withColumn("failed_rules", failed_rules(rules))
    return (
        marked.where(F.size("failed_rules") == 0).drop("failed_rules"),
        marked.where(F.size("failed_rules") > 0),
    )


def rule_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows per broken rule, every rule listed."""
    checks = [RowCheck("row_rule", name, F.coalesce(rule, F.lit(False))) for name, rule in rules.items()]
    return check_rows(df, "", checks).select(F.col("column").alias("rule"), "n_rows", "n_failed")


@dataclass(frozen=True)
class Checked:
    """What a checked write left: rows that keep every rule, the others with the rules they break, and counts."""

    kept: DataFrame
    broken: DataFrame
    n_rows: int
    n_failed: dict[str, int]

    def counts(self) -> DataFrame:
        rows = [(name, self.n_rows, n) for name, n in self.n_failed.items()]
        return self.kept.sparkSession.createDataFrame(rows, "rule string, n_rows bigint, n_failed bigint")


def write_checked(df: DataFrame, rules: Mapping[str, Column], path: str) -> Checked:
    """Write a frame once, kept and broken rows to folders of their own, counting each rule on the way.

    The source is read and the rules are worked out a single time: rows are parted by the write, and the counts are observed by it.
    A second run replaces both folders.
    """
    marked = df.withColumn("failed_rules", failed_rules(rules))
    counted = Observation()
    broken = [F.count_if(F.array_contains("failed_rules", name)).alias(f"rule_{i}") for i, name in enumerate(rules)]
    marked = marked.withColumn("_kept", F.size("failed_rules") == 0).observe(counted, F.count(F.lit(1)).alias("n"), *broken)
    marked.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("_kept").parquet(path)
    stored = df.sparkSession.read.schema(marked.schema).parquet(path)
    got = counted.get
    return Checked(
        stored.where(F.col("_kept")).drop("_kept", "failed_rules"),
        stored.where(~F.col("_kept")).drop("_kept"),
        got["n"],
        {name: got[f"rule_{i}"] for i, name in enumerate(rules)},
    )


def with_subtotal(items: DataFrame, price: str = "price", discount: str = "discount") -> DataFrame:
    """Quantity times price minus discount, in exact cents."""
    amount = F.col("quantity").cast("int") * F.col(price).cast("decimal(10,2)")
    return items.withColumn("subtotal", (amount - F.col(discount).cast("decimal(10,2)")).cast("decimal(12,2)"))
