"""Column classes, the actions taken on them, and retention."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass
from fnmatch import fnmatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType

from lakeloom.functions.draws import draw, draw_int, pick
from lakeloom.operators.generate import FIRST, HOSTS, LAST


@dataclass(frozen=True)
class ClassRule:
    """What a data class asks for."""

    sensitivity: str = "medium"
    encryption_required: bool = False
    retention_days: int | None = None
    require_approval: bool = False
    masking_required: bool = False


# The default classes.
DEFAULT_CLASSES = {
    "public": ClassRule("low", False, 365),
    "internal": ClassRule("medium", True, 730),
    "confidential": ClassRule("high", True, 365, require_approval=True),
    "pii": ClassRule("critical", True, 365, masking_required=True),
}

MASKING_ACTIONS = {"mask", "hash", "redact", "synthesize", "restrict"}


@dataclass(frozen=True)
class Action:
    """``restrict``, ``synthesize``, ``redact``, ``mask`` or ``hash``, and who is exempt."""

    action: str
    requires_role: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.action not in MASKING_ACTIONS:
            raise ValueError(f"unknown action {self.action!r}")


@dataclass(frozen=True)
class Policy:
    production: Action | None = None
    non_production: Action | None = None

    def for_environment(self, environment: str) -> Action | None:
        return self.production if environment == "production" else self.non_production


# --- classes ---------------------------------------------------------------


def classify(df: DataFrame, classes: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Attach a class to columns as field metadata; it travels with the schema."""
    unknown = set(classes) - set(df.columns)
    if unknown:
        raise ValueError(f"no such column: {', '.join(sorted(unknown))}")
    return df.withColumns(
        {c: F.col(c).alias(c, metadata=dict(meta)) for c, meta in classes.items()}
    )


def column_classes(df: DataFrame, table: str) -> DataFrame:
    """Classified columns with the values they hold, one row per column."""
    found = [f for f in df.schema.fields if "classification" in f.metadata]
    counts = df.agg(*[F.count(f"`{f.name}`").alias(f"n_{i}") for i, f in enumerate(found)])
    rows = F.array(
        *[
            F.struct(
                F.lit(table).alias("table"),
                F.lit(f.name).alias("column"),
                F.lit(f.metadata["classification"]).alias("class"),
                F.lit(f.metadata.get("pii_type")).cast("string").alias("pii_type"),
                F.lit(f.metadata.get("sensitivity", "medium")).alias("sensitivity"),
                F.col(f"n_{i}").alias("n_values"),
            )
            for i, f in enumerate(found)
        ]
    )
    return counts.select(F.inline(rows))


def class_facet(classes: DataFrame) -> DataFrame:
    """One row per table: its classified columns as a list."""
    entry = F.struct("column", "class", "pii_type", "sensitivity")
    return classes.groupBy("table").agg(F.sort_array(F.collect_list(entry)).alias("classes"))


# --- actions ---------------------------------------------------------------


def mask_email(column: Column | str) -> Column:
    return F.regexp_replace(column, r"^[^@]+", "***")


def mask_keep_last(column: Column | str, keep: int = 4) -> Column:
    text = F.col(column) if isinstance(column, str) else column
    hidden = F.greatest(F.length(text) - keep, F.lit(0))
    return F.concat(F.repeat(F.lit("*"), hidden), F.right(text, F.lit(keep)))


def hash_value(column: Column | str, salt: str) -> Column:
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.sha2(F.concat(F.lit(salt), text), 256)


def redact(kind: DataType) -> Column:
    return F.lit(None).cast(kind)


def synthesize(column: Column | str, seed: int = 42, pii_type: str | None = None) -> Column:
    """A made-up value; the same input always gives the same one."""
    value = F.col(column) if isinstance(column, str) else column
    first, last = (
        pick(words, draw(seed, name, value)) for words, name in ((FIRST, "first"), (LAST, "last"))
    )
    if pii_type == "email":
        host = pick(HOSTS, draw(seed, "host", value))
        number = draw_int(0, 9999, draw(seed, "number", value)).cast("string")
        fake = F.concat(F.lower(first), F.lit("."), F.lower(last), number, F.lit("@"), host)
    else:
        fake = F.concat_ws(" ", first, last)
    return F.when(value.isNotNull(), fake)


def _apply(action: str, df: DataFrame, name: str, salt: str, seed: int, pii_type: str | None) -> Column:
    kind, column = df.schema[name].dataType, F.col(name)
    if action == "redact":
        return redact(kind)
    text = column.cast("string")
    if action == "mask":
        masked = F.when(F.contains(text, F.lit("@")), mask_email(text)).otherwise(mask_keep_last(text))
        return masked if isinstance(kind, StringType) else mask_keep_last(text)
    if action == "hash":
        return hash_value(column, salt)
    return synthesize(text, seed, pii_type)


def apply_policies(
    df: DataFrame,
    policies: Mapping[str, Policy],
    environment: str,
    roles: Collection[str] = (),
    patterns: Sequence[tuple[str, str]] = (),
    salt: str = "",
    seed: int = 42,
) -> DataFrame:
    """The frame a reader of this environment and these roles may see.

    The class of a column decides; a name pattern decides for columns without
    a class. A restricted column is dropped unless a needed role is held.
    """
    out = []
    for field in df.schema.fields:
        policy = policies.get(field.metadata.get("classification", ""))
        action = policy.for_environment(environment) if policy else None
        if action is None:
            named = [a for p, a in patterns if fnmatch(field.name, p)]
            action = Action(named[0]) if named and "classification" not in field.metadata else None
        if action is None:
            out.append(F.col(field.name))
        elif action.action == "restrict":
            if action.requires_role and set(action.requires_role) <= set(roles):
                out.append(F.col(field.name))
        else:
            pii_type = field.metadata.get("pii_type")
            out.append(_apply(action.action, df, field.name, salt, seed, pii_type).alias(field.name))
    return df.select(*out)


def restrict(df: DataFrame, columns: Mapping[str, Collection[str]], roles: Collection[str]) -> DataFrame:
    """Drop the columns whose roles are not all held."""
    return df.drop(*[c for c, needed in columns.items() if not set(needed) <= set(roles)])


# --- retention -------------------------------------------------------------


def retention_split(
    df: DataFrame, ts: str, as_of: Column, retention_days: int, archive_after_days: int | None = None
) -> DataFrame:
    """Add ``disposition``: keep, archive or drop by age; an unknown age is kept."""
    if archive_after_days is not None and archive_after_days >= retention_days:
        raise ValueError("rows are archived before they are dropped")
    age = F.datediff(as_of, F.col(ts))
    fate = F.when(age > retention_days, "drop")
    if archive_after_days is not None:
        fate = fate.when(age > archive_after_days, "archive")
    return df.withColumn("disposition", fate.otherwise("keep"))


def class_violations(
    df: DataFrame,
    applied: Mapping[str, str],
    ts: str,
    as_of: Column,
    classes: Mapping[str, ClassRule] = DEFAULT_CLASSES,
) -> DataFrame:
    """Columns whose class asks for more than was done, with the rows concerned."""
    age = F.datediff(as_of, F.col(ts))
    checks: list[tuple[str, str, str, Column]] = []
    for field in df.schema.fields:
        name = field.metadata.get("classification")
        rule = classes.get(name)
        if rule is None:
            continue
        held = F.col(field.name).isNotNull()
        if rule.masking_required and applied.get(field.name) not in MASKING_ACTIONS:
            checks.append((field.name, name, "masking_required", held))
        if rule.retention_days is not None:
            checks.append((field.name, name, "retention", held & (age > rule.retention_days)))
    counts = df.agg(*[F.count_if(condition).alias(f"n_{i}") for i, (*_, condition) in enumerate(checks)])
    rows = F.array(
        *[
            F.struct(
                F.lit(column).alias("column"),
                F.lit(name).alias("class"),
                F.lit(rule).alias("requirement"),
                F.col(f"n_{i}").alias("n_rows"),
            )
            for i, (column, name, rule, _) in enumerate(checks)
        ]
    )
    return counts.select(F.inline(rows)).where("n_rows > 0")
