"""Metric queries: measures by dimensions over declared cubes, as one DataFrame.

A query is a dict of ``measures``, ``dimensions``, ``timeDimensions``,
``filters``, ``order``, ``limit`` and ``offset``; members are written
``Cube.member`` and come out as columns ``Cube_member``.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DataType,
    DateType,
    IntegralType,
    NumericType,
    StructType,
    TimestampNTZType,
    TimestampType,
)

from lakeloom.operators.joins import shuffled_again
from lakeloom.session import materialize
from lakeloom.sources.layout import with_partitions
from lakeloom.sources.datasets import Dataset

NAME = re.compile(r"^[a-zA-Z][a-zA-Z0-9_]*$")

# Which finer grains add up to a grain. Weeks cross months, so they add up to nothing.
GRAINS = ["second", "minute", "hour", "day", "week", "month", "quarter", "year"]
ADDS_UP_TO = {
    "second": set(GRAINS),
    "minute": set(GRAINS) - {"second"},
    "hour": set(GRAINS) - {"second", "minute"},
    "day": {"day", "week", "month", "quarter", "year"},
    "week": {"week"},
    "month": {"month", "quarter", "year"},
    "quarter": {"quarter", "year"},
    "year": {"year"},
}
MEASURE_TYPES = {
    "count", "count_distinct", "count_distinct_approx", "sum", "avg", "min", "max",
    "number", "string", "time", "boolean", "running_total",
}
# Suffixes of the parts a measure is kept in; every other type keeps one value, ``v``.
PARTS = {
    "count": "n",
    "count_distinct": "b",
    "count_distinct_approx": "h",
    "sum": "s",
    "running_total": "s",
    "avg": "sn",
}
RELATIONSHIPS = {"one_to_one", "one_to_many", "many_to_one"}
OPERATORS = {
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
}


class MetricError(ValueError):
    """A query or a definition that names something unknown or impossible."""


class SecurityError(PermissionError):
    """No context, an expired one, or a claim that is missing."""


def _checked(kind: str, name: str) -> None:
    if not NAME.match(name):
        raise MetricError(f"{kind} name {name!r} must match {NAME.pattern}")


@dataclass(frozen=True)
class Dimension:
    name: str
    sql: str
    type: str = "string"
    primary_key: bool = False

    def __post_init__(self) -> None:
        _checked("dimension", self.name)


@dataclass(frozen=True)
class Measure:
    """``sql`` is a row expression; for type ``number`` it is over other measures."""

    name: str
    type: str = "count"
    sql: str | None = None
    filters: tuple[str, ...] = ()
    uses: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        _checked("measure", self.name)
        if self.type not in MEASURE_TYPES:
            raise MetricError(f"measure {self.name} has unknown type {self.type!r}")
        if self.type != "count" and not self.sql:
            raise MetricError(f"measure {self.name} of type {self.type} needs an expression")


@dataclass(frozen=True)
class Join:
    """Equality of ``left`` on this cube and ``right`` on the joined one."""

    name: str
    relationship: str
    left: str
    right: str

    def __post_init__(self) -> None:
        if self.relationship not in RELATIONSHIPS:
            raise MetricError(f"join to {self.name} has unknown relationship {self.relationship!r}")


@dataclass(frozen=True)
class Rollup:
    """``refresh_every`` is how old a stored rollup may get: a number with s, m, h or d; none is always refreshed when asked."""

    name: str
    measures: tuple[str, ...]
    dimensions: tuple[str, ...] = ()
    time_dimension: str | None = None
    granularity: str | None = None
    refresh_every: str | None = None

    def __post_init__(self) -> None:
        if self.refresh_every is not None and not re.fullmatch(r"[1-9]\d*[smhd]", self.refresh_every):
            raise MetricError(f"rollup {self.name} has unknown refresh rule {self.refresh_every!r}")

    @property
    def age(self) -> timedelta:
        if self.refresh_every is None:
            return timedelta(0)
        unit = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days"}[self.refresh_every[-1]]
        return timedelta(**{unit: int(self.refresh_every[:-1])})

    @property
    def names(self) -> list[str]:
        return [*self.dimensions, *([self.time_dimension] if self.time_dimension else [])]


@dataclass(frozen=True)
class Cube:
    name: str
    table: str
    dimensions: tuple[Dimension, ...]
    measures: tuple[Measure, ...] = (Measure("count"),)
    joins: tuple[Join, ...] = ()
    rollups: tuple[Rollup, ...] = ()
    row_filters: tuple[str, ...] = ("organization_id",)

    def __post_init__(self) -> None:
        _checked("cube", self.name)

    def dimension(self, name: str) -> Dimension:
        return _find(self.dimensions, name, f"{self.name} has no dimension")

    def measure(self, name: str) -> Measure:
        return _find(self.measures, name, f"{self.name} has no measure")

    def join(self, name: str) -> Join:
        return _find(self.joins, name, f"{self.name} has no join to")


@dataclass(frozen=True)
class SecurityContext:
    user_id: str
    roles: tuple[str, ...] = ()
    claims: Mapping[str, object] = field(default_factory=dict)
    expires_at: datetime | None = None

    def is_expired(self, now: datetime | None = None) -> bool:
        return self.expires_at is not None and (now or datetime.now()) >= self.expires_at


def _find(items, name, text):
    for item in items:
        if item.name == name:
            return item
    raise MetricError(f"{text} {name!r}")


# --- cubes from schemas ----------------------------------------------------


def dimension_type(kind: DataType) -> str:
    if isinstance(kind, NumericType):
        return "number"
    if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        return "time"
    return "boolean" if isinstance(kind, BooleanType) else "string"


def cube_from_schema(name: str, table: str, schema: StructType, meta: Mapping | None = None) -> Cube:
    """Every column a dimension, an integer ``id`` the key, a count unless measures are declared."""
    meta = meta or {}
    dimensions = tuple(
        Dimension(
            f.name,
            f.name,
            dimension_type(f.dataType),
            f.name == "id" and isinstance(f.dataType, IntegralType),
        )
        for f in schema.fields
    )
    measures = tuple(Measure(**m) for m in meta.get("measures", ())) or (Measure("count"),)
    joins = tuple(Join(**j) for j in meta.get("joins", ()))
    return Cube(name, table, dimensions, measures, joins, row_filters=())


# --- measures in additive parts --------------------------------------------
#
# A measure is a few parts per group: partial aggregates that can be merged
# (sum of sums, count, minimum, sketch) and a final expression over them.
#
# The parts of an exact distinct count are bitmaps, one for each stretch of 32768 numbers, in rows
# of their own: ``_of`` names the measure, ``_bucket`` the stretch. All other parts stand in the row
# of the group where ``_of`` is null. Bitmaps are merged per group and stretch first and counted second.
#
# Parts by the key of a join hold hardly a number for each key, and a bitmap takes 4 KB whatever it holds. There the
# rows of a set hold one number each (``_number``), which are made distinct per group of the result and counted second.

OF, BUCKET, NUMBER = "_of", "_bucket", "_number"


def _input(measure: Measure) -> Column:
    value = F.lit(1) if measure.sql is None else F.expr(measure.sql)
    for condition in measure.filters:
        value = F.when(F.expr(condition), value)
    return value


def _parts(measure: Measure, x: Column, p: str) -> list[Column]:
    """Partial aggregates of input column ``x``, named with prefix ``p``."""
    kind = measure.type
    if kind == "count":
        return [F.count(x).alias(f"{p}n")]
    if kind in {"sum", "running_total"}:
        return [F.sum(x).alias(f"{p}s")]
    if kind == "avg":
        return [F.sum(x).alias(f"{p}s"), F.count(x).alias(f"{p}n")]
    if kind == "min":
        return [F.min(x).alias(f"{p}v")]
    if kind in {"max", "string", "time"}:
        return [F.max(x).alias(f"{p}v")]
    if kind == "boolean":
        return [F.bool_or(x).alias(f"{p}v")]
    if kind == "count_distinct_approx":
        return [F.hll_sketch_agg(x.cast("string"), F.lit(14)).alias(f"{p}h")]
    if kind == "count_distinct":
        return [F.when(F.col(OF) == p, F.bitmap_construct_agg(F.when(F.col(OF) == p, F.col("_bit")))).alias(f"{p}b")]
    raise MetricError(f"measure {measure.name} of type {kind} cannot be merged from parts")


def _in_parts(
    rows: DataFrame, groups: list[Column], measures: Mapping[str, Measure], inputs: Mapping[str, str], numbers: bool = False
) -> DataFrame:
    """Parts of measures per group. ``measures`` go by the prefix of their parts, ``inputs`` names their columns.

    Sets are bitmaps, or with ``numbers`` one row for each number of a group, which is meant for groups of few rows.
    """
    sets = [p for p, m in measures.items() if m.type == "count_distinct"]
    if not sets:
        parts = [part for p, m in measures.items() for part in _parts(m, F.col(inputs[p]), p)]
        return _aggregate(rows, groups, parts)
    rows = _entries(rows, sets, inputs)
    own = F.col(OF).isNull()
    if numbers:
        parts = [part for p, m in measures.items() if p not in sets for part in _parts(m, F.when(own, F.col(inputs[p])), p)]
        return _aggregate(rows, [*groups, F.col(OF), F.col(NUMBER)], parts)
    rows = rows.withColumns({BUCKET: F.bitmap_bucket_number(NUMBER), "_bit": F.bitmap_bit_position(NUMBER)})
    parts = [part for p, m in measures.items() for part in _parts(m, F.when(own, F.col(inputs[p])), p)]
    return rows.groupBy(*groups, OF, BUCKET).agg(*parts)


def _entries(rows: DataFrame, sets: Sequence[str], inputs: Mapping[str, str]) -> DataFrame:
    """Each row once for the group itself and once for every number that it adds to a set."""
    for p in sets:
        kind = rows.schema[inputs[p]].dataType
        if not isinstance(kind, IntegralType):
            raise MetricError(f"distinct counts of {kind.simpleString()} cannot be merged from parts; use count_distinct_approx")
    entries = [F.struct(F.lit(None).cast("string").alias("of"), F.lit(None).cast("bigint").alias("number"))]
    for p in sets:
        number = F.col(inputs[p]).cast("bigint")
        entries.append(F.when(number.isNotNull(), F.struct(F.lit(p).alias("of"), number.alias("number"))))
    rows = rows.withColumn("_entry", F.explode(F.array_compact(F.array(*entries))))
    return rows.withColumns({OF: F.col("_entry.of"), NUMBER: F.col("_entry.number")}).drop("_entry")


def _merge_parts(rows: DataFrame, groups: list[Column], measures: Mapping[str, Measure]) -> DataFrame:
    """Stored parts merged into coarser groups, as parts again."""
    whole = [*groups, F.col(OF), F.col(BUCKET)] if OF in rows.columns else groups
    return _aggregate(rows, whole, [part for p, m in measures.items() for part in _merged(m, p)])


def _counted(rows: DataFrame, groups: list[str], measures: Mapping[str, Measure]) -> DataFrame:
    """The rows of sets and of the group brought together; sets become counts."""
    if OF not in rows.columns:
        return rows
    parts = []
    for p, m in measures.items():
        if m.type == "count_distinct":
            found = F.count_if(F.col(OF) == p) if NUMBER in rows.columns else F.sum(F.bitmap_count(f"{p}b"))
            parts.append(F.coalesce(found, F.lit(0)).alias(f"{p}n"))
        else:
            parts += _merged(m, p)
    return _aggregate(rows, [F.col(f"`{g}`") for g in groups], parts)


def _merged(measure: Measure, p: str) -> list[Column]:
    kind = measure.type
    if kind == "count_distinct":
        return [F.when(F.col(OF) == p, F.bitmap_or_agg(F.coalesce(f"{p}b", F.lit(b"")))).alias(f"{p}b")]
    if kind in {"count", "sum", "running_total", "avg"}:
        return [F.sum(f"{p}{s}").alias(f"{p}{s}") for s in PARTS[kind]]
    if kind == "min":
        return [F.min(f"{p}v").alias(f"{p}v")]
    if kind == "boolean":
        return [F.bool_or(f"{p}v").alias(f"{p}v")]
    if kind == "count_distinct_approx":
        return [F.hll_union_agg(f"{p}h").alias(f"{p}h")]
    return [F.max(f"{p}v").alias(f"{p}v")]


def _direct(measure: Measure, x: Column, p: str) -> list[Column]:
    """Aggregates of one pass; distinct counts need not be mergeable here."""
    if measure.type == "count_distinct":
        return [F.count_distinct(x).alias(f"{p}n")]
    return _parts(measure, x, p)


def _final(measure: Measure, p: str) -> Column:
    kind = measure.type
    if kind == "count_distinct":
        return F.coalesce(F.col(f"{p}n"), F.lit(0))
    if kind == "avg":
        n = F.nullif(F.col(f"{p}n"), F.lit(0))
        return F.col(f"{p}s").cast("double") / n
    if kind == "count_distinct_approx":
        return F.coalesce(F.hll_sketch_estimate(f"{p}h"), F.lit(0))
    if kind == "count":
        return F.coalesce(F.col(f"{p}n"), F.lit(0))
    return F.col(f"{p}{PARTS.get(kind, 'v')}")


# --- query -----------------------------------------------------------------


@dataclass
class _Request:
    """A query with every member looked up."""

    base: Cube
    cubes: dict[str, Cube]
    measures: list[tuple[Cube, Measure]]
    shown: list[str]
    dimensions: list[tuple[Cube, Dimension]]
    time: list[tuple[Cube, Dimension, str | None, tuple[datetime, datetime] | None]]
    filters: list[tuple[Cube, Dimension, str, list]]
    way: list[tuple[Cube, Join, Cube]]


def _member(cubes: Mapping[str, Cube], name: str) -> tuple[Cube, str]:
    cube, _, member = name.partition(".")
    if cube not in cubes:
        raise MetricError(f"unknown cube {cube!r}, known cubes: {', '.join(sorted(cubes))}")
    return cubes[cube], member


def column_name(member: str) -> str:
    return member.replace(".", "_")


def date_range(value, as_of: datetime | None) -> tuple[datetime, datetime]:
    """A pair of days (both included), a single day, or ``last N days`` before ``as_of``."""
    if isinstance(value, str):
        match = re.fullmatch(r"last (\d+) days?", value.strip().lower())
        if match:
            if as_of is None:
                raise MetricError(f"{value!r} needs an as_of time")
            return as_of - timedelta(days=int(match[1])), as_of
        value = [value, value]
    start, end = (datetime.fromisoformat(v) for v in value)
    return start, end + timedelta(days=1)


def _resolve(cubes: Mapping[str, Cube], query: Mapping, as_of: datetime | None) -> _Request:
    asked = list(query.get("measures", []))
    measures: list[tuple[Cube, Measure]] = []

    def need(cube: Cube, name: str) -> None:
        measure = cube.measure(name)
        for used in measure.uses:
            need(cube, used)
        if (cube, measure) not in measures:
            measures.append((cube, measure))

    for name in asked:
        need(*_member(cubes, name))
    dimensions = []
    for name in query.get("dimensions", []):
        cube, member = _member(cubes, name)
        dimensions.append((cube, cube.dimension(member)))
    time = []
    for item in query.get("timeDimensions", []):
        cube, member = _member(cubes, item["dimension"])
        grain = item.get("granularity")
        if grain is not None and grain not in GRAINS:
            raise MetricError(f"unknown granularity {grain!r}")
        span = date_range(item["dateRange"], as_of) if item.get("dateRange") else None
        time.append((cube, cube.dimension(member), grain, span))
    filters = []
    for item in query.get("filters", []):
        cube, member = _member(cubes, item.get("member") or item["dimension"])
        if item["operator"] != "equals" and item["operator"] not in OPERATORS:
            raise MetricError(f"unknown operator {item['operator']!r}")
        filters.append((cube, cube.dimension(member), item["operator"], list(item["values"])))
    known = {f"{c.name}.{m.name}" for c, m in measures}
    known |= {f"{c.name}.{d.name}" for c, d in dimensions} | {f"{t[0].name}.{t[1].name}" for t in time}
    for name in query.get("order", {}):
        if name not in known:
            raise MetricError(f"cannot order by {name!r}, it is not in the query")
    touched = [c for c, _ in measures] + [c for c, _ in dimensions] + [t[0] for t in time]
    touched += [f[0] for f in filters]
    if not touched:
        raise MetricError("a query needs a measure or a dimension")
    by_name = {c.name: c for c in touched}
    # The base with the fewest joins on the way to all others; earlier members first.
    ways = [(c, _way(cubes, c, set(by_name))) for c in by_name.values()]
    ways = sorted([w for w in ways if w[1] is not None], key=lambda w: len(w[1]))
    if not ways:
        raise MetricError(f"no declared join connects {', '.join(by_name)}")
    base, way = ways[0]
    everything = by_name | {c.name: c for _, _, c in way}
    return _Request(base, everything, measures, asked, dimensions, time, filters, way)


def _way(cubes: Mapping[str, Cube], base: Cube, wanted: set[str]) -> list[tuple[Cube, Join, Cube]] | None:
    """The joins that lead from a base to all wanted cubes, parents first; none if a cube is out of reach.

    Over more than one join only single rows are followed: a cube with many rows is joined to the base itself.
    """
    reached, frontier = {base.name: []}, [base]
    while frontier:
        cube = frontier.pop(0)
        for link in cube.joins:
            direct = cube.name == base.name
            if link.name in reached or link.name not in cubes or not direct and link.relationship == "one_to_many":
                continue
            if link.relationship == "one_to_many" and link.name not in wanted:
                continue
            reached[link.name] = [*reached[cube.name], (cube, link, cubes[link.name])]
            if link.relationship != "one_to_many":
                frontier.append(cubes[link.name])
    if not wanted <= set(reached):
        return None
    way: list[tuple[Cube, Join, Cube]] = []
    for name in sorted(wanted - {base.name}, key=lambda n: len(reached[n])):
        way += [step for step in reached[name] if step not in way]
    return way


def _row_filters(cube: Cube, security: SecurityContext | None) -> dict[str, object]:
    if security is None:
        return {}
    missing = [c for c in cube.row_filters if c not in security.claims]
    if missing:
        raise SecurityError(f"claim {missing[0]!r} is required by {cube.name}")
    return {c: security.claims[c] for c in cube.row_filters}


def _check_context(security: SecurityContext | None, required: bool) -> None:
    if security is None and required:
        raise SecurityError("a security context is required")
    if security is not None and security.is_expired():
        raise SecurityError(f"the context of {security.user_id} has expired")


def _project(cube: Cube, df: DataFrame, request: _Request, security, keys: Sequence[str]) -> DataFrame:
    """Only the columns the query needs, computed and renamed, after row filters."""
    for column, value in _row_filters(cube, security).items():
        df = df.where(F.col(column) == F.lit(value))
    out: dict[str, Column] = {}
    for c, d in request.dimensions + [f[:2] for f in request.filters]:
        if c.name == cube.name:
            out[f"{c.name}_{d.name}"] = F.expr(d.sql)
    for c, d, _, _ in request.time:
        if c.name == cube.name:
            out[f"_t_{c.name}_{d.name}"] = F.expr(d.sql)
    for c, m in request.measures:
        if c.name == cube.name and m.type != "number":
            out[f"_m_{c.name}_{m.name}"] = _input(m)
    for key in keys:
        out[f"_k_{cube.name}_{key}"] = F.expr(key)
    rows = df.select(*[column.alias(name) for name, column in out.items()])
    for c, d, operator, values in request.filters:
        if c.name == cube.name:
            column = F.col(f"{c.name}_{d.name}")
            if operator == "equals":
                rows = rows.where(column.isin(*values))
            else:
                kind = rows.schema[f"{c.name}_{d.name}"].dataType
                rows = rows.where(OPERATORS[operator](column, F.lit(str(values[0])).cast(kind)))
    for c, d, _, span in request.time:
        if c.name == cube.name and span is not None:
            column = F.col(f"_t_{c.name}_{d.name}")
            kind = rows.schema[f"_t_{c.name}_{d.name}"].dataType
            low, high = (F.lit(str(s)).cast(kind) for s in span)
            rows = rows.where((column >= low) & (column < high))
    return rows


def _narrowed(cube: Cube, request: _Request, security: SecurityContext | None) -> bool:
    """Does the query drop rows of a joined cube, so unmatched base rows go too?"""
    return bool(_row_filters(cube, security)) or any(
        f[0].name == cube.name for f in request.filters
    ) or any(t[0].name == cube.name and t[3] for t in request.time)


def _own(request: _Request, cube: Cube) -> dict[str, Measure]:
    """The measures of a cube that are made of parts, by the prefix of their parts."""
    return {f"_p_{c.name}_{m.name}_": m for c, m in request.measures if c.name == cube.name and m.type != "number"}


def _own_groups(request: _Request, cube: Cube) -> list[Column]:
    """The columns of a cube that the result is grouped by, its times cut to their grain."""
    columns = [F.col(f"{c.name}_{d.name}") for c, d in request.dimensions if c.name == cube.name]
    for c, d, grain, _ in request.time:
        if c.name == cube.name and grain is not None:
            name = f"_t_{c.name}_{d.name}"
            columns.append(F.date_trunc(grain, F.col(name)).cast("timestamp_ntz").alias(name))
    return columns


def _joined(request: _Request, tables, security, rollups, sizes) -> tuple[DataFrame, set[str]]:
    """Base rows with every other cube attached, and the measures already in parts.

    The base, and a cube that has many rows for one of the base, come from a rollup that holds what is asked of them and their join keys.
    """
    base = request.base
    fans = any(link.relationship == "one_to_many" for _, link, _ in request.way)

    def keys(cube: Cube) -> list[str]:
        return [link.left for parent, link, _ in request.way if parent.name == cube.name]

    in_parts: set[str] = set()
    # Joined to many rows, a base row has to stay one row.
    rollup = None if fans else _covering_rollup(request, base, keys(base), security, rollups, sizes)
    if rollup is None:
        rows = _project(base, tables[base.table], request, security, keys(base))
    else:
        rows = _from_rollup(request, base, rollup, rollups[rollup.name], security, keys(base))
        in_parts |= set(_own(request, base))
    for parent, link, cube in request.way:
        wanted = list(dict.fromkeys([link.right, *keys(cube)]))
        right = f"_k_{cube.name}_{link.right}"
        if link.relationship == "one_to_many":
            # One row per key and value of its dimensions before the join: a base row counts once for each value, and measures
            # of the many side are summed without it.
            own = _own(request, cube)
            groups = [F.col(right), *_own_groups(request, cube)]
            rollup = _covering_rollup(request, cube, wanted, security, rollups, sizes)
            if rollup is not None:
                other = _from_rollup(request, cube, rollup, rollups[rollup.name], security, wanted)
                other = _merge_parts(other, groups, own)
            else:
                other = _project(cube, tables[cube.table], request, security, wanted)
                other = _in_parts(other, groups, own, {p: f"_m_{cube.name}_{m.name}" for p, m in own.items()}, numbers=True)
            if OF in other.columns:
                if OF in rows.columns:
                    raise MetricError("distinct counts of two cubes with many rows cannot be asked for together")
                # The rows of a set carry nothing else, or it would count again.
                rows = rows.join(other, F.col(f"_k_{parent.name}_{link.left}") == F.col(right), "inner" if _narrowed(cube, request, security) else "left")
                plain = [c for c in rows.columns if c.startswith(("_m_", "_p_")) and c not in {f"{p}b" for p in own}]
                rows = rows.withColumns({c: F.when(F.col(OF).isNull(), F.col(c)) for c in plain})
                in_parts |= set(own)
                continue
            in_parts |= set(own)
        else:
            other = shuffled_again(_project(cube, tables[cube.table], request, security, wanted), right)
        how = "inner" if _narrowed(cube, request, security) else "left"
        rows = rows.join(other, F.col(f"_k_{parent.name}_{link.left}") == F.col(right), how)
        if OF in rows.columns:
            own_parts = [c for c in other.columns if c.startswith(("_m_", "_p_"))]
            rows = rows.withColumns({c: F.when(F.col(OF).isNull(), F.col(c)) for c in own_parts})
    return rows, in_parts


def run(
    cubes: Mapping[str, Cube],
    tables: Mapping[str, DataFrame],
    query: Mapping,
    security: SecurityContext | None = None,
    as_of: datetime | None = None,
    rollups: Mapping[str, DataFrame] | None = None,
    require_security: bool | None = None,
    sizes: Mapping[str, int] | None = None,
) -> DataFrame:
    """The query's result; a cube is read from a given rollup where one covers what is asked of it.

    Of several rollups the one with the fewest rows is taken (``sizes``: stored rows by name), else the first one declared. A cube with row filters is not read without a context, unless ``require_security=False`` says so.
    """
    request = _resolve(cubes, query, as_of)
    if require_security is None:
        require_security = any(c.row_filters for c in request.cubes.values())
    _check_context(security, require_security)
    for cube in request.cubes.values():
        _row_filters(cube, security)
    rows, in_parts = _joined(request, tables, security, rollups or {}, sizes or {})
    measures = {f"_p_{c.name}_{m.name}_": m for c, m in request.measures if m.type != "number"}
    direct = {f"_p_{c.name}_{m.name}_": F.col(f"_m_{c.name}_{m.name}") for c, m in request.measures if m.type != "number" and f"_p_{c.name}_{m.name}_" not in in_parts}
    groups = _group_columns(request)
    if OF in rows.columns:
        if any(measures[p].type == "count_distinct" for p in direct):
            raise MetricError("distinct counts of a base cannot be asked for together with those of its many side")
        groups = [*groups, F.col(OF), F.col(NUMBER if NUMBER in rows.columns else BUCKET)]
    aggregates = []
    for p, m in measures.items():
        if NUMBER not in rows.columns or m.type != "count_distinct":
            aggregates += _direct(m, direct[p], p) if p in direct else _merged(m, p)
    grouped = _counted(_aggregate(rows, groups, aggregates), _shown_dimensions(request), measures)
    return _page(_finish(request, grouped), request, query)


def _group_columns(request: _Request) -> list[Column]:
    columns = [F.col(f"{c.name}_{d.name}") for c, d in request.dimensions]
    for c, d, grain, _ in request.time:
        if grain is not None:
            truncated = F.date_trunc(grain, F.col(f"_t_{c.name}_{d.name}")).cast("timestamp_ntz")
            columns.append(truncated.alias(f"{c.name}_{d.name}"))
    return columns


def _aggregate(rows: DataFrame, groups: list[Column], aggregates: list[Column]) -> DataFrame:
    if not aggregates:
        return rows.select(*groups).distinct()
    return rows.groupBy(*groups).agg(*aggregates) if groups else rows.agg(*aggregates)


def _shown_dimensions(request: _Request) -> list[str]:
    timed = [f"{t[0].name}_{t[1].name}" for t in request.time if t[2] is not None]
    return [f"{c.name}_{d.name}" for c, d in request.dimensions] + timed


def _finish(request: _Request, grouped: DataFrame) -> DataFrame:
    dimensions = _shown_dimensions(request)
    timed = [f"{t[0].name}_{t[1].name}" for t in request.time if t[2] is not None]
    plain = [d for d in dimensions if d not in timed]
    running = [f"_p_{c.name}_{m.name}_s" for c, m in request.measures if m.type == "running_total"]
    if running and len(timed) != 1:
        raise MetricError("a running total needs one time dimension with a granularity")
    if running:
        grouped = _run_along(grouped, plain, timed[0], running)
    values: dict[str, Column] = {}
    for c, m in request.measures:
        if m.type != "number":
            name = f"{c.name}_{m.name}"
            values[name] = _final(m, f"_p_{name}_")
    result = grouped.select(*dimensions, *[v.alias(n) for n, v in values.items()])
    for c, m in request.measures:
        if m.type == "number":
            text = re.sub(r"\{(\w+)\}", lambda match: f"`{c.name}_{match[1]}`", m.sql)
            result = result.withColumn(f"{c.name}_{m.name}", F.expr(text))
    return result.select(*dimensions, *[column_name(n) for n in request.shown])


def _run_along(
    grouped: DataFrame, dimensions: list[str], time: str, sums: list[str]
) -> DataFrame:
    """Replace sums by running sums along time.

    Summed inside each year first and over the years before it second, so the
    buckets of a fine grain are not all ordered in one task.
    """
    year = grouped.withColumn("_year", F.year(time))
    inside = (
        Window.partitionBy(*dimensions, "_year")
        .orderBy(time)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    earlier = (
        Window.partitionBy(*dimensions)
        .orderBy("_year")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = year.groupBy(*dimensions, "_year").agg(*[F.sum(s).alias(f"{s}_b") for s in sums])
    before = before.withColumns({f"{s}_b": F.sum(f"{s}_b").over(earlier) for s in sums})
    keys = {n: f"_k{i}" for i, n in enumerate([*dimensions, "_year"])}
    before = before.withColumnsRenamed(keys)
    match = [F.col(n).eqNullSafe(F.col(k)) for n, k in keys.items()]
    both = year.withColumns({s: F.sum(s).over(inside) for s in sums}).join(before, match)
    totals = {
        s: F.when(
            F.col(s).isNotNull() | F.col(f"{s}_b").isNotNull(),
            F.coalesce(F.col(s), F.lit(0)) + F.coalesce(F.col(f"{s}_b"), F.lit(0)),
        )
        for s in sums
    }
    return both.withColumns(totals)


def _beyond(result: DataFrame, order: Mapping[str, str], after: Mapping[str, object]) -> Column:
    """Whether a row comes after the row ``after`` in the order; nulls come last."""
    beyond, same = F.lit(False), F.lit(True)
    for name, direction in order.items():
        column, last = F.col(name), F.lit(after[name]).cast(result.schema[name].dataType)
        further = F.lit(False) if after[name] is None else (column < last if direction == "desc" else column > last) | column.isNull()
        beyond = beyond | (same & further)
        same = same & column.eqNullSafe(last)
    return beyond


def _page(result: DataFrame, request: _Request, query: Mapping) -> DataFrame:
    """Order, then offset and limit; dimensions break ties so pages never overlap.

    ``offset`` is for the first pages and needs a limit. Deep pages go on ``after`` the last row of the page before, given by its
    ordered members and its dimensions; then each page is a top-k of the rows that are left.
    """
    order = {column_name(n): d for n, d in query.get("order", {}).items()}
    paged = query.get("limit") is not None or query.get("offset")
    if query.get("offset") and query.get("limit") is None:
        raise MetricError("an offset needs a limit")
    if query.get("after"):
        whole = order | {d: "asc" for d in _shown_dimensions(request) if d not in order}
        after = {column_name(n): v for n, v in query["after"].items()}
        if set(after) != set(whole):
            raise MetricError(f"'after' names {', '.join(whole)}")
        result = result.where(_beyond(result, whole, after))
    if order or paged:
        keys = [
            F.col(n).desc_nulls_last() if d == "desc" else F.col(n).asc_nulls_last()
            for n, d in order.items()
        ]
        keys += [F.col(d).asc_nulls_last() for d in _shown_dimensions(request) if d not in order]
        result = result.orderBy(*keys) if keys else result
    if query.get("offset"):
        result = result.offset(int(query["offset"]))
    return result if query.get("limit") is None else result.limit(int(query["limit"]))


# --- rollups ---------------------------------------------------------------


def _stored_measures(cube: Cube, rollup: Rollup) -> dict[str, Measure]:
    return {f"{name}_": cube.measure(name) for name in rollup.measures}


def build_rollup(cube: Cube, rollup: Rollup, df: DataFrame) -> DataFrame:
    """Mergeable parts of the rollup's measures per dimension values and time grain."""
    columns = [F.expr(cube.dimension(d).sql).alias(d) for d in rollup.dimensions]
    if rollup.time_dimension is not None:
        instant = F.expr(cube.dimension(rollup.time_dimension).sql)
        columns.append(F.date_trunc(rollup.granularity, instant).cast("timestamp_ntz").alias(rollup.time_dimension))
    measures = _stored_measures(cube, rollup)
    inputs = {p: f"_m_{p}" for p in measures}
    rows = df.select(*columns, *[_input(m).alias(inputs[p]) for p, m in measures.items()])
    return _in_parts(rows, [F.col(n) for n in rollup.names], measures, inputs)


def merge_rollups(cube: Cube, rollup: Rollup, parts: DataFrame) -> DataFrame:
    """Parts of several builds as those of one."""
    return _merge_parts(parts, [F.col(n) for n in rollup.names], _stored_measures(cube, rollup))


def finish_rollup(cube: Cube, rollup: Rollup, parts: DataFrame) -> DataFrame:
    """A rollup as a reader sees it: measures instead of parts."""
    measures = _stored_measures(cube, rollup)
    counted = _counted(parts, rollup.names, measures)
    return counted.select(*rollup.names, *[_final(m, p).alias(m.name) for p, m in measures.items()])


def _covering_rollup(request: _Request, cube: Cube, keys: Sequence[str], security, available: Mapping, sizes: Mapping[str, int]) -> Rollup | None:
    """The smallest rollup that holds every measure, dimension, filter, join key and time grain asked of a cube."""
    covering = []
    for rollup in cube.rollups:
        if rollup.name not in available:
            continue
        kept = set(rollup.dimensions)
        needed = {d.name for c, d in request.dimensions if c.name == cube.name}
        needed |= {f[1].name for f in request.filters if f[0].name == cube.name}
        held = {cube.dimension(d).sql for d in rollup.dimensions}
        columns_kept = all(c in held for c in [*_row_filters(cube, security), *keys])
        measures_kept = all(m.name in rollup.measures for m in _own(request, cube).values())
        if needed <= kept and columns_kept and measures_kept and _covers_time(request, cube, rollup):
            covering.append(rollup)
    return min(covering, key=lambda r: sizes.get(r.name, float("inf")), default=None)


def _covers_time(request: _Request, cube: Cube, rollup: Rollup) -> bool:
    for owner, dimension, grain, span in request.time:
        if owner.name != cube.name:
            continue
        if dimension.name != rollup.time_dimension:
            return False
        if grain is not None and grain not in ADDS_UP_TO[rollup.granularity]:
            return False
        if span is not None and not all(_aligned(s, rollup.granularity) for s in span):
            return False
    return True


def _aligned(instant: datetime, grain: str) -> bool:
    if instant.time() != datetime.min.time():
        return False
    return grain in {"second", "minute", "hour", "day"}


def _from_rollup(request: _Request, cube: Cube, rollup: Rollup, rows: DataFrame, security, keys: Sequence[str]) -> DataFrame:
    """Rows of a rollup in the shape that rows of the cube's table have, with parts for measures."""
    by_sql = {cube.dimension(d).sql: d for d in rollup.dimensions}
    own = _own(request, cube)
    if OF in rows.columns:
        sets = [f"{m.name}_" for m in own.values() if m.type == "count_distinct"]
        rows = rows.where(F.col(OF).isNull() | F.col(OF).isin(sets)) if sets else rows.where(F.col(OF).isNull()).drop(OF, BUCKET)
    for column, value in _row_filters(cube, security).items():
        rows = rows.where(F.col(by_sql[column]) == F.lit(value))
    for c, d, operator, values in request.filters:
        if c.name != cube.name:
            continue
        column = F.col(d.name)
        if operator == "equals":
            rows = rows.where(column.isin(*values))
        else:
            literal = F.lit(str(values[0])).cast(rows.schema[d.name].dataType)
            rows = rows.where(OPERATORS[operator](column, literal))
    out = {f"{c.name}_{d.name}": F.col(d.name) for c, d in request.dimensions if c.name == cube.name}
    for c, d, _, span in request.time:
        if c.name != cube.name:
            continue
        if span is not None:
            low, high = (F.lit(str(s)).cast("timestamp_ntz") for s in span)
            rows = rows.where((F.col(d.name) >= low) & (F.col(d.name) < high))
        out[f"_t_{c.name}_{d.name}"] = F.col(d.name)
    out |= {f"_k_{cube.name}_{key}": F.col(by_sql[key]) for key in keys}
    for p, m in own.items():
        out |= {f"{p}{s}": F.col(f"{m.name}_{s}") for s in PARTS.get(m.type, "v")}
    if OF in rows.columns:
        out |= {OF: F.when(F.col(OF).isNotNull(), F.concat(F.lit(f"_p_{cube.name}_"), F.col(OF))), BUCKET: F.col(BUCKET)}
    return rows.select(*[column.alias(name) for name, column in out.items()])


def refresh_rollup(
    table: Dataset, cube: Cube, rollup: Rollup, base: DataFrame, arrived: DataFrame
) -> None:
    """Recompute the stored partitions that new base rows fall into, and no others.

    The scan of the base gets the span of those partitions as a predicate on the time column.
    """
    field = table.partition_by[0]
    instant = F.expr(cube.dimension(rollup.time_dimension).sql)
    arrived, base_keys = (
        with_partitions(df.withColumn(field.column, instant), [field]) for df in (arrived, base)
    )
    cut = F.date_trunc(field.transform, field.column)
    touched = materialize(arrived.groupBy(field.name).agg(F.min(cut).alias("low"), F.max(cut).alias("high")), "touched")
    low, high = touched.agg(F.min("low"), F.max("high")).first()
    if low is None:
        return
    beyond = F.expr(f"timestampadd({field.transform}, 1, timestamp_ntz'{high}')")
    near = base_keys.where((instant >= F.lit(str(low)).cast("timestamp_ntz")) & (instant < beyond))
    rows = near.join(touched.select(field.name), field.name, "left_semi").select(*base.columns)
    table.overwrite_partitions(build_rollup(cube, rollup, rows))


def add_to_rollup(table: Dataset, cube: Cube, rollup: Rollup, arrived: DataFrame) -> None:
    """Merge the parts of new rows into the stored partitions they fall into. The base is not read, since all parts add up.

    Each row has to be given once; a run that may be repeated takes ``refresh_changed``.
    """
    delta = materialize(build_rollup(cube, rollup, arrived), "delta")
    names = [f.name for f in table.partition_by]
    if table.exists() and not delta.isEmpty():
        touched = with_partitions(delta, table.partition_by).select(*names).distinct()
        stored = table.rows().join(touched, names, "left_semi").drop(*names)
        delta = materialize(merge_rollups(cube, rollup, stored.unionByName(delta)), "merged-parts")
    table.overwrite_partitions(delta)


def refresh_changed(table: Dataset, keys: Dataset, cube: Cube, rollup: Rollup, base: Dataset, newest: str, now: datetime) -> list[str]:
    """Recompute the partitions of a rollup whose base partitions have changed; their names.

    The base and the rollup are laid out alike by the rollup's time. A partition's refresh key is the number of its rows and their newest ``newest``;
    the keys of the last refresh are kept in ``keys``. Only that one column is read to find what has changed; of the base itself nothing but the changed
    folders is read. A rollup that is younger than its rule allows is left alone. Partitions without rows any more get none.
    """
    [field] = base.partition_by
    last = keys.scan() if keys.exists() else None
    if last is not None:
        at = last.agg(F.max("refreshed_at")).first()[0]
        if at is not None and now - at < rollup.age:
            return []
    found = base.rows().groupBy(F.col(field.name).alias("part")).agg(F.count("*").alias("n"), F.max(newest).alias("newest"))
    found = materialize(found.withColumn("refreshed_at", F.lit(str(now)).cast("timestamp_ntz")), "refresh-keys")
    changed = found.select("part", "n", "newest")
    if last is not None:
        known = last.select("part", "n", "newest")
        gone = known.join(changed, "part", "left_anti")
        changed = changed.exceptAll(known).unionByName(gone)
    parts = sorted(r.part for r in changed.collect())
    if parts:
        table.replace_partitions(build_rollup(cube, rollup, base_partitions(base, parts)), parts)
    keys.overwrite(found)
    return parts


def base_partitions(base: Dataset, parts: Sequence[str]) -> DataFrame:
    """Rows of the named partitions; no other folder is opened."""
    [field] = base.partition_by
    return base.rows().where(F.col(field.name).isin(list(parts))).drop(field.name)
