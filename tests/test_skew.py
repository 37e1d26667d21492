"""Operators on data where one key holds a third of the rows, against brute force."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeloom.functions.clean import dedupe_latest
from lakeloom.operators.quality import relationships, unique
from lakeloom.operators.ranking import rank_desc, row_number_desc, with_chunks
from lakeloom.operators.runs import upstream
from lakeloom.operators.sessions import late_split, sessionize


def session_oracle(rows):
    open_ids, out = {}, {}
    for event_id, user, kind in sorted(rows):
        if kind == "login":
            open_ids[user] = f"sess_{event_id}"
            out[event_id] = open_ids[user]
        elif kind == "logout":
            out[event_id] = open_ids.pop(user, None)
        else:
            out[event_id] = open_ids.get(user)
    return out


def hot_events(n, seed=1):
    rng = random.Random(seed)
    kinds = ["view"] * 6 + ["login"] * 2 + ["logout"]
    return [
        (i, 7 if rng.random() < 0.4 else rng.randint(1, 12), rng.choice(kinds)) for i in range(1, n + 1)
    ]


@pytest.mark.parametrize("width", [1, 7, 50])
def test_sessions_of_a_hot_user(spark, width):
    rows = hot_events(900)
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string")
    got = {r.event_id: r.session_id for r in sessionize(df, chunks=width).collect()}
    assert got == session_oracle(rows)


def test_sparse_ids_fill_chunks_evenly(spark):
    """Time-like 64-bit ids and one hot user: every chunk holds its share, and sessions are right."""
    rows = hot_events(800, seed=9)
    wide = [(i * 2**40 + i * i, u, k) for i, u, k in rows]
    df = spark.createDataFrame(wide, "event_id bigint, user_id bigint, event_type string")
    sizes = [r["count"] for r in with_chunks(df, df, "event_id", 8).groupBy("_chunk").count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 110
    got = {r.event_id: r.session_id for r in sessionize(df, chunks=8).collect()}
    assert got == session_oracle(wide)


@settings(max_examples=8, deadline=None)
@given(
    st.lists(
        st.tuples(st.integers(1, 3), st.sampled_from(["view", "login", "logout"])), min_size=1, max_size=40
    ),
    st.integers(1, 9),
)
def test_sessions_any_input(spark, pairs, width):
    rows = [(i, user, kind) for i, (user, kind) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string")
    got = {r.event_id: r.session_id for r in sessionize(df, chunks=width).collect()}
    assert got == session_oracle(rows)


@pytest.mark.parametrize("width", [1, 13])
def test_late_rows(spark, width):
    rng = random.Random(3)
    rows = [(i, i * 3600 - rng.choice([0, 0, 0, 5, 12]) * 86400) for i in range(1, 600)]
    df = spark.createDataFrame(rows, "event_id bigint, s bigint").selectExpr(
        "event_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, s) AS ts", "s"
    )
    newest, want = None, {}
    for event_id, s in rows:
        want[event_id] = newest is not None and s < newest - 7 * 86400
        newest = s if newest is None else max(newest, s)
    got = {r.event_id: r.is_late for r in late_split(df, "ts", 7, chunks=width).collect()}
    assert got == want and any(want.values())


def revenues():
    """A third of the products share one revenue, and one category holds most of them."""
    rng = random.Random(5)
    return [
        (i, "big" if rng.random() < 0.8 else "small", 0 if rng.random() < 0.35 else rng.randint(1, 400))
        for i in range(1, 1200)
    ]


@pytest.mark.parametrize("buckets", [2, 16])
def test_ranks_with_ties(spark, buckets):
    rows = revenues()
    df = spark.createDataFrame(rows, "id bigint, category string, cents int").selectExpr(
        "id", "category", "cast(cents / 100 as decimal(12,2)) AS revenue"
    )
    want_all = {i: 1 + sum(o[2] > c for o in rows) for i, _, c in rows}
    want_cat = {i: 1 + sum(o[2] > c and o[1] == k for o in rows) for i, k, c in rows}
    overall = rank_desc(df, "revenue", "r", buckets=buckets).collect()
    within = rank_desc(df, "revenue", "r", ["category"], buckets).collect()
    assert {r.id: r.r for r in overall} == want_all
    assert {r.id: r.r for r in within} == want_cat


@pytest.mark.parametrize("width", [2, 40])
def test_row_numbers_with_ties(spark, width):
    rows = revenues()
    df = spark.createDataFrame(rows, "id bigint, category string, cents int").selectExpr(
        "id", "category", "cast(cents / 100 as decimal(12,2)) AS revenue"
    )
    want = {}
    for category in ("big", "small"):
        ordered = sorted((r for r in rows if r[1] == category), key=lambda r: (-r[2], r[0]))
        want.update({r[0]: n for n, r in enumerate(ordered, 1)})
    got = row_number_desc(df, "revenue", "id", "n", ["category"], buckets=width).collect()
    assert {r.id: r.n for r in got} == want


def test_dedupe_of_a_hot_key(spark):
    rng = random.Random(9)
    rows = [(1 if rng.random() < 0.4 else i, rng.randint(0, 50), rng.randint(0, 9)) for i in range(2000)]
    best = {}
    for key, at, value in rows:
        best[key] = max(best.get(key, (-1, -1)), (at, value))
    df = spark.createDataFrame(rows, "k bigint, at bigint, v bigint").repartition(8)
    got = {r.k: (r.at, r.v) for r in dedupe_latest(df, ["k"], "at").collect()}
    assert got == best


def test_orphans_of_a_hot_key(spark):
    rows = [(5,)] * 700 + [(i % 30,) for i in range(900)] + [(None,)] * 40
    child = spark.createDataFrame(rows, "k bigint")
    parent = spark.createDataFrame([(i,) for i in range(30) if i != 5] * 2, "id bigint")
    row = relationships(child, "c", "k", parent, "id").first()
    assert (row.n_rows, row.n_failed) == (1600, 730)
    row = unique(child, "c", ["k"]).first()
    assert (row.n_rows, row.n_failed) == (1600, 30)


def test_upstream_of_a_shared_ancestor(spark):
    rng = random.Random(2)
    edges = [(i, 0) for i in range(1, 60)] + [(i, rng.randint(1, 59)) for i in range(60, 300)]
    edges += [(i, rng.randint(60, 299)) for i in range(300, 500)]
    parents = defaultdict(set)
    for child, parent in edges:
        parents[child].add(parent)
    want = set()
    for target in range(300, 500):
        level, depth, seen = {target}, 0, set()
        while level:
            depth += 1
            level = {p for n in level for p in parents[n]} - seen
            seen |= level
            want |= {(target, a, depth) for a in level}
    df = spark.createDataFrame(edges, "child bigint, parent bigint")
    targets = spark.createDataFrame([(i,) for i in range(300, 500)], "node bigint")
    assert {tuple(r) for r in upstream(df, targets).select("target", "ancestor", "depth").collect()} == want


def test_a_cycle_is_an_error_or_ends(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1)], "child bigint, parent bigint")
    got = upstream(edges, spark.createDataFrame([(1,)], "node bigint"))
    assert {tuple(r) for r in got.collect()} == {(1, 2, 1), (1, 1, 2)}


def test_a_chain_of_any_depth(spark):
    edges = spark.range(1, 131).selectExpr("id AS child", "id - 1 AS parent")
    got = upstream(edges, spark.createDataFrame([(130,)], "node bigint"))
    assert got.count() == 130 and got.agg(F.max("depth")).first()[0] == 130
