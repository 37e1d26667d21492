"""Backfills that go on, lineage by doubling, and writes that check their rows."""

from __future__ import annotations

import re
import threading

import pytest
from pyspark.sql import functions as F

from lakeloom.operators import partitions, quality, runs
from lakeloom.session import materialize, scratch_path
from lakeloom.sources.datasets import Dataset


def plan_of(spark, n, size):
    keys = spark.range(n).selectExpr("format_string('k%02d', id) AS partition_key", "id AS index")
    return partitions.backfill_plan(keys, "k00", f"k{n - 1:02d}", size)


@pytest.mark.parametrize("together", [1, 2])
def test_a_broken_backfill_does_what_is_left(spark, together):
    plan, done, calls, lock = plan_of(spark, 10, 2), Dataset(spark, scratch_path(spark, "done")), [], threading.Lock()

    def load(keys, breaks=None):
        with lock:
            calls.append(keys)
        if breaks in keys:
            raise RuntimeError("lost the driver")

    with pytest.raises(RuntimeError):
        partitions.run_backfill(plan, lambda keys: load(keys, "k04"), done, 1)
    assert calls == [["k00", "k01"], ["k02", "k03"], ["k04", "k05"]]
    calls.clear()
    assert partitions.run_backfill(plan, load, done, together) == 3
    assert sorted(calls) == [["k04", "k05"], ["k06", "k07"], ["k08", "k09"]]
    assert partitions.run_backfill(plan, load, done, together) == 0
    assert partitions.run_backfill(plan, load) == 5


def test_batches_run_together_stop_when_one_breaks(spark):
    started, lock = [], threading.Lock()

    def load(keys):
        with lock:
            started.append(keys[0])
        if keys[0] == "k00":
            raise RuntimeError("broken")
        spark.range(10).count()

    with pytest.raises(RuntimeError):
        partitions.run_backfill(plan_of(spark, 20, 1), load, together=2)
    assert len(started) < 20


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    store = runs.materialize
    monkeypatch.setattr(runs, "materialize", lambda df, name: rounds.append(name) or store(df, name))
    found = runs.closure(spark.range(300).selectExpr("id AS child", "id + 1 AS parent"))
    assert found.count() == 300 * 301 // 2 and len(rounds) <= 12
    assert found.agg(F.max("depth")).first()[0] == 300
    assert found.where("depth <> ancestor - node").isEmpty() and runs.circles(found).isEmpty()


def test_circles_shorter_ways_and_odd_edges(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("x", "a"), ("y", "y"), (None, "a"), ("z", None), ("a", "b")]
    found = runs.closure(spark.createDataFrame(edges, "child string, parent string"))
    want = [
        ("a", "a", 2), ("a", "b", 1), ("a", "c", 1), ("b", "a", 2), ("b", "b", 3), ("b", "c", 1), ("c", "a", 1), ("c", "b", 2), ("c", "c", 2),
        ("x", "a", 1), ("x", "b", 2), ("x", "c", 2), ("y", "y", 1),
    ]
    assert pairs(found) == want
    assert pairs(runs.circles(found)) == [("a", "a"), ("b", "a"), ("c", "a"), ("y", "y")]
    assert runs.closure(spark.createDataFrame([], "child string, parent string")).count() == 0


def test_closure_joins_only_the_longest_ways(spark, monkeypatch):
    """A round finds a longer way from the ways of exactly 2^k steps; circles hold only nodes that lead to themselves against each other."""
    plans = []

    def spy(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return materialize(df, name)

    monkeypatch.setattr(runs, "materialize", spy)
    edges = [(i, i + 1) for i in range(20)] + [(30, 31), (31, 32), (32, 30), (40, 40), (41, 40), (7, 5), (0, 3)]
    found = runs.closure(spark.createDataFrame(edges, "child bigint, parent bigint"))
    # Lengths 1, 2, 4, 8, 16 and 32; the last round that finds none is not written.
    assert 4 <= len(plans) <= 6 and all(re.search(r"depth#\d+ = \d+", text) for text in plans[1:])
    up, want = {}, {}
    for child, parent in edges:
        up.setdefault(child, set()).add(parent)
    for node in up:
        level, depth = up[node], 1
        while level:
            want |= {(node, a): depth for a in level}
            level, depth = {p for a in level for p in up.get(a, ()) if (node, p) not in want}, depth + 1
    assert {(r.node, r.ancestor): r.depth for r in found.collect()} == want
    held = runs.circles(found)
    assert "LeftSemi" in held._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, held.collect())) == [(5, 5), (6, 5), (7, 5), (30, 30), (31, 30), (32, 30), (40, 40)]


def test_a_checked_write_reads_its_source_once(spark):
    path = scratch_path(spark, "rows")
    spark.range(100).selectExpr("id", "if(id % 10 = 0, null, id % 7) AS n").write.parquet(path)
    rules = {"positive": F.col("n") > 0, "small": F.col("id") < 90}
    source = spark.read.parquet(path).where(F.col("id") >= 0)
    target = scratch_path(spark, "checked")
    done = quality.write_checked(source, rules, target)
    kept = [i for i in range(90) if i % 10 and i % 7]
    assert sorted(r.id for r in done.kept.collect()) == kept and done.kept.columns == ["id", "n"]
    assert done.n_rows == 100 and done.n_failed == {"positive": sum(1 for i in range(100) if not (i % 10 and i % 7)), "small": 10}
    assert {r.id: r.failed_rules for r in done.broken.where("id in (90, 91, 92)").collect()} == {90: ["positive", "small"], 91: ["positive", "small"], 92: ["small"]}
    assert pairs(done.counts()) == pairs(quality.rule_counts(source, rules).select("rule", "n_rows", "n_failed"))
    # Twice is once; and nothing at all is written as nothing.
    again = quality.write_checked(source, rules, target)
    assert again.kept.count() == len(kept)
    none = quality.write_checked(source.where("id < 0"), rules, target)
    assert none.n_rows == 0 and none.kept.count() == 0 and none.broken.count() == 0
