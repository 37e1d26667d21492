from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lakeloom.operators.runs import RunLog
from lakeloom.session import scratch_path
from lakeloom.sources.datasets import Dataset
from lakeloom.sources.layout import PartitionField
from lakeloom.streaming import jobs
from test_skew import hot_events, session_oracle


def table(spark, *fields):
    return Dataset(spark, scratch_path(spark, "t"), fields)


def test_new_files_only_and_only_matching_ones(spark):
    folder, checkpoint, target = scratch_path(spark, "in"), scratch_path(spark, "cp"), table(spark)

    def run():
        stream = jobs.file_stream(spark, folder, "id bigint", "*.parquet", files_per_batch=1)
        jobs.ingest(stream, target, checkpoint).awaitTermination()
        return sorted(r.id for r in target.scan().collect())

    spark.range(3).coalesce(1).write.parquet(folder)
    assert run() == [0, 1, 2]
    spark.range(90, 92).write.mode("append").json(folder)  # not matched by the pattern
    spark.range(10, 12).coalesce(1).write.mode("append").parquet(folder)
    assert run() == [0, 1, 2, 10, 11] == run()


def test_a_timed_job_takes_files_as_they_come(spark):
    folder, target = scratch_path(spark, "in"), table(spark)
    spark.range(3).coalesce(1).write.parquet(folder)
    query = jobs.ingest(jobs.file_stream(spark, folder, "id bigint"), target, scratch_path(spark, "cp"), every="1 second")
    try:
        for high in (6, 9):
            query.processAllAvailable()
            assert target.scan().count() == high - 3
            spark.range(high - 3, high).coalesce(1).write.mode("append").parquet(folder)
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(r.id for r in target.scan().collect()) == list(range(9))


def test_a_batch_that_fails_after_its_write_is_not_doubled(spark):
    folder, checkpoint, target = scratch_path(spark, "in"), scratch_path(spark, "cp"), table(spark)
    spark.range(5).coalesce(1).write.parquet(folder)

    def broken(batch, number):
        target.append(batch, batch=f"ingest-{number}")
        raise RuntimeError("lost the driver")

    with pytest.raises(Exception, match="lost the driver"):
        jobs.each_batch(jobs.file_stream(spark, folder, "id bigint"), checkpoint, broken).awaitTermination()
    jobs.ingest(jobs.file_stream(spark, folder, "id bigint"), target, checkpoint).awaitTermination()
    assert target.scan().count() == 5 and target.partitions().count() == 1


def test_new_loads_start_runs(spark):
    source, target, checkpoint = table(spark), table(spark), scratch_path(spark, "cp")
    for n in (3, 4):
        source.append(spark.range(n))
        jobs.refine(source, lambda rows: rows.selectExpr("id * 2 AS id"), target, checkpoint).awaitTermination()
    assert sorted(r.id for r in target.scan().collect()) == [0, 0, 2, 2, 4, 4, 6]


def test_copies_of_other_batches_and_late_rows(spark):
    source, target, checkpoint = table(spark), table(spark), scratch_path(spark, "cp")
    schema = "id bigint, ts timestamp_ntz"
    for rows in ([(1, 20), (1, 20), (2, 21)], [(2, 21), (3, 22), (4, 1)], [(4, 1), (5, 2)]):
        source.append(spark.createDataFrame([(i, datetime(2024, 1, d)) for i, d in rows], schema))
        stream = jobs.arrivals(source)
        jobs.dedupe(stream, ["id"], "ts", 2, target, checkpoint).awaitTermination()
    assert sorted(r.id for r in target.scan().collect()) == [1, 2, 3, 4, 5]


def test_sessions_over_batches_with_a_hot_user(spark):
    rows = hot_events(400, seed=4)
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string").withColumn(
        "timestamp", F.expr("timestamp_ntz'2024-01-01'")
    )
    source, target = table(spark), table(spark)
    state = jobs.session_state(spark, scratch_path(spark, "state"), 4)
    checkpoint = scratch_path(spark, "cp")
    for low, high in [(0, 30), (30, 31), (31, 250), (250, 500)]:
        source.append(df.where(f"event_id >= {low} and event_id < {high}"))
        jobs.sessions(source, target, state, checkpoint).awaitTermination()
    got = {r.event_id: r.session_id for r in target.scan().collect()}
    assert got == session_oracle(rows)
    # The state is one row per user, whatever the number of batches.
    assert state.scan().count() == state.scan().select("user_id").distinct().count()


def test_sessions_of_a_batch_that_ran_before(spark):
    """A batch that died after its writes is run again and gives the same."""
    rows = [(1, 7, "login"), (2, 7, "view"), (3, 7, "logout"), (4, 7, "login"), (5, 7, "view")]
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string")
    df = df.withColumn("timestamp", F.expr("timestamp_ntz'2024-01-01'"))
    source, target = table(spark), table(spark)
    state = jobs.session_state(spark, scratch_path(spark, "state"), 4)
    source.append(df.where("event_id <= 2").coalesce(1))
    first = scratch_path(spark, "cp")
    jobs.sessions(source, target, state, first).awaitTermination()
    # Another cursor that starts at the beginning: the first batch comes again under the same number.
    jobs.sessions(source, target, state, scratch_path(spark, "cp")).awaitTermination()
    source.append(df.where("event_id > 2").coalesce(1))
    jobs.sessions(source, target, state, first).awaitTermination()
    assert {r.event_id: r.session_id for r in target.scan().collect()} == session_oracle(rows)


def test_rollup_updates_a_day_that_grows(spark):
    folder, checkpoint = scratch_path(spark, "in"), scratch_path(spark, "cp")
    target = table(spark)
    schema = "ts timestamp_ntz, kind string"

    def arrive(*rows):
        df = spark.createDataFrame([(datetime(2024, 1, d), k) for d, k in rows], schema)
        df.coalesce(1).write.mode("append").parquet(folder)
        jobs.rollup_by_day(
            jobs.file_stream(spark, folder, schema), "ts", ["kind"], target, checkpoint
        ).awaitTermination()

    arrive((1, "a"), (2, "a"), (2, "b"))
    arrive((2, "a"), (30, "a"))
    arrive((1, "a"))  # four weeks late, and counted
    got = {(r.day.day, r.kind): r.n for r in jobs.rollup_total(target, ["kind"]).collect()}
    assert got == {(1, "a"): 2, (2, "a"): 2, (2, "b"): 1, (30, "a"): 1}


def test_merge_takes_late_rows_within_the_limit(spark):
    schema = "id bigint, ts timestamp_ntz, v string"
    source, aside, newest = table(spark), table(spark), table(spark)
    target, checkpoint = table(spark, PartitionField("ts", "day")), scratch_path(spark, "cp")
    for rows in (
        [(1, 20, "a"), (2, 19, "a")],
        [(3, 14, "late"), (4, 3, "too late"), (1, 21, "newer")],
        [(2, 15, "older than known"), (5, 22, "b")],
    ):
        data = [(i, datetime(2024, 1, d), v) for i, d, v in rows]
        source.append(spark.createDataFrame(data, schema))
        jobs.merge_late(source, target, aside, newest, ["id"], "ts", 7, checkpoint).awaitTermination()
    assert {r.id: r.v for r in target.scan().collect()} == {1: "newer", 2: "a", 3: "late", 5: "b"}
    assert [r.id for r in aside.scan().collect()] == [4]


def test_keys_whose_update_comes_weeks_later(spark):
    """The row of January goes when February's update arrives, with a layout by time and with one by key; a batch without accepted rows changes nothing."""
    schema = "id bigint, ts timestamp_ntz, v string"
    for layout in (PartitionField("ts", "month"), PartitionField("id", "truncate", 2)):
        source, aside, newest = table(spark), table(spark), table(spark)
        target, checkpoint = table(spark, layout), scratch_path(spark, "cp")
        for rows in ([(1, 1, 20, "pending"), (2, 1, 21, "pending")], [(1, 2, 25, "completed")], [(3, 1, 1, "late")], [], [(2, 2, 26, "completed")]):
            source.append(spark.createDataFrame([(i, datetime(2024, m, d), v) for i, m, d, v in rows], schema))
            jobs.merge_late(source, target, aside, newest, ["id"], "ts", 7, checkpoint).awaitTermination()
        assert sorted((r.id, r.v) for r in target.scan().collect()) == [(1, "completed"), (2, "completed")]
        assert [r.id for r in aside.scan().collect()] == [3]


def test_rows_without_a_key_are_all_kept(spark):
    source, target, checkpoint = table(spark), table(spark), scratch_path(spark, "cp")
    schema = "id bigint, part bigint, ts timestamp_ntz"
    for rows in ([(None, 1), (None, 1), (1, 1), (1, None)], [(None, 1), (1, 1), (1, None)]):
        source.append(spark.createDataFrame([(i, p, datetime(2024, 1, 1)) for i, p in rows], schema))
        jobs.dedupe(jobs.arrivals(source), ["id", "part"], "ts", 2, target, checkpoint).awaitTermination()
    got = sorted(((r.id, r.part) for r in target.scan().collect()), key=str)
    assert got == sorted([(None, 1)] * 3 + [(1, None)] * 2 + [(1, 1)], key=str)


def accept(spark, source, days, parts):
    """A diverting job that is started again for every load."""
    aside, newest, accepted, checkpoint = table(spark), table(spark), table(spark), scratch_path(spark, "cp")

    def load(df):
        source.append(df)
        jobs.divert_late(source, accepted, aside, newest, "timestamp", days, checkpoint).awaitTermination()

    return accepted, aside, load


def events(spark, rows):
    """Rows of event id, user, type, day and hour of January 2024."""
    made = [(e, u, k, datetime(2024, 1, d, h)) for e, u, k, d, h in rows]
    return spark.createDataFrame(made, "event_id bigint, user_id bigint, event_type string, timestamp timestamp_ntz")


def test_copies_are_found_in_the_state_which_stays_small(spark):
    source = table(spark)
    accepted, aside, load = accept(spark, source, 2, 8)
    once, checkpoint = table(spark), scratch_path(spark, "cp")
    sizes = []
    for day in range(1, 10):
        rows = [(day * 10 + i, 1, "a", day, i) for i in range(5)]
        again = [(day * 10 - 10 + i, 1, "a", day - 1, i) for i in range(3)] if day > 1 else []
        keyless = [(None, 1, "a", day, 1)] * 2
        late = [(1000 + day, 1, "late", day - 4, 0)] if day > 4 else []
        load(events(spark, rows + again + keyless + late))
        query = jobs.once_within(accepted, ["event_id"], 2, once, checkpoint)
        query.awaitTermination()
        sizes.append(sum(op["numRowsTotal"] for op in query.lastProgress["stateOperators"]))
    got = [r.event_id for r in once.scan().collect()]
    assert sorted(e for e in got if e is not None) == [day * 10 + i for day in range(1, 10) for i in range(5)]
    assert got.count(None) == 18
    assert sorted(r.event_id for r in aside.scan().collect()) == [1000 + day for day in range(5, 10)]
    assert max(sizes[5:]) <= max(sizes[:5]) <= 30


def test_sessions_time_out(spark):
    """Over four batches, each a restart: a session that is idle is closed once, by a timer or by the user's next event."""
    source = table(spark)
    accepted, _, load = accept(spark, source, 1, 4)
    target, checkpoint = table(spark), scratch_path(spark, "cp")
    hot = [(100 + i, 9, "view", 1, i) for i in range(20)]
    parts = [
        [(1, 1, "login", 1, 1), (2, 1, "view", 1, 2), (3, 2, "login", 1, 3), (4, 3, "login", 1, 4), (99, 9, "login", 1, 0), *hot],
        [(200, 1, "view", 1, 20), (201, 2, "logout", 1, 21)],
        [(300, 1, "view", 3, 0), (301, 9, "view", 1, 23)],
        [(400, 4, "view", 9, 0), (401, None, "login", 9, 1)],
    ]
    for rows in parts:
        load(events(spark, rows))
        jobs.sessions_in_state(accepted, target, checkpoint, timedelta(days=1)).awaitTermination()
    rows = target.scan().collect()
    got = {r.event_id: r.session_id for r in rows if r.event_id is not None}
    assert got == {
        1: "sess_1", 2: "sess_1", 3: "sess_3", 4: "sess_4", 99: "sess_99", **{100 + i: "sess_99" for i in range(20)},
        200: "sess_1", 201: "sess_3", 300: None, 301: "sess_99", 400: None, 401: "sess_401",
    }
    ended = sorted((r.session_id, r.timestamp) for r in rows if r.event_type == "expired")
    assert ended == [("sess_1", datetime(2024, 1, 2, 20)), ("sess_4", datetime(2024, 1, 2, 4)), ("sess_99", datetime(2024, 1, 2, 23))]


def test_folders_of_many_batches_are_folded(spark, monkeypatch):
    """Twenty-one batches by threes: few folders, nothing lost or doubled, the last batch replaces itself, a folding that died is finished."""
    t = table(spark)
    add = lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n"))
    carry_out, died = Dataset._carry_out, []

    def sometimes(self, plan):
        if plan.get("batch") == "b-9..11" and not died:
            died.append(plan)
            self._write(spark.read.parquet(plan["rows"]), f"{self.path}/_batch={plan['batch']}", "overwrite", "static")
            raise RuntimeError("lost the driver")
        return carry_out(self, plan)

    monkeypatch.setattr(Dataset, "_carry_out", sometimes)
    for number in range(21):
        for _ in range(1 + (number % 5 == 4 or number == 12)):  # some run twice
            try:
                if number:
                    t.fold("b", number, 3, add)
            except RuntimeError:
                continue
            t.append(spark.createDataFrame([(number % 2, 1), (7, number)], "k int, n int"), batch=f"b-{number}")
    assert died and t.scan().groupBy("k").agg(F.sum("n").alias("n")).orderBy("k").collect() == [(0, 11), (1, 10), (7, 210)]
    folders = sorted(r[0] for r in t.partitions().select("_batch").collect())
    assert folders == ["b-0..8", "b-18", "b-19", "b-20", "b-9..17"]


def test_run_watcher_sees_each_run_once(spark):
    log = RunLog(spark, scratch_path(spark, "log"))
    target, checkpoint = table(spark), scratch_path(spark, "cp")

    def watch():
        stream = jobs.watch_runs(spark, log.path, "COMPLETE", ["nightly"])
        jobs.ingest(stream.select("run_id", "job"), target, checkpoint).awaitTermination()
        return target.scan().count()

    for job in ("nightly", "other"):
        with log.asset_run(job):
            pass
    assert watch() == 1
    with log.asset_run("nightly"):
        pass
    assert watch() == 2 == watch()
