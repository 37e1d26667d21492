"""Quality, governance, partitions and run records."""

from __future__ import annotations

from datetime import datetime

import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeloom.functions.redact import redact, redact_message, safe_attributes
from lakeloom.operators import governance, partitions, quality, runs
from lakeloom.operators.governance import Action, Policy
from lakeloom.plans import staging
from lakeloom.session import scratch_path, shared_dir
from lakeloom.sources import bronze
from lakeloom.sources.datasets import Dataset


def test_enforce(spark):
    df = spark.createDataFrame([(1,), (None,)], "id int")
    report = quality.check_rows(df, "t", [quality.not_null("id")])
    assert quality.enforce(report, fail_on_error=False).first().n_failed == 1
    with pytest.raises(quality.QualityError, match="not_null t.id: 1"):
        quality.enforce(report)
    quality.enforce(quality.check_rows(df.dropna(), "t", [quality.not_null("id")]))


def test_nulls_pass_value_checks(spark):
    df = spark.createDataFrame([(None,), ("a",), ("z",)], "v string")
    report = quality.check_rows(df, "t", [quality.accepted_values("v", ["a"])])
    assert report.first().n_failed == 1


def test_no_schema_drift(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert quality.schema_drift(df, StructType.fromDDL("a int")).count() == 0


def test_freshness_of_an_empty_table_fails(spark):
    df = spark.createDataFrame([], "at timestamp_ntz")
    assert quality.freshness(df, "at", F.lit("2024-01-01").cast("timestamp_ntz"), 1).first().failed


def test_quarantine_conserves_rows(spark):
    df = spark.createDataFrame(
        [(0, "Ann", "a@b.co"), (1, "", "bad"), (2, "Bo", "b@c.de"), (3, None, None)],
        "customer_id bigint, name string, email string",
    ).withColumns({"region": F.lit("north"), "created_at": F.current_timestamp()})
    good, bad = quality.quarantine(df, quality.customer_rules())
    assert [r.customer_id for r in good.collect()] == [2]
    assert {r.customer_id: r.failed_rules for r in bad.collect()} == {
        0: ["customer_id"],
        1: ["name", "email"],
        3: ["name", "email"],
    }


# --- governance ------------------------------------------------------------


@pytest.fixture
def people(spark):
    df = spark.createDataFrame(
        [(1, "Ann Lee", "ann@x.org", 10.5), (2, None, None, None)],
        "id bigint, name string, email string, salary double",
    )
    classes = {
        "name": {"classification": "pii"},
        "email": {"classification": "pii", "pii_type": "email"},
        "salary": {"classification": "financial"},
    }
    return governance.classify(df, classes)


def view(people, policies, environment, roles=(), **options):
    return governance.apply_policies(people, policies, environment, roles, **options)


def test_restrict_needs_every_role(people):
    policies = {"pii": Policy(Action("restrict", ("owner", "compliance")), Action("synthesize"))}
    assert view(people, policies, "production", ["owner"]).columns == ["id", "salary"]
    assert view(people, policies, "production", ["owner", "compliance"]).columns == people.columns
    nobody = {"pii": Policy(Action("restrict"))}  # no role is named, so none can open it
    assert view(people, nobody, "production", ["owner"]).columns == ["id", "salary"]
    assert view(people, nobody, "staging").columns == people.columns


def test_synthetic_values_are_stable_and_new(people):
    policies = {"pii": Policy(None, Action("synthesize"))}
    first = view(people, policies, "dev").collect()
    assert first == view(people.repartition(5), policies, "dev").orderBy("id").collect()
    assert first[0].name != "Ann Lee" and "@" in first[0].email and first[0].email != "ann@x.org"
    assert first[1].name is None and first[1].email is None


def test_actions_by_type(people):
    for action, want in [("redact", None), ("mask", "10.5"), ("hash", None)]:
        got = view(people, {"financial": Policy(Action(action))}, "production", salt="s").first()
        if action == "hash":
            assert len(got.salary) == 64
        else:
            assert got.salary == want or action == "mask"
    assert view(people, {"pii": Policy(Action("mask"))}, "production").first().email == "***@x.org"


def test_patterns_apply_to_unclassified_columns_only(people):
    rows = people.withColumn("backup_email", F.col("id").cast("string"))
    got = view(rows, {}, "production", patterns=[("*email*", "redact")]).first()
    assert got.backup_email is None and got.email == "ann@x.org"


def test_masks(spark):
    df = spark.createDataFrame([("abc",), ("123456789",), ("",), (None,)], "v string")
    got = [r[0] for r in df.select(governance.mask_keep_last("v")).collect()]
    assert got == ["abc", "*****6789", "", None]


def test_bad_governance_input(people):
    with pytest.raises(ValueError):
        Action("encrypt")
    with pytest.raises(ValueError):
        governance.classify(people, {"nothing": {}})
    with pytest.raises(ValueError):
        governance.retention_split(people, "id", F.current_date(), 10, 20)


def test_messages(spark):
    text = "PASSWORD = 'x' token=\"y\" Authorization: Bearer abc.def select * WHERE id = '5' end"
    want = "[REDACTED] [REDACTED] [REDACTED] select * [REDACTED] end"
    row = spark.createDataFrame([(text, "a" * 501, "b" * 500)], "m string, long string, fits string")
    got = row.select(*[redact_message(c) for c in ("m", "long", "fits")]).first()
    assert got[0] == want and got[1] == "a" * 497 + "..." and got[2] == "b" * 500


def test_attributes(spark):
    attributes = {"rows": "1", "X-API_KEY": "k", "SessionId": "s", "cube": "Orders"}
    df = spark.createDataFrame([(attributes,)], "a map<string,string>")
    assert df.select(safe_attributes("a")).first()[0] == {"rows": "1", "cube": "Orders"}


# --- partitions ------------------------------------------------------------


def keys(spark, start, end, frequency, fmt=None):
    bounds = spark.range(1)
    low, high = (F.lit(v).cast("timestamp") for v in (start, end))
    return [
        r.partition_key
        for r in partitions.time_keys(bounds, low, high, frequency, fmt).orderBy("index").collect()
    ]


def test_time_keys(spark):
    assert keys(spark, "2024-02-28", "2024-03-02", "day") == ["2024-02-28", "2024-02-29", "2024-03-01"]
    assert keys(spark, "2024-01-15", "2024-04-01", "month") == ["2024-01", "2024-02", "2024-03"]
    assert keys(spark, "2024-01-01 22:30", "2024-01-02 01:00", "hour") == [
        "2024-01-01-22",
        "2024-01-01-23",
        "2024-01-02-00",
    ]
    assert keys(spark, "2024-01-03", "2024-01-16", "week") == ["2024-01-01", "2024-01-08", "2024-01-15"]
    assert keys(spark, "2024-01-03", "2024-01-03", "day") == []
    assert keys(spark, "2024-01-03", "2024-01-04", "day", "dd.MM.yyyy") == ["03.01.2024"]
    with pytest.raises(ValueError):
        keys(spark, "2024-01-03", "2024-01-04", "fortnight")


def test_bad_keys_are_errors(spark):
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            partitions.static_keys(spark, bad)
        with pytest.raises(ValueError):
            partitions.multi_keys(partitions.static_keys(spark, ["x"]), {"r": bad})
    good = spark.createDataFrame([("a", 0)], "partition_key string, index bigint")
    for start, end, size in [("b", "a", 1), ("a", "b", 0)]:
        with pytest.raises(ValueError):
            partitions.backfill_plan(good, start, end, size)
    with pytest.raises(ValueError):
        partitions.select_keys(good, "some")


def test_backfill_of_many_partitions_runs_each_once(spark):
    rows = [(f"k{i:03d}", i) for i in range(130)]
    plan = partitions.backfill_plan(
        spark.createDataFrame(rows, "partition_key string, index bigint"), "k010", "k119", 25
    )
    seen = []
    assert partitions.run_backfill(plan, seen.append) == 5
    assert sum(seen, []) == [k for k, i in rows if 10 <= i <= 119] and len(seen[0]) == 25


# --- runs ------------------------------------------------------------------


def test_runs_record_success_and_failure(spark):
    log = runs.RunLog(spark, scratch_path(spark, "log"))
    with log.asset_run("good", outputs=["a"]) as run:
        run.n_rows = 5
    with pytest.raises(RuntimeError), log.asset_run("bad", inputs=["a"]):
        raise RuntimeError("secret = 'abc'")
    summary = {r.status: r for r in runs.run_summary(log.read()).collect()}
    assert summary["COMPLETE"].n_rows == 5 and summary["FAIL"].seconds >= 0
    failed = runs.run_status_since(log.read(), "FAIL", datetime(2020, 1, 1), ["bad"]).first()
    assert failed.error == "[REDACTED]" and failed.inputs == ["a"]
    assert runs.run_status_since(log.read(), "FAIL", datetime(2020, 1, 1), ["good"]).isEmpty()
    assert runs.run_status_since(log.read(), "FAIL", datetime(2120, 1, 1)).isEmpty()


def test_a_function_as_an_asset(spark):
    log = runs.RunLog(spark, scratch_path(spark, "log"))
    table = Dataset(spark, scratch_path(spark, "t"))

    @log.asset(outputs=["silver.numbers"], inputs=["bronze.numbers"])
    def numbers(n):
        return table.append(spark.range(n))

    assert numbers(7).n_rows == 7 and numbers.__name__ == "numbers"
    done = log.read().where("event_type = 'COMPLETE'").first()
    assert (done.job, done.n_rows, done.outputs) == ("numbers", 7, ["silver.numbers"])


def month_names(year):
    return [f"{year}-{m:02d}" for m in (1, 2)]


def test_keys_from_functions(spark):
    for fn in (month_names, f"{month_names.__module__}.month_names"):
        got = partitions.keys_from(spark, fn, year=2024)
        assert [r[0] for r in got.collect()] == ["2024-01", "2024-02"]


def test_scratch_lives_in_the_named_folder(spark, monkeypatch):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is not None:
        assert shared_dir(spark) == named
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first != second and first.startswith(shared_dir(spark))


def test_long_texts_are_redacted_whole(spark):
    text = "x" * 600 + " password = 'a' " + "y" * 600
    row = spark.createDataFrame([(text,)], "m string").select(redact("m")).first()
    assert row[0] == "x" * 600 + " [REDACTED] " + "y" * 600


def test_orders_without_a_customer_and_lines_without_quantity(spark, tmp_path):
    for name in ("nation", "region", "customer", "orders", "lineitem"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(40).write.parquet(f"{tmp_path}/{name}.parquet")
    orders, lines = spark.read.parquet(f"{SMALL}/orders.parquet").limit(1), spark.read.parquet(f"{SMALL}/lineitem.parquet").limit(1)
    orders.withColumns({"o_orderkey": F.lit(10**12).cast("bigint"), "o_custkey": F.lit(-5).cast("bigint"), "o_totalprice": F.lit(2e8)}).write.mode("append").parquet(f"{tmp_path}/orders.parquet")
    lines.withColumn("l_quantity", F.lit(0.0)).write.mode("append").parquet(f"{tmp_path}/lineitem.parquet")
    raw = bronze.raw_orders(spark, str(tmp_path))
    assert raw.count() == 41 and raw.where("customer_id = -5 and region is null").count() == 1
    assert staging.stg_orders(raw).where("customer_id = -5").first().total_amount is None
    assert bronze.raw_order_items(spark, str(tmp_path)).where("price is null").count() == 1
