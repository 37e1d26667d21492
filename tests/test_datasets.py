from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegerType, LongType, StringType, StructType

from lakeloom.session import scratch_path
from lakeloom.sources import layout
from lakeloom.sources.datasets import Dataset, upsert, write_table
from lakeloom.sources.layout import PartitionField, merged_schema, wider, with_partitions
from lakeloom.sources.scan import key_range, layer_path, load_input, table_name


def table(spark, *fields):
    return Dataset(spark, scratch_path(spark, "t"), fields)


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id bigint, day string")


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_append_and_overwrite(spark):
    t = table(spark)
    t.append(rows(spark, (1, "a")))
    assert t.append(rows(spark, (2, "b"))).n_rows == 1
    assert values(t.scan()) == [(1, "a"), (2, "b")]
    assert t.overwrite(rows(spark, (3, "c"))).n_rows == 1
    assert values(t.scan()) == [(3, "c")]
    assert values(t.scan(columns=["day"], row_filter="id = 3", limit=5)) == [("c",)]


def test_no_table(spark):
    t = table(spark)
    assert not t.exists()
    with pytest.raises(ValueError):
        t.scan()
    with pytest.raises(ValueError):
        write_table(spark, t.path, rows(spark, (1, "a")), "append", create_if_not_exists=False)
    with pytest.raises(ValueError):
        write_table(spark, t.path, rows(spark, (1, "a")), "upsert")


def test_a_batch_replaces_itself(spark):
    t = table(spark)
    t.append(rows(spark, (1, "a"), (2, "a")), batch="b1")
    t.append(rows(spark, (5, "a")), batch="b2")
    t.append(rows(spark, (1, "a")), batch="b1")
    assert values(t.scan()) == [(1, "a"), (5, "a")] and t.partitions().count() == 2


def test_partition_overwrite_touches_only_its_partitions(spark):
    t = table(spark, PartitionField("day"))
    t.append(rows(spark, (1, "a"), (2, "b"), (3, None), (4, "")))
    t.overwrite_partitions(rows(spark, (10, "b"), (11, "c")))
    assert {r.id for r in t.scan().collect()} == {1, 3, 4, 10, 11}
    t.overwrite_partitions(rows(spark, (20, None)))
    assert {r.id for r in t.scan().collect()} == {1, 10, 11, 20}  # null and empty share a partition


def test_merge_finds_rows_that_change_partition(spark):
    t = table(spark, PartitionField("day"))
    schema = "id bigint, day string, v bigint, at bigint"
    t.append(spark.createDataFrame([(1, "a", 1, 1), (2, "a", 1, 1), (3, "b", 1, 5)], schema))
    t.merge(spark.createDataFrame([(1, "c", 2, 2), (3, "b", 9, 4), (4, "d", 1, 1)], schema), ["id"], "at")
    assert values(t.scan()) == [(1, "c", 2, 2), (2, "a", 1, 1), (3, "b", 1, 5), (4, "d", 1, 1)]


def test_merge_keeps_what_has_no_update(spark):
    """Repeated keys and null keys stay, in partitions that change and in others; only a replaced key's rows go."""
    schema = "id bigint, day string, v bigint, at bigint"
    t = table(spark, PartitionField("day"))
    old = [(1, "a", 1, 1), (1, "a", 2, 1), (2, "a", 1, 1), (2, "a", 1, 1), (None, "a", 5, 1), (None, "a", 6, 1), (3, "b", 1, 1), (3, "b", 1, 1)]
    t.append(spark.createDataFrame(old, schema))
    new = [(1, "a", 9, 2), (1, "a", 8, 1), (None, "a", 7, 1), (None, "c", 7, 1)]
    t.merge(spark.createDataFrame(new, schema), ["id"], "at")
    want = [r for r in old if r[0] != 1] + [(1, "a", 9, 2), (None, "a", 7, 1), (None, "c", 7, 1)]
    assert sorted(map(tuple, t.scan().collect()), key=str) == sorted(want, key=str)


def test_merge_without_partitions(spark):
    schema = "id bigint, v bigint, at bigint"
    t = table(spark)
    t.merge(spark.createDataFrame([(1, 1, 1), (2, 1, 1)], schema), ["id"], "at")
    t.merge(spark.createDataFrame([(2, 2, 2), (3, 1, 1)], schema), ["id"], "at")
    assert values(t.scan()) == [(1, 1, 1), (2, 2, 2), (3, 1, 1)]


def test_merge_twice_is_the_same(spark):
    schema = "id bigint, day string, v bigint, at bigint"
    updates = spark.createDataFrame([(1, "a", 2, 2), (5, "b", 1, 1)], schema)
    t = table(spark, PartitionField("day"))
    t.append(spark.createDataFrame([(1, "a", 1, 1), (2, "a", 1, 1)], schema))
    t.merge(updates, ["id"], "at")
    once = values(t.scan())
    t.merge(updates, ["id"], "at")
    assert values(t.scan()) == once


@pytest.mark.parametrize("fields", [[], [PartitionField("day")], [PartitionField("id", "bucket", 4)]])
def test_frames_without_rows(spark, fields):
    """Every way of writing takes an empty frame, whether its plan is known to be empty or turns out so behind a shuffle."""
    schema = "id bigint, day string, at bigint"
    some = spark.createDataFrame([(1, "a", 1)], schema)
    behind = some.where("id > 5").join(some.select("id"), "id").groupBy("id", "day").agg(F.max("at").alias("at"))
    for none in (some.where("id > 5"), spark.createDataFrame([], schema), behind):
        t = table(spark, *fields)
        assert t.append(none).n_rows == 0 and values(t.scan()) == []
        t.append(some)
        assert t.append(none).n_rows == 0 and t.merge(none, ["id"], "at").n_rows == 0
        if fields:
            assert t.overwrite_partitions(none).n_rows == 0
        assert values(t.scan()) == [(1, "a", 1)]
        assert t.overwrite(none).n_rows == 0 and values(t.scan()) == []
        fresh = table(spark, *fields)
        assert fresh.merge(none, ["id"], "at").n_rows == 0
        assert fresh.merge(some, ["id"], "at").n_rows == 1 and values(fresh.scan()) == [(1, "a", 1)]


@pytest.mark.parametrize("fields", [[], [PartitionField("day")]])
def test_a_merge_that_dies_after_deleting_is_finished_by_the_next(spark, fields, monkeypatch):
    schema = "id bigint, day string, v bigint, at bigint"
    t = table(spark, *fields)
    t.append(spark.createDataFrame([(1, "a", 1, 1), (2, "a", 1, 1), (3, "b", 1, 1)], schema))
    updates = spark.createDataFrame([(1, "c", 2, 2), (3, "b", 2, 2)], schema)
    carry_out = Dataset._carry_out

    def broken(self, plan):
        if fields:
            spark.createDataFrame([], schema).drop("day").write.mode("overwrite").parquet(f"{self.path}/_p_day_identity=a")
        else:
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(self.path)
        raise RuntimeError("lost the driver")

    monkeypatch.setattr(Dataset, "_carry_out", broken)
    with pytest.raises(RuntimeError):
        t.merge(updates, ["id"], "at")
    monkeypatch.setattr(Dataset, "_carry_out", carry_out)
    again = Dataset(spark, t.path, fields)
    again.merge(updates, ["id"], "at")
    want = [(1, "c", 2, 2), (2, "a", 1, 1), (3, "b", 2, 2)]
    assert values(again.scan()) == want and not again.recover()


def test_a_layout_by_key_is_not_searched(spark):
    """The key names the partition, so nothing but the update's partitions is read."""
    schema = "id bigint, v bigint, at bigint"
    t = table(spark, PartitionField("id", "truncate", 10))
    t.append(spark.createDataFrame([(i, 1, 1) for i in range(100)], schema))
    written = []
    write = t._write
    t._write = lambda df, *a: written.append(df) or write(df, *a)
    assert t.merge(spark.createDataFrame([(25, 2, 2), (27, 2, 0), (120, 1, 1)], schema), ["id"], "at").n_rows == 11
    assert {r.id for r in written[0].collect()} == {*range(20, 30), 120}
    assert {r.id: r.v for r in t.scan().collect()} == {**{i: 1 for i in range(100)}, 25: 2, 120: 1}


def test_an_update_wins_a_tie(spark):
    old = spark.createDataFrame([(1, "old", 5)], "id bigint, v string, at bigint")
    new = spark.createDataFrame([(1, "new", 5), (2, "x", 1)], "id bigint, v string, at bigint")
    assert values(upsert(old, new, ["id"], "at")) == [(1, "new", 5), (2, "x", 1)]


def test_schema_grows_but_never_narrows(spark):
    t = table(spark)
    t.append(spark.createDataFrame([(1,)], "id int"))
    t.append(spark.createDataFrame([(2**40, "x")], "id bigint, name string"))
    assert values(t.scan().na.fill("-")) == [(1, "-"), (2**40, "x")]
    t.append(spark.createDataFrame([(7,)], "id int"))  # narrower input is widened
    assert t.scan().schema["id"].dataType == LongType()
    with pytest.raises(TypeError):
        t.append(spark.createDataFrame([("text",)], "id string"))


def test_widening_rules():
    assert wider(IntegerType(), LongType()) == LongType() == wider(LongType(), IntegerType())
    assert wider(DecimalType(10, 2), DecimalType(12, 2)) == DecimalType(12, 2)
    for old, new in [(DecimalType(10, 2), DecimalType(10, 3)), (StringType(), LongType())]:
        with pytest.raises(TypeError):
            wider(old, new)
    old, new = StructType.fromDDL("a int, b string"), StructType.fromDDL("c int, a bigint")
    assert merged_schema(old, new) == StructType.fromDDL("a bigint, b string, c int")


def test_hourly_partitions_prune(spark):
    t = table(spark, PartitionField("ts", "hour"))
    df = spark.range(48).selectExpr("id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, cast(id as int)) AS ts")
    t.append(df)
    day = t.scan(partition_key="2024-01-02")
    assert sorted(r.id for r in day.collect()) == list(range(24, 48))
    hour = t.scan(partition_key="2024-01-01-05")
    assert [r.id for r in hour.collect()] == [5]
    text = hour._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_p_ts_hour" in text
    assert t.partitions().count() == 48


FILTERS = [
    "ts >= timestamp_ntz'2024-01-02 05:30:00'", "ts < timestamp_ntz'2024-01-02 05:30:00' and n = 7", "ts = timestamp_ntz'2024-01-01 09:00:00'",
    "n >= 12 and n <= 31", "n > -5", "n < 0", "n = -3", "s >= 'ab' and s < 'b'", "s = ''", "s <= 'a'", "s = 'abc'", "d > date'2024-01-01'", "ts > '2024-01-02'",
]
LAYOUTS = [
    [PartitionField("ts", "hour")], [PartitionField("ts", "month"), PartitionField("n", "bucket", 5)], [PartitionField("n", "truncate", 10)],
    [PartitionField("s", "truncate", 2)], [PartitionField("s")], [PartitionField("n")], [PartitionField("d", "day"), PartitionField("d", "year")],
]


def test_folders_of_a_row_filter_lose_no_row(spark):
    df = spark.range(60).selectExpr(
        "id", "if(id % 13 = 0, null, timestamp_ntz'2024-01-01' + make_dt_interval(0, cast(id as int), 30 * cast(id % 2 as int))) AS ts",
        "if(id % 11 = 0, null, id - 20) AS n", "element_at(array('', 'a', 'ab', 'abc', 'b', null, 'null', 'z'), cast(1 + id % 8 as int)) AS s",
        "date'2024-01-01' + cast(id % 4 as int) AS d",
    )
    for fields in LAYOUTS:
        t = table(spark, *fields)
        t.append(df)
        for wanted in FILTERS:
            assert sorted(r.id for r in t.scan(row_filter=wanted).collect()) == sorted(r.id for r in df.where(wanted).collect()), (fields, wanted)


def test_row_filters_prune_folders(spark):
    def text(t, wanted):
        return t.scan(row_filter=wanted)._jdf.queryExecution().executedPlan().toString()

    t = table(spark, PartitionField("ts", "day"), PartitionField("n", "bucket", 4))
    t.append(spark.range(48).selectExpr("id AS n", "timestamp_ntz'2024-01-01' + make_dt_interval(0, cast(id as int)) AS ts"))
    found = text(t, "ts >= timestamp_ntz'2024-01-02' and n = 5")
    assert "PartitionFilters: [isnotnull(_p_ts_day" in found and ">= 2024-01-02)" in found and "isnotnull(_p_n_bucket" in found
    # A filter of another shape is applied and prunes nothing.
    for wanted in ("n = 5 or n = 6", "not (n = 5)", "n = 5 and concat('a and n = 6', n) is not null", "n = 1 + 4"):
        assert "PartitionFilters: []" in text(t, wanted)
    assert layout.comparisons("a = 'x and b = 1' and c<=-3") == [("a", "=", "'x and b = 1'"), ("c", "<=", "-3")]


def test_partition_keys_of_reads():
    assert key_range("2024-02") == (datetime(2024, 2, 1), datetime(2024, 3, 1))
    assert key_range("2024-12") == (datetime(2024, 12, 1), datetime(2025, 1, 1))
    assert key_range("2024-02-29-23") == (datetime(2024, 2, 29, 23), datetime(2024, 3, 1))
    assert key_range("2024") == (datetime(2024, 1, 1), datetime(2025, 1, 1))
    with pytest.raises(ValueError):
        key_range("yesterday")


def test_names_and_layers(spark):
    assert table_name(["orders"]) == "default.orders"
    assert table_name(["gold", "mart", "revenue"]) == "gold.mart_revenue"
    assert layer_path({"gold": "/x/"}, "gold", "t") == "/x/t"
    with pytest.raises(KeyError, match="bronze, gold"):
        layer_path({"gold": "/x", "bronze": "/y"}, "silver", "t")
    df = spark.range(10).withColumn("d", F.lit("x"))
    assert load_input(df, {"columns": ["id"], "row_filter": "id > 3", "limit": 2}).count() == 2


def test_partition_fields_are_checked():
    for bad in [("ts", "minute"), ("ts", "bucket"), ("ts", "truncate", 0)]:
        with pytest.raises(ValueError):
            PartitionField(*bad)


def test_truncate_and_bucket(spark):
    fields = [PartitionField("n", "truncate", 10), PartitionField("s", "truncate", 2), PartitionField("n", "bucket", 4)]
    df = spark.createDataFrame([(-3, "abc"), (12, "z"), (None, None)], "n bigint, s string")
    got = with_partitions(df, fields).select(*[f.name for f in fields]).collect()
    assert [tuple(r)[:2] for r in got] == [("-10", "ab"), ("10", "z"), ("null", "null")]
    many = with_partitions(spark.range(4000).withColumnRenamed("id", "n"), fields[2:])
    sizes = [r["count"] for r in many.groupBy(fields[2].name).count().collect()]
    assert len(sizes) == 4 and min(sizes) > 800
