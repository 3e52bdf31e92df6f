from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import episodes as ep
from millrace.operators.ordered import SLICE
from millrace.plans import fixtures as fx

SCHEMA = (
    "id string, station string, event_timestamp timestamp, current_state string, "
    "current_task string, current_sub_task string, sensors map<string,string>"
)
T0 = datetime(2024, 1, 1, 10, 0, 0)
SMALL = "/root/testdata/sf0.001"


def log(spark, rows):
    """rows: (seconds, task, state) or (seconds, task, state, sensors, station, id)."""
    out = []
    for i, r in enumerate(rows):
        sec, task, state, sensors, station, rid = (*r, *(None, "MM_1", None)[len(r) - 3:])
        out.append((rid or f"{i:04d}", station, T0 + timedelta(seconds=sec), state, task, task, sensors))
    return spark.createDataFrame(out, SCHEMA)


def runs(df):
    return [(r.current_task, r.n_events, r.duration_s) for r in df.orderBy("start_ts").collect()]


def test_null_and_empty_task_are_one_episode(spark):
    df = ep.build_episodes(log(spark, [(0, None, "ready"), (1, "", "ready"), (2, None, "ready")]))
    assert runs(df) == [("", 3, 2.0)]


def test_single_row_is_dropped_but_separates(spark):
    rows = [(0, "a", "not ready"), (1, "a", "not ready"), (2, "b", "not ready"),
            (3, "a", "not ready"), (4, "a", "not ready")]
    assert runs(ep.build_episodes(log(spark, rows))) == [("a", 2, 1.0), ("a", 2, 1.0)]
    assert ep.all_episodes(log(spark, rows)).count() == 3


def test_long_episodes_cross_hours(spark):
    rows = [(s, "a", "not ready") for s in range(0, 3 * 3600 + 60, 300)]
    rows += [(s, "b", "not ready") for s in range(3 * 3600 + 100, 3 * 3600 + 300, 50)]
    assert [(t, n) for t, n, _ in runs(ep.build_episodes(log(spark, rows)))] == [("a", 37), ("b", 4)]


def test_equal_times_are_ordered_by_id(spark):
    rows = [(0, "a", "x", None, "MM_1", "1"), (5, "b", "x", None, "MM_1", "3"),
            (5, "a", "x", None, "MM_1", "2"), (6, "b", "x", None, "MM_1", "4")]
    assert [(t, n) for t, n, _ in runs(ep.build_episodes(log(spark, rows)))] == [("a", 2), ("b", 2)]


def test_sensor_delta(spark):
    start = {"same": "1", "num": "1", "gone": "7", "flip": "0"}
    end = {"same": "1", "num": "1.0", "new": "2", "flip": "1"}
    rows = [(0, "a", "x", start), (1, "a", "x", end)]
    got = ep.build_episodes(log(spark, rows)).first().sensors_changed
    assert {k: tuple(v) for k, v in got.items()} == {
        "flip": ("0", "1"), "gone": ("7", None), "new": (None, "2"),
    }


def test_null_sensor_equals_absent(spark):
    rows = [(0, "a", "x", {"k": None}), (1, "a", "x", {})]
    assert ep.build_episodes(log(spark, rows)).first().sensors_changed == {}


@pytest.fixture
def flat(spark):
    """Five episodes of 1 s and one of the given length, so MAD is 0."""
    def make(last):
        rows = [(f"e{i}", "not ready", "s", d) for i, d in enumerate([1.0] * 5 + [last])]
        return spark.createDataFrame(
            rows, "episode_id string, current_state string, current_sub_task string, duration_s double"
        )
    return make


@pytest.mark.parametrize("last,flagged", [(2.999, 0), (3.0, 1), (3.5, 1)])
def test_floor_is_inclusive_with_zero_mad(flat, last, flagged):
    out = ep.flag_anomalies(flat(last))
    assert out.where("is_anomaly").count() == flagged
    assert out.first().subtask_threshold_s == 1.0


def test_threshold_is_strict(spark):
    # median 10, MAD 2 -> threshold 16: exactly 16 is normal
    rows = [(f"e{i}", "not ready", "s", float(d)) for i, d in enumerate([6, 8, 10, 12, 16])]
    df = spark.createDataFrame(
        rows, "episode_id string, current_state string, current_sub_task string, duration_s double"
    )
    assert ep.flag_anomalies(df).where("is_anomaly").count() == 0


def test_ready_rows_have_no_statistics(spark, flat):
    df = flat(9.0).withColumn("current_state", F.lit("ready"))
    out = ep.flag_anomalies(df)
    assert out.where("subtask_median_s is not null or is_anomaly").count() == 0


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_result_does_not_depend_on_partitions(spark, parts):
    base = ep.all_episodes(fx.factory_events(spark, SMALL)).select("episode_id", "n_events")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    aqe = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    expected = sorted(map(tuple, base.collect()))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = ep.all_episodes(fx.factory_events(spark, SMALL)).select("episode_id", "n_events")
        assert sorted(map(tuple, got.collect())) == expected
        marks = ep.boundaries(fx.factory_events(spark, SMALL))
        assert marks.agg(F.sum("is_boundary")).first()[0] == len(expected)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", aqe)
    assert sum(n for _, n in expected) == 1000


def test_one_hot_station_is_split_over_slices(spark):
    """A station with all rows still ends up in several slices, and one chain is rebuilt."""
    rows = spark.range(20000).select(
        F.lpad(F.col("id").cast("string"), 8, "0").alias("id"), F.lit("MM_1").alias("station"),
        F.timestamp_micros(F.col("id") * 100000).alias("event_timestamp"),
        F.lit("not ready").alias("current_state"), F.lit("a").alias("current_task"),
        F.lit("b").alias("current_sub_task"), F.create_map(F.lit("k"), F.lit("1")).alias("sensors"),
    )
    from millrace.operators.ordered import range_slices

    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    try:
        spark.conf.set(coalesce, "false")
        sliced = range_slices(rows, ["station"], ["event_timestamp", "id"])
        sizes = [r["count"] for r in sliced.groupBy(SLICE).count().collect()]
    finally:
        spark.conf.set(coalesce, "true")
    assert len(sizes) == 8 and max(sizes) < 20000 * 0.3
    out = ep.all_episodes(rows).collect()
    assert [(r.n_events, r.duration_s) for r in out] == [(20000, 1999.9)]


def test_hot_instant_with_one_station(spark):
    """All rows at one time in one station: slices are cut by id."""
    rows = spark.range(5000).select(
        F.lpad(F.col("id").cast("string"), 8, "0").alias("id"), F.lit("MM_1").alias("station"),
        F.lit(T0).cast("timestamp").alias("event_timestamp"), F.lit("x").alias("current_state"),
        F.when(F.col("id") < 2500, "a").otherwise("b").alias("current_task"),
        F.lit("").alias("current_sub_task"), F.lit(None).cast("map<string,string>").alias("sensors"),
    )
    got = sorted((r.current_task, r.n_events) for r in ep.all_episodes(rows).collect())
    assert got == [("a", 2500), ("b", 2500)]


def exchanges_of_rows(df):
    """Exchanges below the first Python step of a plan: those that raw rows pass through."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[plan.index("MapInArrow"):].count("Exchange ") if "MapInArrow" in plan else None


def test_raw_rows_move_once(spark):
    log_rows = spark.read.parquet(f"{SMALL}/events.parquet")
    rows = fx.factory_events(spark, SMALL)
    spreading = rows._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    plan = ep._slice_runs(rows)._jdf.queryExecution().executedPlan().toString()
    assert log_rows.count() > 0 and plan.count("Exchange rangepartitioning") == 1 and plan.count("Exchange ") == 1 + spreading
    assert exchanges_of_rows(ep.build_episodes(rows)) == 1 + spreading
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("records", [1, 3, 10_000])
def test_runs_reach_over_arrow_batches(spark, records):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    rows = fx.factory_events(spark, SMALL)
    base = sorted(map(tuple, ep.build_episodes(rows).select("episode_id", "n_events", "end_ts").collect()))
    try:
        spark.conf.set(name, records)
        assert sorted(map(tuple, ep.build_episodes(rows).select("episode_id", "n_events", "end_ts").collect())) == base
        numbers = ep.boundaries(rows).groupBy("station").agg(F.sum("is_boundary").alias("a"), F.max("episode_no").alias("b"))
        assert numbers.where("a <> b").count() == 0
    finally:
        spark.conf.set(name, old)


def test_changes_are_compared_once(spark, capsys):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"a": "1.0", "b": "3"})], "s map<string,string>, e map<string,string>")
    out = df.select(ep.sensor_delta(F.col("s"), F.col("e")).alias("d"))
    assert {k: tuple(v) for k, v in out.first().d.items()} == {"b": ("2", "3")}
    out.explain(True)
    plan = capsys.readouterr().out.split("== Analyzed Logical Plan ==")[1].split("== Optimized Logical Plan ==")[0]
    assert plan.count("array_union(") == 1
