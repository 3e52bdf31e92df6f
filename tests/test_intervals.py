import random
from datetime import datetime, timedelta

import pytest

from millrace.operators.intervals import activity_join
from millrace.operators.selection import middle_values

T0 = datetime(2024, 1, 1)


def at(s):
    return None if s is None else T0 + timedelta(seconds=s)


def brute(events, spans):
    return sorted((i, a) for i, t in events for a, lo, hi in spans if None not in (t, lo, hi) and lo <= t <= hi)


@pytest.mark.parametrize("slices,records", [(1, 7), (5, 10_000), (23, 3)])
def test_sweep_equals_all_pairs(spark, slices, records):
    rng = random.Random(slices)
    events = [(i, rng.choice([500, rng.randint(0, 5000)])) for i in range(600)] + [(900, None)]
    spans = [(f"a{k}", lo := rng.randint(-100, 5100), lo + rng.choice([0, 3, 50, 9000, -5])) for k in range(60)] + [("n", None, 5), ("m", 5, None), ("p", 500, 500)]
    left = spark.createDataFrame([(i, at(t), {"k": str(i)}) for i, t in events], "id int, event_timestamp timestamp, sensors map<string,string>")
    right = spark.createDataFrame([(a, at(x), at(y)) for a, x, y in spans], "activityId string, startTime timestamp, endTime timestamp")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    try:
        spark.conf.set(name, records)
        got = activity_join(left, right, slices)
        assert got.columns == ["id", "event_timestamp", "sensors", "activityId"]
        rows = got.collect()
    finally:
        spark.conf.set(name, old)
    assert sorted((r.id, r.activityId) for r in rows) == brute(events, spans)
    assert all(r.sensors == {"k": str(r.id)} for r in rows)


def test_crowded_time_is_dealt_over_parts(spark):
    left = spark.createDataFrame([(i, at(77 if i % 10 else i)) for i in range(4000)], "id int, event_timestamp timestamp")
    right = spark.createDataFrame([("a", at(0), at(9000)), ("b", at(77), at(77))], "activityId string, startTime timestamp, endTime timestamp")
    got = activity_join(left, right, 40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sizes = [r["count"] for r in got.selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) >= 6 and max(sizes) < 7600 * 0.4
    assert got.where("activityId = 'b'").count() == 3600 and got.where("activityId = 'a'").count() == 4000
    assert activity_join(left.limit(0), right).count() == 0 and activity_join(left, right.limit(0)).count() == 0


def test_middle_values(spark):
    rng = random.Random(3)
    groups = {f"g{k}": [rng.choice([0, 1, 5000, rng.randint(0, 1 << rng.choice([3, 13, 40]))]) for _ in range(n)] for k, n in enumerate([1, 2, 3, 10, 401, 2000])}
    counts = spark.createDataFrame([(g, v, 1) for g, vs in groups.items() for v in vs], "g string, v long, n long")
    got = {r.g: (r.total, r.lower, r.upper) for r in middle_values(counts, "g", "v", "n").collect()}
    assert got == {g: (len(vs), sorted(vs)[(len(vs) - 1) // 2], sorted(vs)[len(vs) // 2]) for g, vs in groups.items()}
    assert middle_values(counts.limit(0), "g", "v", "n").count() == 0
