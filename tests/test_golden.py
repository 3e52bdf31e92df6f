from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from millrace.operators import golden as gs
from millrace.plans import fixtures as fx

SMALL = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)


def frame(spark, items):
    rows = [(f"{s}_{i:03d}", s, T0 + timedelta(milliseconds=ms)) for i, (s, ms) in enumerate(items)]
    return spark.createDataFrame(rows, "episode_id string, station string, start_ts timestamp"), rows


def near(rows, station, at, w):
    return [r for r in rows if r[1] == station and abs((r[2] - at).total_seconds()) <= w]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(hs.lists(hs.tuples(hs.sampled_from("ABC"), hs.integers(0, 120).map(lambda x: x * 500)), min_size=2, max_size=25))
def test_windows_match_brute_force(spark, items):
    df, rows = frame(spark, items)
    w = 5.0
    alone = {r[0] for r in rows if len(near(rows, r[1], r[2], w)) == 1}
    assert {r.episode_id for r in gs.unique_in_window(df, w).collect()} == alone
    counts = {r.episode_id: r.n_near for r in gs.range_count(df, w).collect()}
    assert counts == {r[0]: len(near(rows, r[1], r[2], w)) for r in rows}
    want = {
        (a[0], b[0]) for a in rows for b in rows
        if a[1] != b[1] and 0 <= (b[2] - a[2]).total_seconds() <= w - 1
        and len(near(rows, a[1], a[2], w)) == 1 and len(near(rows, b[1], a[2], w)) == 1
    }
    assert {(r.a_id, r.b_id) for r in gs.cross_station_pairs(df, w).collect()} == want


def test_crowded_bucket_yields_no_pairs(spark):
    df, _ = frame(spark, [("A", i) for i in range(400)] + [("B", i) for i in range(400)])
    assert gs.cross_station_pairs(df, 5.0).count() == 0


def test_golden_set_is_consistent(spark):
    mined = fx.mined(spark, SMALL)
    golden = gs.golden_set(mined, fx.PAIR_WINDOW_S).cache()
    ids = [r.id for r in golden.orderBy("id").collect()]
    assert len(ids) == len(set(ids)) and ids[0] == "cau-01"
    evidence = gs.golden_evidence(golden, mined)
    assert evidence.join(mined, "episode_id", "left_anti").count() == 0
    assert evidence.select("id").distinct().count() == len(ids)
    used = golden.where("subtype <> 'impacto_bpm'").select(
        "tier", F.explode("evidence_episode_ids").alias("e"))
    assert used.groupBy("tier", "e").count().where("count > 1").count() == 0
