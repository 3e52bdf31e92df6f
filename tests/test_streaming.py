import time

from pyspark.sql import functions as F

from millrace.operators import episodes as ep
from millrace.plans import fixtures as fx
from millrace.sources import silver as sv
from millrace.streaming import incremental as inc

SMALL = "/root/testdata/sf0.001"


def test_stream_of_lines_equals_batch(spark, tmp_path):
    lines = fx.bronze_lines(spark, SMALL)
    landing = str(tmp_path / "landing")
    lines.write.partitionBy("split").text(landing)
    out = str(tmp_path / "silver")
    inc.stream_silver(spark, landing, out, str(tmp_path / "ck"))
    rows = lambda df: sorted(map(str, df.select(*sv.SILVER_COLUMNS).collect()))
    want = rows(sv.dedup(sv.parse(lines)))
    assert rows(spark.read.parquet(out)) == want
    # a second run over the same files adds nothing
    inc.stream_silver(spark, landing, out, str(tmp_path / "ck"))
    assert spark.read.parquet(out).count() == len(want)


def test_copies_that_arrive_much_later_are_dropped(spark, tmp_path):
    lines = fx.bronze_lines(spark, SMALL)
    landing, out, ck = (str(tmp_path / n) for n in ("landing", "silver", "ck"))
    half = F.pmod(F.xxhash64("value"), F.lit(2)) == 0
    lines.where(half).write.partitionBy("split").text(landing)
    inc.stream_silver(spark, landing, out, ck)
    first = spark.read.parquet(out).count()
    time.sleep(0.05)
    lines.write.mode("append").partitionBy("split").text(landing)  # all lines, those of the first half again
    inc.stream_silver(spark, landing, out, ck)
    ids = [r.id for r in spark.read.parquet(out).select("id").collect()]
    assert 0 < first < len(ids) and len(ids) == len(set(ids)) == sv.dedup(sv.parse(lines)).count()


def test_ledger_is_merged_without_an_exchange_and_batches_run_again(spark, tmp_path):
    ledger = inc.IdLedger(spark, str(tmp_path / "ids"), 4)
    rows = spark.createDataFrame([(f"i{k}",) for k in range(40)], "id string")
    ledger.note(rows, 0)
    ledger.note(rows, 0)
    assert spark.table(ledger.name).count() == 40
    more = spark.createDataFrame([("i1",), ("new",)], "id string")
    assert [r.id for r in ledger.unseen(more, 1).collect()] == ["new"]
    assert ledger.unseen(rows, 0).count() == 40  # its own ids don't count against a batch that is run again
    plan = ledger.unseen(more, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "LeftAnti" in plan


def test_stream_of_rows_equals_batch_and_counts_late_rows(spark, tmp_path):
    rows = fx.factory_events(spark, SMALL).drop("event_id", "split").cache()
    landing, root, ck = (str(tmp_path / n) for n in ("in", "root", "ck"))
    schema = rows.schema
    days = F.dayofmonth("event_timestamp")
    for lo, hi in ((0, 8), (8, 16), (16, 40)):
        rows.where((days > lo) & (days <= hi)).write.mode("append").parquet(landing)
        time.sleep(0.05)
        stream = spark.readStream.schema(schema).parquet(landing)
        last = inc.stream_episodes(stream, root, ck, 86400)
    got = inc.closed_episodes(spark, root).unionByName(inc.flush_open(spark, root, last, rows))
    cols = ["episode_id", "n_events", "duration_s"]
    want = sorted(map(tuple, ep.build_episodes(rows).select(*cols).collect()))
    assert sorted(map(tuple, got.select(*cols).collect())) == want
    assert inc.late_rows(spark, root).count() == 0

    rows.where(days == 2).write.mode("append").parquet(landing)
    inc.stream_episodes(
        spark.readStream.schema(schema).parquet(landing), root, ck, 86400)
    assert inc.late_rows(spark, root).count() == rows.where(days == 2).count()
