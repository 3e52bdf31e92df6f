"""Structured Streaming versions of ingestion and episode building.

Both jobs keep their state in tables next to the output instead of one state object per station:
a station may emit a third of all rows, and a keyed state would make that one task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import episodes as ep
from millrace.sources import silver as sv
from millrace.sources.results import read_log


LEDGER_BUCKETS = 32


class IdLedger:
    """Ids that were ever kept: a table bucketed and sorted by id, one sorted file per bucket and batch.

    A micro-batch is merged with it bucket by bucket, so only the batch is shuffled, and no streaming state grows with the log.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = LEDGER_BUCKETS):
        self.path, self.buckets, self.name = path, buckets, f"id_ledger_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (id STRING, batch BIGINT) USING parquet CLUSTERED BY (id) SORTED BY (id) "
            f"INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def unseen(self, rows: DataFrame, batch: int) -> DataFrame:
        """Rows whose id no earlier batch kept."""
        seen = rows.sparkSession.table(self.name).where(F.col("batch") < batch).select("id")
        return rows.repartition(self.buckets, "id").join(seen.hint("merge"), "id", "left_anti")

    def note(self, rows: DataFrame, batch: int) -> None:
        """A batch that is noted already (it was run again) is left alone."""
        if rows.sparkSession.table(self.name).where(F.col("batch") == batch).limit(1).count():
            return
        ids = rows.select("id", F.lit(batch).cast("long").alias("batch")).repartition(self.buckets, "id")
        ids.write.format("parquet").mode("append").bucketBy(self.buckets, "id").sortBy("id").option(
            "path", self.path).saveAsTable(self.name)


def stream_silver(spark: SparkSession, log_folder: str, out: str, checkpoint: str) -> None:
    """Parse new NDJSON files under <log_folder>/split=<name>/ and append first rows per id to <out>/batch=<n>.

    Within a micro-batch the first row by (split, time, line) stays, as in the batch job; an id that an earlier micro-batch
    kept is a duplicate, however old. The ledger beside `out` holds the ids. Outputs are keyed by the batch
    number, so a repeated batch gives the same result.
    """
    ledger = IdLedger(spark, f"{out.rstrip('/')}_ids")

    def keep(lines: DataFrame, batch: int) -> None:
        path = f"{out.rstrip('/')}/batch={batch}"
        fresh = ledger.unseen(sv.dedup(sv.parse(lines)), batch)
        fresh.select(*sv.SILVER_COLUMNS).write.mode("overwrite").parquet(path)
        ledger.note(lines.sparkSession.read.parquet(path), batch)

    lines = spark.readStream.schema("value string, split string").format("text").load(log_folder)
    query = lines.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()


_OPEN_ROWS = "rows"
_LATE_ROWS = "late"


def _batch_path(root: str, kind: str, batch: int) -> str:
    return f"{root}/{kind}/batch={batch:08d}"


def stream_episodes(
    silver_stream: DataFrame, root: str, checkpoint: str, delay_s: int = 3600
) -> int:
    """Close episodes as event time advances; see `episode_batch` for the rule per batch.

    Returns the number of the last finished batch, -1 if there was none.
    """
    query = (
        silver_stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(lambda df, batch: episode_batch(df, root, batch, delay_s))
        .start()
    )
    query.awaitTermination()
    last = query.lastProgress
    return -1 if last is None else int(last["batchId"])


def episode_batch(rows: DataFrame, root: str, batch: int, delay_s: int) -> None:
    """One micro-batch: pending rows of the previous batch plus new rows to closed episodes.

    A row is final once it is older than the newest event time minus `delay_s`. An episode closes
    when its station has a final row after it. Rows at or after the start of a station's open
    episode are written as the next pending table; rows older than everything already closed are
    counted as late. Every table is keyed by the batch number and overwritten, so a repeated
    batch gives the same result.
    """
    spark = rows.sparkSession
    cols = ["id", "station", "event_timestamp", "current_state", "current_task",
            "current_sub_task", "sensors"]
    fresh = rows.select(*cols)
    schema = fresh.schema.simpleString()[len("struct<"):-1]
    marks_schema = "station string, closed_until timestamp, newest timestamp"
    before = read_log_parquet(spark, _batch_path(root, _OPEN_ROWS, batch - 1), fresh)
    marks = read_log(spark, _batch_path(root, "marks", batch - 1), marks_schema)

    seen = fresh.join(marks.select("station", "closed_until"), "station", "left")
    late = F.col("event_timestamp") <= F.col("closed_until")
    seen.where(late).select(*cols).write.mode("overwrite").parquet(
        _batch_path(root, _LATE_ROWS, batch)
    )
    pool_path = _batch_path(root, "pool", batch)
    seen.where(F.coalesce(~late, F.lit(True))).select(*cols).unionByName(before).write.mode(
        "overwrite"
    ).parquet(pool_path)
    pool = spark.read.schema(fresh.schema).parquet(pool_path)

    newest = pool.agg(F.max("event_timestamp").alias("m")).unionByName(
        marks.agg(F.max("newest").alias("m"))
    ).agg(F.max("m").alias("newest"))
    final_until = newest.select(
        "newest", F.timestamp_add("SECOND", F.lit(-delay_s), "newest").alias("_final")
    )
    # One row, hence the broadcast.
    pending = pool.join(F.broadcast(final_until))
    runs_path = _batch_path(root, "runs", batch)
    ep.all_episodes(pending.where("event_timestamp <= _final").select(*cols)).write.mode(
        "overwrite"
    ).parquet(runs_path)
    runs = spark.read.parquet(runs_path)
    open_run = runs.groupBy("station").agg(F.max("start_ts").alias("_open"))
    closed = runs.join(open_run, "station").where("start_ts < _open").drop("_open")
    ep.min_events(closed).write.mode("overwrite").parquet(_batch_path(root, "episodes", batch))

    rest = pool.join(open_run, "station", "left").where(
        "_open is null or event_timestamp >= _open"
    ).select(*cols)
    rest.write.mode("overwrite").parquet(_batch_path(root, _OPEN_ROWS, batch))
    until = closed.groupBy("station").agg(F.max("end_ts").alias("_until"))
    (
        marks.select("station", "closed_until").unionByName(
            until.select("station", F.col("_until").alias("closed_until"))
        )
        .groupBy("station").agg(F.max("closed_until").alias("closed_until"))
        .join(F.broadcast(newest))
        .write.mode("overwrite").json(_batch_path(root, "marks", batch))
    )


def read_log_parquet(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return spark.createDataFrame([], like.schema)
    return spark.read.schema(like.schema).parquet(path)


def closed_episodes(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/episodes").drop("batch")


def flush_open(spark: SparkSession, root: str, last_batch: int, like: DataFrame) -> DataFrame:
    """Episodes of the rows that are still pending, for an end-of-log snapshot."""
    return ep.build_episodes(
        read_log_parquet(spark, _batch_path(root, _OPEN_ROWS, last_batch), like)
    )


def late_rows(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{_LATE_ROWS}").drop("batch")
