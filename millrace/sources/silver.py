"""NDJSON machine logs to typed rows: tolerant parse, rejects, first-row-per-id, exports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Keys with a column of their own; every other key is a sensor reading.
KNOWN_KEYS = (
    "id", "station", "timestamp", "current_state", "current_task", "current_task_duration",
    "current_sub_task",
)
# Splits in load order; the first row of an id wins in this order.
SPLITS = ("train", "test")

SILVER_COLUMNS = (
    "id", "station", "event_timestamp", "current_state", "current_task",
    "current_task_duration", "current_sub_task", "sensors", "split",
)
_BLANKS = " \t\r\n\x0b\x0c"


def read_logs(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """split -> path of text files; one line per row, tagged with its split."""
    return tagged_union({split: spark.read.text(path) for split, path in paths.items()})


def tagged_union(frames: Mapping[str, DataFrame]) -> DataFrame:
    tagged = [df.withColumn("split", F.lit(split)) for split, df in frames.items()]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df)
    return out


def classified(lines: DataFrame) -> DataFrame:
    """Every line with its Silver columns and the reason for a rejection (null when accepted)."""
    doc = F.from_json("_text", "map<string,string>")

    def columns(d: Column) -> Column:
        get = lambda key: F.try_element_at(d, F.lit(key))
        text = lambda key: F.coalesce(get(key), F.lit("")).alias(key)
        return F.struct(
            text("id"), text("station"),
            get("timestamp").try_cast("timestamp").alias("event_timestamp"),
            text("current_state"),
            get("current_task").alias("current_task"),
            get("current_task_duration").try_cast("double").alias("current_task_duration"),
            get("current_sub_task").alias("current_sub_task"),
            F.map_filter(d, lambda k, _: ~k.isin(*KNOWN_KEYS)).alias("sensors"),
            d.isNull().alias("_no_object"),
        )

    # The generator makes the parsed line a row of its own: a filter on it is not pushed below
    # the parser, which would read the document again for every column the filter names.
    rows = lines.withColumn("_text", F.btrim("value", F.lit(_BLANKS))).select(
        "split", F.col("value").alias("line"), "_text",
        F.inline(F.transform(F.array(doc), columns)),
    )
    reason = (
        F.when(F.col("_text") == "", "blank")
        .when(
            F.col("_no_object"),
            F.when(F.try_parse_json("_text").isNull(), "malformed").otherwise("not_object"),
        )
        .when(F.col("id") == "", "no_id")
        .when(F.col("event_timestamp").isNull(), "bad_timestamp")
    )
    return rows.withColumn("reason", reason).drop("_text", "_no_object")


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where("reason is null").drop("reason")


def rejected(rows: DataFrame) -> DataFrame:
    return rows.where("reason is not null").select("split", "line", "reason")


def parse(lines: DataFrame) -> DataFrame:
    """Silver columns plus the source line, accepted lines only."""
    return accepted(classified(lines))


def _split_rank() -> Column:
    return F.coalesce(
        F.nullif(F.array_position(F.array(*[F.lit(s) for s in SPLITS]), F.col("split")), F.lit(0)),
        F.lit(len(SPLITS) + 1),
    )


def dedup(rows: DataFrame) -> DataFrame:
    """First row per id in (split, time, line) order.

    min_by merges copies on the map side, so a group of copies of any size is one row per task
    before the shuffle.
    """
    first = F.struct(_split_rank(), "event_timestamp", "line")
    kept = rows.groupBy("id").agg(
        F.min_by(F.struct(*[c for c in SILVER_COLUMNS if c != "id"]), first).alias("_row")
    )
    return kept.select("id", "_row.*")


def ingest_counts(rows: DataFrame) -> DataFrame:
    """Attempted, kept and duplicate rows per split and in total (split null), in one pass."""
    per_id = rows.groupBy("id", "split").agg(F.count(F.lit(1)).alias("_n"))
    first = F.min(_split_rank()).over(Window.partitionBy("id"))
    counted = per_id.withColumn("_kept", (_split_rank() == first).cast("bigint"))
    return counted.rollup("split").agg(
        F.sum("_n").alias("attempted"),
        F.sum("_kept").alias("kept"),
        F.sum(F.col("_n") - F.col("_kept")).alias("duplicates"),
    )


def split_counts(silver: DataFrame) -> DataFrame:
    return silver.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def of_split(silver: DataFrame, split: str) -> DataFrame:
    return silver.where(F.col("split") == split).select(
        "id", "station", "event_timestamp", "current_state", "current_task", "current_sub_task",
        "sensors",
    )


def of_station(silver: DataFrame, station: str, state: str | None = None) -> DataFrame:
    out = silver.where(F.col("station") == station)
    return out if state is None else out.where(F.col("current_state") == state)


def sensor_text(key: str) -> Column:
    return F.try_element_at("sensors", F.lit(key))


def sensor_int(key: str) -> Column:
    return sensor_text(key).try_cast("int")


def top_longest(silver: DataFrame, n: int = 25) -> DataFrame:
    """The n longest not-ready rows (TakeOrderedAndProject: n rows per task reach the driver)."""
    return (
        silver.where(F.col("current_state") == "not ready")
        .orderBy(F.col("current_task_duration").desc_nulls_last(), "id")
        .limit(n)
    )


def export_silver(silver: DataFrame, path: str) -> None:
    """Parquet by split, files in event-time order, so that time filters skip row groups."""
    (
        silver.repartitionByRange("split", "event_timestamp", "id")
        .sortWithinPartitions("split", "event_timestamp", "id")
        .write.mode("overwrite").partitionBy("split").parquet(path)
    )


def rebuild_gold(episodes: DataFrame, path: str) -> None:
    """Replace the episode table; the first row per episode_id wins.

    Laid out by range of (station, start): a file holds one stretch of a station's time, and a large station has many.
    """
    rest = [c for c in episodes.columns if c != "episode_id"]
    first = episodes.groupBy("episode_id").agg(
        F.min_by(F.struct(*rest), F.struct("start_ts", "end_ts", "current_state", "current_task"))
        .alias("_row")
    ).select("episode_id", "_row.*")
    order = ["station", "start_ts", "episode_id"]
    laid = first.repartitionByRange(*order).sortWithinPartitions(*order)
    laid.write.mode("overwrite").partitionBy("station").parquet(path)
