"""Silver rows to episodes: run-length encoding, sensor deltas, anomaly flags, narratives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import num1
from millrace.operators.ordered import SLICE
from millrace.operators.selection import largest, middle_values
from millrace.session import materialise

KEYS = ("current_state", "current_task", "current_sub_task")
NOT_READY = "not ready"

# Anomaly rule.
MAD_FACTOR = 3.0
MIN_EXCESS_MS = 2000
MIN_EVENTS = 2


def _keyed(silver: DataFrame) -> DataFrame:
    return silver.select(
        "station", "event_timestamp", "id",
        F.coalesce("current_state", F.lit("")).alias("current_state"),
        F.coalesce("current_task", F.lit("")).alias("current_task"),
        F.coalesce("current_sub_task", F.lit("")).alias("current_sub_task"),
        *(["sensors"] if "sensors" in silver.columns else []),
    )


def _laid(silver: DataFrame) -> DataFrame:
    """Rows in order of (station, time, id), the one exchange of raw rows: range partitions of about equal size, whatever
    the stations, so that a station or an instant with a third of all rows has many."""
    order = ["station", "event_timestamp", "id"]
    return _keyed(silver).repartitionByRange(*order).sortWithinPartitions(*order)


def _openings(batch: pa.RecordBatch, last: pa.RecordBatch | None) -> tuple[np.ndarray, np.ndarray]:
    """Where (station, keys) and where the station differ from the row before; `last` is the batch's predecessor row."""
    key = np.zeros(batch.num_rows, bool)
    station = np.zeros(batch.num_rows, bool)
    for name in ("station", *KEYS):
        column = batch.column(name)
        before = pa.concat_arrays([last.column(name) if last is not None else column[:1], column[:-1]])
        same = pc.coalesce(pc.equal(column, before), pc.and_(column.is_null(), before.is_null()))
        differs = ~same.to_numpy(zero_copy_only=False).astype(bool)
        key |= differs
        if name == "station":
            station = differs
    if last is None:
        key[0] = station[0] = True
    return key, station


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the running number of openings in this partition and station; the partition's first row counts as none."""
    last, number = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        opens, fresh = _openings(batch, last)
        steps = np.where(fresh, 0, opens).astype(np.int64)
        total = number + np.cumsum(steps)
        at = np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), -1))
        numbers = np.where(at < 0, total, total - total[np.maximum(at, 0)])
        number = int(numbers[-1])
        last = batch.slice(batch.num_rows - 1)
        columns = [*batch.columns, pa.array(fresh), pa.array(steps), pa.array(numbers)]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "_head", "_steps", "_number"])


def boundaries(silver: DataFrame) -> DataFrame:
    """Per row: does it open an episode, and the running episode number of its station.

    Raw rows move once. A stretch of rows (the rows of a station in one partition) is summed up by its outer keys and
    the number of openings inside; only summaries are chained, and joined back to the stored stretches.
    """
    laid = _laid(silver).drop("sensors").withColumn(SLICE, F.spark_partition_id())
    schema = T.StructType([*laid.schema.fields, *[
        T.StructField(n, t) for n, t in (("_head", T.BooleanType()), ("_steps", T.LongType()), ("_number", T.LongType()))]])
    rows = materialise(laid.mapInArrow(_marked, schema), "boundaries")
    key, at = F.struct(*KEYS), F.struct("event_timestamp", "id")
    summary = rows.groupBy(SLICE, "station").agg(
        F.max("_number").alias("_opened"), F.min_by(key, at).alias("_first"), F.max_by(key, at).alias("_tail"))
    per_station = Window.partitionBy("station").orderBy(SLICE)
    carried = F.lag("_tail").over(per_station)
    summary = summary.withColumn("_opens", (carried.isNull() | (carried != F.col("_first"))).cast("int"))
    so_far = F.sum(F.col("_opened") + F.col("_opens")).over(per_station.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summary = summary.withColumn("_before", so_far - F.col("_opened")).select(
        F.col(SLICE).alias("_s"), F.col("station").alias("_st"), "_opens", "_before")
    joined = rows.join(summary, (F.col(SLICE) == F.col("_s")) & F.col("station").eqNullSafe(F.col("_st")))
    return joined.select(
        "id", "station", "event_timestamp",
        F.when(F.col("_head"), F.col("_opens")).otherwise(F.col("_steps")).cast("int").alias("is_boundary"),
        (F.col("_before") + F.col("_number")).alias("episode_no"),
    )


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal keys in sorted rows; a run that reaches over batches is held until it ends."""
    last = held = None

    def runs(batch: pa.RecordBatch, first: np.ndarray, stop: np.ndarray) -> pa.Table:
        head, tail = batch.take(pa.array(first)), batch.take(pa.array(stop - 1))
        return pa.table({
            **{c: head.column(c) for c in ("station", *KEYS)},
            "from_ts": head.column("event_timestamp"), "from_id": head.column("id"), "to_ts": tail.column("event_timestamp"), "to_id": tail.column("id"),
            "n": pa.array((stop - first).astype(np.int64)), "sensors_from": head.column("sensors"), "sensors_to": tail.column("sensors"),
            "at_head": pa.array(np.zeros(len(first), bool)), "at_tail": pa.array(np.zeros(len(first), bool))})

    def changed(table: pa.Table, **columns) -> pa.Table:
        for name, value in columns.items():
            table = table.set_column(table.schema.get_field_index(name), name, value)
        return table

    def joined(a: pa.Table, b: pa.Table) -> pa.Table:
        return changed(a, to_ts=b.column("to_ts"), to_id=b.column("to_id"), sensors_to=b.column("sensors_to"), n=pc.add(a.column("n"), b.column("n")))

    head = True
    for batch in batches:
        if not batch.num_rows:
            continue
        opens, _ = _openings(batch, last)
        last = batch.slice(batch.num_rows - 1)
        first = np.unique(np.concatenate([[0], np.flatnonzero(opens)]))
        table = runs(batch, first, np.append(first[1:], batch.num_rows))
        if held is not None and not opens[0]:
            table = pa.concat_tables([joined(held, table[:1]), table[1:]])
        elif held is not None:
            table = pa.concat_tables([held, table])
        if head:
            table = changed(table, at_head=pa.array([True] + [False] * (table.num_rows - 1)))
            head = False
        held = table[-1:] if table.num_rows else None
        yield from table[:-1].combine_chunks().to_batches()
    if held is not None:
        yield from changed(held, at_tail=pa.array([True])).combine_chunks().to_batches()


def _slice_runs(silver: DataFrame) -> DataFrame:
    """Runs of equal keys inside each partition, with flags for its first and its last run.

    Raw rows move once and are read in order; a run becomes one row with its outer times, ids and sensors.
    """
    laid = _laid(silver)
    kind = laid.schema["sensors"].dataType.simpleString()
    time = "timestamp"
    schema = (
        "station string, " + ", ".join(f"{k} string" for k in KEYS) + f", from_ts {time}, from_id string, to_ts {time}, to_id string, "
        f"n long, sensors_from {kind}, sensors_to {kind}, at_head boolean, at_tail boolean"
    )
    place = lambda side: F.struct(F.col(f"{side}_ts").alias("event_timestamp"), F.col(f"{side}_id").alias("id"))
    return laid.mapInArrow(_run_rows, schema).select(
        "station", *KEYS, place("from").alias("_from"), place("to").alias("_to"), F.col("n").alias("_n"),
        F.col("sensors_from").alias("_sensors_from"), F.col("sensors_to").alias("_sensors_to"),
        F.col("at_head").alias("_at_head"), F.col("at_tail").alias("_at_tail"),
    )


def all_episodes(silver: DataFrame) -> DataFrame:
    """Every run of equal (state, task, sub-task) of a station, single rows included.

    Runs inside a partition are final. Its first and its last run are chained to their neighbours per station, so
    the chaining window grows with the number of partitions and not with the data.
    """
    runs = _slice_runs(silver)
    edge = F.col("_at_head") | F.col("_at_tail")
    # Edge runs of a station share one window group; every other run is a group of its own.
    runs = runs.withColumn("_group", F.when(~edge, F.col("_from")))
    w = Window.partitionBy("station", "_group").orderBy("_from")
    key = F.struct(*KEYS)
    before = F.lag(F.struct(key.alias("key"), F.col("_at_tail").alias("tail"))).over(w)
    runs = runs.withColumn("_before", before).withColumn(
        "_opens",
        F.when(
            F.col("_before.tail") & F.col("_at_head") & (F.col("_before.key") == key), F.lit(0)
        ).otherwise(F.lit(1)),
    ).withColumn("_chain", F.sum("_opens").over(w))
    merged = runs.groupBy("station", "_group", "_chain", *KEYS).agg(
        F.min("_from").alias("_from"),
        F.max("_to").alias("_to"),
        F.sum("_n").alias("n_events"),
        F.min_by("_sensors_from", "_from").alias("sensors_start"),
        F.max_by("_sensors_to", "_to").alias("sensors_end"),
    )
    span = F.unix_micros("end_ts") - F.unix_micros("start_ts")
    return (
        merged.withColumn("start_ts", F.col("_from.event_timestamp"))
        .withColumn("end_ts", F.col("_to.event_timestamp"))
        .withColumn("duration_ms", F.floor((span + 500) / 1000))
        .select(
            F.concat("station", F.lit("__"), F.date_format("start_ts", "yyyyMMddHHmmssSSSSSS"))
            .alias("episode_id"),
            "station", *KEYS, "start_ts", "end_ts",
            (F.col("duration_ms") / 1000.0).cast("double").alias("duration_s"),
            F.col("n_events").cast("int").alias("n_events"),
            "sensors_start", "sensors_end",
            sensor_delta(F.col("sensors_start"), F.col("sensors_end")).alias("sensors_changed"),
        )
    )


def min_events(episodes: DataFrame, n: int = MIN_EVENTS) -> DataFrame:
    return episodes.where(F.col("n_events") >= n)


def dropped_counts(episodes: DataFrame, n: int = MIN_EVENTS) -> DataFrame:
    keep = F.col("n_events") >= n
    return episodes.agg(
        F.count_if(keep).alias("kept"), F.count_if(~keep).alias("dropped")
    )


def build_episodes(silver: DataFrame) -> DataFrame:
    return min_events(all_episodes(silver))


def _same_value(a: Column, b: Column) -> Column:
    """Equal as text or as numbers; a missing key equals a null value."""
    return a.eqNullSafe(b) | F.coalesce(
        a.try_cast("double") == b.try_cast("double"), F.lit(False)
    )


def sensor_delta(start: Column, end: Column) -> Column:
    """Keys whose value differs between the first and the last row, with both values."""
    start = F.coalesce(start, F.create_map().cast("map<string,string>"))
    end = F.coalesce(end, F.create_map().cast("map<string,string>"))
    keys = F.array_sort(F.array_union(F.map_keys(start), F.map_keys(end)))
    changed = F.filter(
        keys, lambda k: ~_same_value(F.try_element_at(start, k), F.try_element_at(end, k))
    )
    # Entries, so that the comparison is made once and not for keys and values.
    return F.map_from_entries(F.transform(changed, lambda k: F.struct(k.alias("key"), F.struct(
        F.try_element_at(start, k).alias("start"), F.try_element_at(end, k).alias("end")
    ).alias("value"))))


def _milliseconds(duration: Column) -> Column:
    return F.round(duration * 1000).cast("bigint")


def subtask_stats(episodes: DataFrame) -> DataFrame:
    """Exact median, MAD and threshold per sub-task over not-ready episodes.

    Durations are folded to one row per (sub-task, millisecond), and the middle values found by histogram bisection,
    so no task holds the durations of a sub-task. Whole milliseconds, and halves counted twice, keep median and MAD
    exact.
    """
    ms = episodes.where(F.col("current_state") == NOT_READY).select(
        "current_sub_task", _milliseconds(F.col("duration_s")).alias("_ms")
    ).groupBy("current_sub_task", "_ms").agg(F.count(F.lit(1)).alias("_n"))
    ms = materialise(ms, "durations")
    top = largest(ms, "_ms")
    middle = middle_values(ms, "current_sub_task", "_ms", "_n", top)
    twice = F.col("lower") + F.col("upper")
    spread = ms.join(middle.select("current_sub_task", twice.alias("_twice")), "current_sub_task").select(
        "current_sub_task", F.abs(2 * F.col("_ms") - F.col("_twice")).alias("_dev"), "_n")
    off = middle_values(spread, "current_sub_task", "_dev", "_n", 2 * top).select("current_sub_task", (twice / 4.0).alias("mad_ms"))
    medians = middle.select("current_sub_task", (twice / 2.0).alias("median_ms"), F.col("total").alias("n_episodes"))
    return medians.join(off, "current_sub_task").withColumn("threshold_ms", F.col("median_ms") + MAD_FACTOR * F.col("mad_ms"))


def _seconds(ms: str) -> Column:
    return (F.floor(F.col(ms) + 0.5) / 1000.0).cast("double")


def attach_stats(episodes: DataFrame, stats: DataFrame) -> DataFrame:
    """Left join of the sub-task statistics; ready episodes get nulls.

    The statistics are stored first, so the planner knows their size: a table as small as sub-tasks are is broadcast
    and episodes stay where they are. Ready rows carry a key of their own (their id), so that they do not meet in one null group
    if the statistics table is too large for a broadcast.
    """
    keyed = episodes.withColumn(
        "_key",
        F.when(F.col("current_state") == NOT_READY, F.concat(F.lit("s:"), "current_sub_task"))
        .otherwise(F.concat(F.lit("e:"), "episode_id")),
    )
    small = materialise(stats.select(
        F.concat(F.lit("s:"), "current_sub_task").alias("_key"), "median_ms", "threshold_ms"
    ), "subtask_stats")
    return keyed.join(small, "_key", "left").drop("_key")


def flag_anomalies(episodes: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Duration above median + 3 MAD and at least two seconds above the median."""
    joined = attach_stats(episodes, subtask_stats(episodes) if stats is None else stats)
    ms = _milliseconds(F.col("duration_s"))
    flag = (ms > F.col("threshold_ms")) & (ms - F.col("median_ms") >= MIN_EXCESS_MS)
    return (
        joined.withColumn("is_anomaly", F.coalesce(flag, F.lit(False)))
        .withColumn("subtask_median_s", _seconds("median_ms"))
        .withColumn("subtask_threshold_s", _seconds("threshold_ms"))
        .drop("median_ms", "threshold_ms")
    )


def narrative() -> Column:
    """Fixed wording: the sentence that is embedded and shown for an episode."""
    task = F.coalesce(F.expr("nullif(current_task, '')"), F.lit("sem tarefa (ociosa)"))
    sub_task = F.coalesce(F.expr("nullif(current_sub_task, '')"), F.lit("-"))
    names = F.array_sort(F.map_keys("sensors_changed"))
    changed = F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise(F.lit("nenhum"))
    sensors = F.concat(F.lit("Sensores que mudaram durante o episódio: "), changed, F.lit("."))
    duration = F.col("duration_s")
    median = F.coalesce(F.col("subtask_median_s"), F.lit(0.0))
    excess = duration.cast("decimal(18,3)") - median.cast("decimal(18,3)")
    verdict = (
        F.when(
            F.col("is_anomaly"),
            F.concat(
                F.lit("Duração ANÔMALA: "), num1(excess),
                F.lit("s acima do normal para esta sub-tarefa (mediana "), num1(median),
                F.lit("s). "),
            ),
        )
        .when(
            F.col("subtask_median_s").isNotNull(),
            F.concat(
                F.lit("Duração dentro do normal (mediana da sub-tarefa: "), num1(median),
                F.lit("s). "),
            ),
        )
        .otherwise(F.lit(""))
    )
    busy = F.concat(
        F.lit("Estação "), "station", F.lit(" ficou not ready por "), num1(duration),
        F.lit("s executando '"), task, F.lit("', sub-tarefa '"), sub_task, F.lit("'. "),
        verdict, sensors,
    )
    idle = F.concat(
        F.lit("Estação "), "station", F.lit(" permaneceu "), "current_state",
        F.lit(" (ociosa) por "), num1(duration), F.lit("s. "), sensors,
    )
    return F.when(F.col("current_state") == NOT_READY, busy).otherwise(idle)


def gold_episodes(silver: DataFrame) -> DataFrame:
    """Episodes with flags and narrative.

    The unflagged episodes are written once: the statistics and the flags both read them, and the
    raw rows should be shuffled a single time.
    """
    episodes = materialise(build_episodes(silver), "episodes")
    return flag_anomalies(episodes).withColumn("text", narrative())


def episode_summary(episodes: DataFrame) -> DataFrame:
    not_ready = F.col("current_state") == NOT_READY
    return episodes.agg(
        F.count(F.lit(1)).alias("episodes"),
        F.count_if(not_ready).alias("not_ready"),
        F.count_if(F.col("current_state") == "ready").alias("ready"),
        F.count_if("is_anomaly").alias("anomalies"),
    )
