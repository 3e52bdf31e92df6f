"""Joins of events with activity intervals."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import micros
from millrace.session import shuffle_partitions

SLICES_PER_PARTITION = 2
PAIRS_PER_BATCH = 1 << 16


def _cuts(events: DataFrame, n: int) -> list[int]:
    """n - 1 ascending event times that part the events about evenly; a time with many events comes several times."""
    shares = [k / n for k in range(1, n)]
    found = events.agg(F.percentile_approx("_at", shares, 1000 * n).alias("c")).first()["c"] if shares else None
    return sorted(found or [])


def _slice(at: Column, borders: list[int]) -> Column:
    """Number of borders below `at`."""
    if not borders:
        return F.lit(0)
    steps = F.array(*[F.lit(b).cast("long") for b in borders])
    return F.size(F.filter(steps, lambda b: b < at))


def _swept(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Events with the intervals around them, from rows sorted by (slice, part, time), intervals before events of a time.

    Open intervals are kept as arrays; those that ended before the batch's first event are let go.
    """
    at_slice, lo, hi, ids = None, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object)
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("_slice", "_part")])
        change = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        edges = [0, *change.tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            part = batch.slice(a, b - a)
            if not part.num_rows:
                continue
            here = (int(keys[0, a]), int(keys[1, a]))
            if here != at_slice:
                at_slice, lo, hi, ids = here, lo[:0], hi[:0], ids[:0]
            opens = part.column("_hi").is_valid().to_numpy(zero_copy_only=False)
            at = part.column("_at").to_numpy(zero_copy_only=False)
            fresh = part.filter(pa.array(opens))
            lo = np.concatenate([lo, at[opens]])
            hi = np.concatenate([hi, fresh.column("_hi").to_numpy(zero_copy_only=False).astype(np.int64)])
            ids = np.concatenate([ids, np.array(fresh.column("activityId").to_pylist(), dtype=object)])
            events = part.filter(pa.array(~opens))
            at = at[~opens]
            if not len(at):
                continue
            live = hi >= at[0]
            lo, hi, ids = lo[live], hi[live], ids[live]
            first, stop = np.searchsorted(at, lo, "left"), np.searchsorted(at, hi, "right")
            counts = np.maximum(stop - first, 0)
            done = np.concatenate([[0], np.cumsum(counts)])
            for start in range(0, int(done[-1]), PAIRS_PER_BATCH):
                pair = np.arange(start, min(int(done[-1]), start + PAIRS_PER_BATCH))
                owner = np.searchsorted(done, pair, "right") - 1
                rows = events.take(pa.array(first[owner] + pair - done[owner]))
                yield pa.RecordBatch.from_arrays(
                    [*[rows.column(c) for c in columns], pa.array(ids[owner], pa.string())], names=[*columns, "activityId"])


def activity_join(events: DataFrame, activities: DataFrame, slices: int | None = None) -> DataFrame:
    """Events with startTime <= event_timestamp <= endTime of an activity.

    Both sides are laid out by the same time slices, cut so that events are even: a crowded hour has many slices, and
    a single time with the events of several slices is dealt over as many parts. An activity goes to the slices it
    touches, not to every hour. Inside a slice a sweep in time order pairs each interval with a stretch of events.
    Events without a time, and activities without a start or an end, join nothing.
    """
    n = slices or SLICES_PER_PARTITION * shuffle_partitions(events.sparkSession)
    timed = events.withColumn("_at", micros("event_timestamp")).where("_at IS NOT NULL")
    cuts = Counter(_cuts(timed.select("_at"), n))
    borders = sorted(set(cuts) | {c - 1 for c in cuts if cuts[c] > 1})  # a crowded time is a slice of its own
    crowded = [(k, cuts[c]) for k, c in enumerate(borders) if cuts[c] > 1]
    parts = F.lit(1)
    for k, count in crowded:
        parts = F.when(F.col("_slice") == k, count).otherwise(parts)
    columns = events.columns
    left = timed.withColumn("_slice", _slice(F.col("_at"), borders)).withColumn(
        "_part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), parts).cast("int")
    ).withColumns({"_hi": F.lit(None).cast("long"), "activityId": F.lit(None).cast("string")})
    spans = activities.select("activityId", micros("startTime").alias("_at"), micros("endTime").alias("_hi")).where("_at <= _hi")
    right = spans.withColumn(
        "_slice", F.explode(F.sequence(_slice(F.col("_at"), borders), _slice(F.col("_hi"), borders)))
    ).withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    both = left.unionByName(right, allowMissingColumns=True).repartition("_slice", "_part").sortWithinPartitions(
        "_slice", "_part", "_at", F.col("_hi").isNull())
    schema = T.StructType([*events.schema.fields, T.StructField("activityId", T.StringType())])
    return both.mapInArrow(lambda batches: _swept(batches, columns), schema)
