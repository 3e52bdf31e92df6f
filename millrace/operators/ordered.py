"""Order-dependent building blocks that never put one whole key into one task.

A station, a run or a metric may hold a third of all rows, so `Window.partitionBy(key)` over raw
rows is avoided. Rows are laid out by sampled range on (key, order) instead. Each slice then holds
about the same number of rows whatever the key distribution, and only one summary row per
(slice, key) has to be combined across slices.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import materialise, shuffle_partitions

SLICE = "_slice"


def digest_prefix(df: DataFrame) -> int:
    """Characters of an md5 sort key used as slice number: at least 64 even slices per shuffle partition."""
    return max(2, math.ceil(math.log(64 * shuffle_partitions(df.sparkSession), 16)))


def range_slices(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Balanced contiguous slices of the (by, order) sequence, numbered in that order.

    Cut points are sampled per evaluation. Use the result in one straight pipeline, or
    materialise it before it is read twice.
    """
    return df.repartitionByRange(*by, *order).withColumn(SLICE, F.spark_partition_id())


def _totals_before(totals: DataFrame, by: Sequence[str], slice_col: str, total: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("_before", F.coalesce(F.sum(total).over(w), F.lit(0))).drop(total)


def running_total(
    df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str
) -> DataFrame:
    """Inclusive running sum of `value` in `order` within `by`; `order` must be unique in `by`."""
    laid = materialise(range_slices(df, by, order), "slices")
    totals = laid.groupBy(*by, SLICE).agg(F.sum(value).alias("_total"))
    before = _totals_before(totals, by, SLICE, "_total")
    inside = Window.partitionBy(SLICE, *by).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        laid.join(before, [*by, SLICE])
        .withColumn(name, F.col("_before") + F.sum(value).over(inside))
        .drop("_before", SLICE)
    )


def row_numbers(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """row_number() in `order` within `by`, without a task per key."""
    return running_total(df.withColumn("_one", F.lit(1)), by, order, "_one", name).drop("_one")


def hash_row_numbers(
    df: DataFrame, by: Sequence[str], digest: str, tie: str, name: str
) -> DataFrame:
    """row_number() in the order of an md5 column.

    A digest is uniform by construction, so its first characters are even slices that need no
    sampling: two evaluations of the plan always agree and nothing has to be written.
    """
    cut = df.withColumn(SLICE, F.substring(digest, 1, digest_prefix(df)))
    totals = cut.groupBy(*by, SLICE).agg(F.count(F.lit(1)).alias("_total"))
    before = _totals_before(totals, by, SLICE, "_total")
    inside = Window.partitionBy(*by, SLICE).orderBy(digest, tie)
    return (
        cut.join(before, [*by, SLICE])
        .withColumn(name, F.col("_before") + F.row_number().over(inside))
        .drop("_before", SLICE)
    )


def group_sizes(df: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def evenly_spaced(
    df: DataFrame, by: Sequence[str], order: Sequence[str], quota: str
) -> DataFrame:
    """Rows at positions round(linspace(0, n-1, quota)) of the ordering, per `by` group.

    `quota` is a column constant within the group. numpy rounds halves to even, hence bround.
    """
    numbered = row_numbers(df, by, order, "_rn")
    sizes = (
        numbered.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.max(quota).alias("_q"))
        .withColumn("_i", F.explode(F.expr("sequence(0, cast(least(_q, _n) as int) - 1)")))
        .where("least(_q, _n) > 0")
        .select(
            *by,
            F.expr(
                "cast(bround(cast(if(least(_q, _n) = 1, 0, _i * (_n - 1) / (least(_q, _n) - 1))"
                " as decimal(20,6)), 0) as bigint) + 1"
            ).alias("_rn"),
        )
        .distinct()
    )
    return numbered.join(sizes, [*by, "_rn"], "left_semi").drop("_rn")
