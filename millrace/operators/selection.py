"""Exact medians of many groups by histogram bisection.

A pass counts values per bucket, over all groups at once, and narrows every group to the bucket that holds its wanted
rank; the next pass splits that bucket. Counts merge before the shuffle and a group never has more than 2**BITS
buckets (single values in the last pass), so no task sorts or holds the values of a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import materialise

BITS = 20


def largest(counts: DataFrame, value: str) -> int:
    return counts.agg(F.max(value)).first()[0] or 0


def middle_values(counts: DataFrame, by: str, value: str, n: str, top: int | None = None) -> DataFrame:
    """(by, total, lower, upper): the two middle values of each group (the same one if its total is odd).

    counts: (by, value, n) with whole values of at least 0 and null-free groups; several rows may have one value.
    top: a bound on the values, if it is known. Counts are read once per pass, so they should be stored.
    """
    levels = max(1, -(-int(largest(counts, value) if top is None else top).bit_length() // BITS))
    totals = counts.groupBy(by).agg(F.sum(n).alias("total"))
    last = F.col("total") - 1
    sides = F.explode(F.array(*[
        F.struct(F.lit(s).alias("side"), r.alias("rank")) for s, r in (("lower", F.floor(last / 2)), ("upper", F.ceil(last / 2)))]))
    state = totals.select(by, "total", sides.alias("s")).select(by, "total", "s.side", "s.rank", F.lit(0).cast("long").alias("prefix"))
    for level in range(levels - 1, -1, -1):
        shift = BITS * level
        cells = counts.select(
            by, F.shiftright(value, shift).alias("bucket"), F.col(n).alias("_n")
        ).groupBy(by, "bucket").agg(F.sum("_n").alias("_n")) if level == levels - 1 else _inside(counts, state, by, value, n, shift)
        prefix = F.shiftright("bucket", BITS)
        inside = state.join(cells.withColumn("prefix", prefix), [by, "prefix"])
        below = Window.partitionBy(by, "side").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        reached = inside.withColumn("_up", F.sum("_n").over(below))
        here = reached.where((F.col("_up") > F.col("rank")) & (F.col("_up") - F.col("_n") <= F.col("rank")))
        state = here.select(by, "total", "side", (F.col("rank") - (F.col("_up") - F.col("_n"))).alias("rank"), F.col("bucket").alias("prefix"))
        state = materialise(state, "bisection") if level else state
    return state.groupBy(by, "total").agg(*[F.max(F.when(F.col("side") == s, F.col("prefix"))).alias(s) for s in ("lower", "upper")])


def _inside(counts: DataFrame, state: DataFrame, by: str, value: str, n: str, shift: int) -> DataFrame:
    """Counts per bucket of this width, of values in a bucket that the last pass chose."""
    wanted = state.select(by, "prefix").distinct()
    near = counts.withColumn("prefix", F.shiftright(value, shift + BITS)).join(wanted, [by, "prefix"], "left_semi")
    return near.groupBy(by, F.shiftright(value, shift).alias("bucket")).agg(F.sum(n).alias("_n"))
