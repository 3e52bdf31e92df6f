"""Connected components of an edge table by alternating star contraction, and local helpers on arrays."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialise


def _least(edges: DataFrame) -> DataFrame:
    """Stored, so that the join with it reads plain exchanges, whose skewed partitions can be split."""
    return materialise(edges.groupBy("u").agg(F.min("v").alias("m")), "least")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): each id of `edges` (u, v; long) with the smallest id it is connected to.

    A round links every larger neighbour of a node to the least id around it, then every smaller one.
    Minima are aggregated before the shuffle and joined back one row per node, so a node with very many
    neighbours is a skewed join that adaptive execution splits, not a group. Rounds are stored in the
    shared folder; only two sums per round reach the driver.
    """
    now = materialise(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        mins = _least(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(mins, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "large_star")
        small = large.join(_least(large), "u")
        new = (
            small.select("u", F.col("m").alias("v"))
            .unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        )
        now = materialise(new, "small_star")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    out = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return out.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest position that each of n positions is connected to by the pairs (i, j)."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == root).all():
            break
        root = new
    return root


def runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The rows of each key, whole, from batches that are sorted by integer `keys`."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None

    def whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return parts[0] if len(parts) == 1 else pa.concat_batches(parts)

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        head = tuple(c[0] for c in columns)
        if held and head != last:
            yield whole(held)
            held = []
        starts = np.concatenate([[0], np.flatnonzero(change), [batch.num_rows]]).tolist()
        for a, b in zip(starts[:-1], starts[1:]):
            part = batch.slice(a, b - a)
            if b < batch.num_rows:
                yield whole([*held, part])
                held = []
            else:
                held.append(part)
        last = tuple(c[-1] for c in columns)
    if held:
        yield whole(held)


def of_two_blocks(group: pa.RecordBatch) -> bool:
    """Whether only pairs across blocks belong to this run of `in_blocks` rows; pairs within a block have their own."""
    return group.column("_b1")[0] != group.column("_b2")[0]


def in_blocks(df: DataFrame, keys: Sequence[str], member: str, blocks: str) -> DataFrame:
    """Rows of large groups dealt over pairs of blocks (_b1 <= _b2), so that any two rows of a group meet once.

    blocks: column with the number of blocks of the row's group. A row has the block `_b`; two rows of the
    same block meet in (_b, _b), others in the pair of their blocks. A group of one block stays as it is.
    """
    placed = df.withColumn("_b", F.pmod(F.xxhash64(member), F.col(blocks)).cast("int"))
    spread = placed.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)))
    paired = spread.withColumns({"_b1": F.least("_b", "_o"), "_b2": F.greatest("_b", "_o")}).drop("_o", blocks)
    return paired.repartition(*keys, "_b1", "_b2").sortWithinPartitions(*keys, "_b1", "_b2", member)
