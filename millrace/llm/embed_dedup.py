"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

A hash function turns a vector three times (random signs, Hadamard transform) and takes its largest
coordinate with its sign. A table joins WIDTH of them, so that buckets stay small at any number of rows; a vector
also enters the buckets it missed most narrowly. The number of tables comes from a simulation of pairs right at the
threshold, until the expected recall reaches the target.

Buckets hold 256 sign bits per vector, not vectors: members whose bits differ far more than any linked pair's are
parted again. What stays connected is verified with the vectors, in double precision and in blocks of
bounded size; only counts and a spanning forest of the links leave a task.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialise
from millrace.llm.components import components, in_blocks, local_roots, of_two_blocks, runs

THRESHOLD = 0.9
TARGET_RECALL = 0.9999
#: Extra buckets per table, coordinates a probe may fall back to, sign bits of a sketch.
PROBES = 4
RANKS = 3
BITS = 256
DEVIATIONS = 6
BLOCK = 1024
SEED = 77


def finite(v: Column) -> Column:
    """Vectors that take part: not null or empty, all components finite."""
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows; their length is a power of two."""
    rows, n = x.shape
    step = 1
    while step < n:
        pairs = x.reshape(rows, n // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(rows, n)
        step *= 2
    return x / math.sqrt(n)


def _rotated(x: np.ndarray, table: int, function: int) -> np.ndarray:
    rng = np.random.default_rng((SEED, table, function, x.shape[1]))
    for _ in range(3):
        x = hadamard(x * rng.choice((-1.0, 1.0), x.shape[1]))
    return x


def padded(x: np.ndarray) -> np.ndarray:
    size = 1 << max(1, x.shape[1] - 1).bit_length()
    return np.pad(x, ((0, 0), (0, size - x.shape[1])))


def table_codes(x: np.ndarray, table: int, width: int, probes: int = PROBES) -> np.ndarray:
    """Codes of each row (padded, unit length) in one table: its own bucket, then the narrowest misses."""
    ranks = min(RANKS, x.shape[1])
    parts = []
    for f in range(width):
        y = _rotated(x, table, f)
        top = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :ranks]
        value = np.take_along_axis(y, top, 1)
        parts.append((top * 2 + (value > 0), np.abs(value)))
    gaps, codes = [], []
    for choice in itertools.product(range(ranks), repeat=width):
        gap, code = 0.0, 0
        for f, r in enumerate(choice):
            gap = gap + (parts[f][1][:, 0] - parts[f][1][:, r]) ** 2
            code = code * (2 * x.shape[1]) + parts[f][0][:, r].astype(np.int64)
        gaps.append(gap)
        codes.append(code)
    nearest = np.argsort(np.stack(gaps, 1), axis=1, kind="stable")[:, : probes + 1]
    return np.take_along_axis(np.stack(codes, 1), nearest, 1)


def plan(rows: int, size: int, threshold: float, target: float) -> tuple[int, int]:
    """(functions per table, tables): buckets of a few rows, and the expected recall of pairs at the threshold."""
    size = 1 << max(1, size - 1).bit_length()
    width = max(1, round(math.log(max(rows, 2)) / math.log(2 * size)))
    rng = np.random.default_rng(SEED)
    a = rng.normal(size=(2000, size))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b = threshold * a + math.sqrt(1 - threshold**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    ca, cb = table_codes(a, 0, width), table_codes(b, 0, width)
    meet = float(((ca[:, :, None] == cb[:, None, :]).any((1, 2))).mean())
    return width, math.ceil(math.log(1 - target) / math.log(max(1e-9, 1 - min(meet, 0.99))))


def _unit(vectors: list, size: int) -> np.ndarray:
    x = np.array(vectors, float).reshape(len(vectors), size)
    x /= np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _bucketed(width: int, tables: int):
    names = ["tree", "code", "c", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                some = batch.filter(pa.array(sizes == size))
                x = padded(_unit(some.column("embedding").to_pylist(), int(size)))
                signs = np.random.default_rng((SEED, x.shape[1])).normal(size=(x.shape[1], BITS))
                sketch = np.packbits(x @ signs > 0, axis=1)
                sketch = pa.array([s.tobytes() for s in sketch], pa.binary())
                for t in range(tables):
                    codes = table_codes(x, t, width)
                    for k in range(codes.shape[1]):
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(len(x), t * 4096 + int(size) % 4096)), pa.array(codes[:, k]),
                            some.column("c"), sketch,
                        ], names)

    return run


def _tied(most: int):
    """Star edges (u, v) of each bucket's members whose sign bits differ in at most `most` places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ("tree", "code", "_b1", "_b2")):
            n = group.num_rows
            if n < 2:
                continue
            s = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint64).reshape(n, -1)
            if n <= 128:
                far = np.bitwise_count(s[:, None] ^ s[None]).sum(2, dtype=np.int64)
                i, j = np.nonzero(np.triu(far <= most, 1))
                if not len(i):
                    continue
                root = local_roots(n, i, j)
            else:
                root = np.arange(n)
                for k in range(n - 1):
                    rest = np.flatnonzero(root[k + 1 :] != root[k]) + k + 1
                    hit = rest[np.bitwise_count(s[rest] ^ s[k]).sum(1, dtype=np.int64) <= most]
                    for r in np.unique(root[hit]):
                        root[root == max(r, root[k])] = min(r, root[k])
            tied = np.flatnonzero(root != np.arange(n))
            if len(tied):
                c = group.column("c").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(c[tied]), pa.array(c[root[tied]])], ["u", "v"])

    return run


def _verified(threshold: float):
    """(c, root, links) of a block pair: linked vectors, copies counted, and a star of the links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ("component", "_b1", "_b2")):
            if group.num_rows < 2:
                continue
            sizes = group.column("size").to_numpy()
            for size in np.unique(sizes):
                some = group.filter(pa.array(sizes == size))
                n = some.num_rows
                x = _unit(some.column("embedding").to_pylist(), int(size))
                block, c, copies = (some.column(k).to_numpy() for k in ("_b", "c", "n"))
                i, j = np.nonzero(np.triu(x @ x.T >= threshold, 1))
                if of_two_blocks(group):
                    once = block[i] != block[j]
                    i, j = i[once], j[once]
                if len(i):
                    links = np.bincount(i, copies[j], minlength=n) + np.bincount(j, copies[i], minlength=n)
                    root = local_roots(n, i, j)
                    hit = np.flatnonzero(links)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c[hit]), pa.array(c[root[hit]]), pa.array(links[hit].astype(np.int64))],
                        ["c", "root", "links"],
                    )

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of `vectors` (vec_id, embedding; others aren't read).

    Links: pairs found whose cosine is at least `threshold`, checked in double precision; none below. Equal
    vectors are one class that is compared once, and link with each other. Vectors that are null, empty or zero,
    or hold null or non-finite components, link with nothing and are their own component; so do vectors of
    different lengths among each other. Repeated rows are copies. A null vec_id never names a component with others in it.
    An empty table gives an empty one.
    """
    rows = vectors.select("vec_id", "embedding")
    able = finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)
    classes = materialise(
        rows.where(able).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
        .withColumn("size", F.size("embedding").cast("long")).withColumn("c", F.monotonically_increasing_id()),
        "vectors",
    )
    count, size = classes.agg(F.count(F.lit(1)), F.max("size")).first()
    width, tables = plan(count, size or 1, threshold, target)
    members = materialise(
        classes.select("c", "size", "embedding")
        .mapInArrow(_bucketed(width, tables), "tree long, code long, c long, sketch binary"),
        "buckets",
    )
    sizes = members.groupBy("tree", "code").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"), F.count(F.lit(1)).alias("m"))
    sizes = materialise(sizes.where("m > 1").drop("m"), "crowded")  # plain inputs let a hot bucket be split
    crowded = members.join(sizes, ["tree", "code"])
    differ = math.acos(threshold) / math.pi
    most = math.ceil(BITS * differ + DEVIATIONS * math.sqrt(BITS * differ * (1 - differ)))
    star = in_blocks(crowded, ["tree", "code"], "c", "blocks").mapInArrow(_tied(most), "u long, v long")
    near = components(star).withColumnRenamed("id", "c")
    heft = near.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    found = near.join(heft, "component").join(classes.select("c", "n", "size", "embedding"), "c")
    checked = materialise(
        in_blocks(found, ["component"], "c", "blocks").mapInArrow(_verified(threshold), "c long, root long, links long"),
        "links",
    )
    links = checked.groupBy("c").agg(F.sum("links").alias("links"))
    groups = components(checked.select(F.col("c").alias("u"), F.col("root").alias("v"))).withColumnRenamed("id", "c")
    named = classes.select("c", "rep", "n", "embedding").join(groups, "c", "left").withColumn("component", F.coalesce("component", "c"))
    names = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    labels = named.join(names, "component").join(links, "c", "left").select(
        "embedding", "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    some = rows.where(able).join(labels, "embedding").select("vec_id", "n_links", "component_id")
    none = rows.where(~F.coalesce(able, F.lit(False))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return some.unionByName(none).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
