"""Exact top k by inner product: vectors by descending length, rotated partial sums, Cauchy-Schwarz bounds.

Vectors are laid out by descending length in chunks of CHUNK rows, queries in blocks of QUERY_BLOCK rows; every
pair of a chunk and a block is one piece of work. A first pass over the longest chunk gives every query a score
that its k best can't fall below. In a chunk, vectors come in order of length: a query stops where its length times
the next vector's can't reach its k-th score. For the rest, the first coordinates after an SVD rotation are
summed in steps; |rest of q| * |rest of x| bounds what is missing, and pairs that can't reach the k-th score go.
Survivors are scored exactly on the unrotated integers, so the rotation decides speed, never results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialise

CHUNK = 8192
QUERY_BLOCK = 2048
#: Rows of a chunk that are bounded at once.
STRIPE = 1024
#: The rotation is fitted on about so many rows, chosen by a hash of vec_id.
SVD_ROWS = 20_000
SVD_PARTITIONS = 8
#: Bound steps: after each share of the coordinates, unless fewer than SPARSE of the pairs are left before.
STEPS = (0.25, 0.5, 0.75)
SPARSE = 0.1
_EXACT = 2.0**53
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def scaled(v: Column) -> Column:
    """floor(256 x) of each component, as double."""
    return F.transform(v, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("double"))


def usable(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)


def _packed(most: int):
    """Rows (size, ids, data, norm) of up to `most` vectors of one size, in the order they come."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def row(size: int) -> pa.RecordBatch:
            ids = np.concatenate([i for i, _ in held[size]])
            data = np.concatenate([d for _, d in held[size]])
            held[size] = [(ids[most:], data[most:])]
            ids, data = ids[:most], data[:most]
            norm = float(np.linalg.norm(data, axis=1).max())
            return pa.RecordBatch.from_arrays(
                [pa.array([size], pa.int64()), pa.array([ids.tobytes()], pa.binary()),
                 pa.array([data.tobytes()], pa.binary()), pa.array([norm])],
                ["size", "ids", "data", "norm"],
            )

        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes).tolist():
                some = batch.filter(pa.array(sizes == size))
                held.setdefault(size, []).append((some.column("vec_id").to_numpy(), _matrix(some.column("x"), size)))
                while sum(len(i) for i, _ in held[size]) >= most:
                    yield row(size)
        for size in held:
            if sum(len(i) for i, _ in held[size]):
                yield row(size)

    return run


_ROW = "size long, ids binary, data binary, norm double"


def rotations(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Right singular vectors of the sampled vectors, by vector size, strongest first."""
    total = vectors.count()
    grain = 1 << 20
    share = int(grain * min(1.0, SVD_ROWS / max(1, total)))
    sample = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit("svd")), F.lit(grain)) < share)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes).tolist():
                x = _matrix(batch.filter(pa.array(sizes == size)).column("x"), size)
                sums[size] = sums.get(size, 0) + x.T @ x
        for size, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), pa.array([s.tobytes()], pa.binary())], ["size", "gram"])

    whole: dict[int, np.ndarray] = {}
    for r in sample.repartition(SVD_PARTITIONS).mapInArrow(grams, "size long, gram binary").collect():
        g = np.frombuffer(r["gram"], float).reshape(r["size"], r["size"])
        whole[r["size"]] = whole.get(r["size"], 0) + g
    out = {}
    for size, g in whole.items():
        if np.isfinite(g).all():
            out[size] = np.linalg.eigh(g)[1][:, ::-1]
    return out


def _exact(q: np.ndarray, x: np.ndarray, big: bool) -> np.ndarray:
    """Integer inner products of the rows of q and x, row by row; beyond a long they stop at its ends."""
    if not big:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    sums = [sum(int(a) * int(b) for a, b in zip(u, v)) for u, v in zip(q.tolist(), x.tolist())]
    return np.array([min(max(s, _LOW), _HIGH) for s in sums], np.int64)


def _best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best: higher scores, then smaller ids."""
    order = np.lexsort((ids, -score.astype(float), query)) if not len(score) or abs(score).max() < _EXACT else np.array(
        sorted(range(len(score)), key=lambda p: (query[p], -int(score[p]), ids[p])), np.int64)
    new = np.ones(len(order), bool)
    new[1:] = query[order][1:] != query[order][:-1]
    number = np.arange(len(order))
    rank = number - np.maximum.accumulate(np.where(new, number, 0))
    return order[rank < k]


def search_chunk(
    q: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, x: np.ndarray, x_ids: np.ndarray, rotation: np.ndarray | None, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, id, score) of each query's k best in the chunk that reach its floor."""
    size = x.shape[1]
    rotation = np.eye(size) if rotation is None else rotation
    lengths, q_lengths = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
    order = np.argsort(-lengths, kind="stable")
    x, x_ids, lengths = x[order], x_ids[order], lengths[order]
    big = bool(len(x) and len(q)) and float(lengths[0] * q_lengths.max()) >= _EXACT
    slack = 1e-9 * (1 + (lengths[0] if len(x) else 0) * q_lengths)  # rounding of the bounds
    xr, qr = x @ rotation, q @ rotation
    floor = floor.astype(float).copy()
    found = [np.zeros(0, np.int64)] * 3
    for a in range(0, len(x), STRIPE):
        active = np.flatnonzero(q_lengths * lengths[a] + slack >= floor)
        if not len(active):
            break
        b = min(len(x), a + STRIPE)
        part, done = np.zeros((len(active), b - a)), 0
        i = j = None
        for share in STEPS:
            stop = max(1, int(size * share))
            part += qr[active, done:stop] @ xr[a:b, done:stop].T
            done = stop
            rest = np.linalg.norm(qr[active, done:], axis=1)[:, None] * np.linalg.norm(xr[a:b, done:], axis=1)
            alive = part + rest + slack[active, None] >= floor[active, None]
            if alive.mean() < SPARSE or share == STEPS[-1]:
                i, j = np.nonzero(alive)
                break
        i, j = active[i], j + a
        other = q_ids[i] != x_ids[j]
        i, j = i[other], j[other]
        step = max(1, (1 << 22) // size)
        score = np.concatenate([np.zeros(0, np.int64), *[
            _exact(q[i[s : s + step]], x[j[s : s + step]], big) for s in range(0, len(i), step)
        ]])
        reach = score >= floor[i]
        found = [np.concatenate([f, new]) for f, new in zip(found, (i[reach], x_ids[j[reach]], score[reach]))]
        keep = _best(found[0], found[2], found[1], k)
        found = [f[keep] for f in found]
        counts = np.bincount(found[0], minlength=len(q))
        full = counts >= k
        lowest = np.full(len(q), np.inf)
        np.minimum.at(lowest, found[0], found[2].astype(float))
        floor[full] = np.maximum(floor[full], lowest[full])
    return found[0], found[1], found[2]


def _searched(rotation: dict[int, np.ndarray], k: int):
    names = ["query_id", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                size = r["size"]
                x, q = (np.frombuffer(r[c], float).reshape(-1, size) for c in ("data", "q_data"))
                x_ids, q_ids = (np.frombuffer(r[c], np.int64) for c in ("ids", "q_ids"))
                floor = np.frombuffer(r["floor"], float)
                i, ids, score = search_chunk(q, q_ids, floor, x, x_ids, rotation.get(size), k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(ids), pa.array(score)], names)

    return run


def _floors(rotation: dict[int, np.ndarray], k: int):
    """(block, floor, least): each query's k-th score in the one chunk it met, and the block's lowest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x, q = (np.frombuffer(r[c], float).reshape(-1, r["size"]) for c in ("data", "q_data"))
                x_ids, q_ids = (np.frombuffer(r[c], np.int64) for c in ("ids", "q_ids"))
                i, _, score = search_chunk(q, q_ids, np.full(len(q), -np.inf), x, x_ids, rotation.get(r["size"]), k)
                low = np.full(len(q), np.inf)
                np.minimum.at(low, i, score.astype(float))
                low[np.bincount(i, minlength=len(q)) < k] = -np.inf
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["block"]], pa.int64()), pa.array([low.tobytes()], pa.binary()), pa.array([float(low.min())])],
                    ["block", "floor", "least"],
                )

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors with the highest integer inner product for each query row.

    vectors: (vec_id, embedding); is_query: a condition on vec_id. Components count as floor(256 x). Ties go to
    the smaller vec_id; a query's own row, and others under its id, aren't candidates; of repeated query ids the least vector asks.
    Vectors that are null, hold null or non-finite components, or have no id take no part, and vectors meet only those
    of their length. Repeated rows are candidates each. An empty table gives an empty one.
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")) & (F.size("embedding") > 0)).select(
        "vec_id", scaled(F.col("embedding")).alias("x")
    ).withColumn("size", F.size("x").cast("long"))
    rotation = rotations(rows)
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    laid = rows.withColumn("norm", norm).repartitionByRange(F.desc("norm"), F.xxhash64("vec_id")).sortWithinPartitions(
        F.desc("norm"), "vec_id"
    )
    chunks = materialise(
        laid.drop("norm").mapInArrow(_packed(CHUNK), _ROW).withColumn("chunk", F.monotonically_increasing_id()), "chunks"
    )
    queries = rows.where(is_query).groupBy("vec_id", "size").agg(F.min("x").alias("x"))
    queries = queries.groupBy("vec_id").agg(F.min(F.struct("size", "x")).alias("v")).select("vec_id", "v.x", "v.size")
    blocks = materialise(
        queries.mapInArrow(_packed(QUERY_BLOCK), _ROW).withColumn("block", F.monotonically_increasing_id()), "query_blocks"
    ).select("block", "size", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("norm").alias("q_norm"))

    # floors from the longest chunk of each size
    head = chunks.groupBy("size").agg(F.max(F.struct("norm", "chunk")).alias("top")).select("size", F.col("top.chunk").alias("chunk"))
    first = chunks.join(head, ["size", "chunk"])
    floors = materialise(
        first.join(blocks, "size").mapInArrow(_floors(rotation, k), "block long, floor binary, least double"), "floors"
    )

    # every chunk with every block of its size that it might reach, first as narrow rows
    bounds = blocks.select("block", "size", "q_norm").join(floors.select("block", "least"), "block")
    work = chunks.select("chunk", "size", "norm").join(bounds, "size").where(
        F.col("norm") * F.col("q_norm") * (1 + 1e-9) + 1e-6 >= F.col("least")
    ).select("chunk", "block")
    every = (
        work.join(chunks, "chunk").join(blocks.drop("size"), "block").join(floors.drop("least"), "block")
        .repartition("chunk", "block").mapInArrow(_searched(rotation, k), "query_id long, vec_id long, score long")
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return every.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
