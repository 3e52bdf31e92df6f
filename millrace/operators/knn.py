"""Exact nearest neighbours for whole tables of probes: filter first, then score.

A probe is a question, optionally limited to a station, to a time window, or to lists of an approximate index.

Vectors are stored with unit length under folders of station and day, with a time slot on every row. A windowed probe
becomes one key per slot it touches; days without a probe are pruned from the scan, and vectors meet probes in an
equi-join on the key and a range condition before any product. So what is scored grows with the windows, not with the
index.

Probes without a window are searched in cells. The rows of a key (or all rows, for probes without a key) are dealt
by hash into parts, its probes likewise, each part at most GROUP_BYTES; a cell is one part of rows against one part of
probes, brought together by a cogroup. So nothing passes through the driver, a task holds two parts whatever
the sizes, and a frequent key has many cells. In a cell, products in single precision tell which pairs can reach the
probe's floor, with room for their error; only these are scored in double precision. Where a probe meets more than
FEW_PARTS parts, a search over one row in LEAD finds its floor first. There is no other plan for few or for many probes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.columns import let, micros
from millrace.session import materialise, shuffle_partitions

DAY_US = 86_400_000_000
SLOT_US = 600_000_000
GROUP_BYTES = 32 << 20
TILE_BYTES = 1 << 20
LEAD = 8
MOST_LEADS = 4
FEW_PARTS = 8
#: Cells per core, rows of a part that are worth a cell of their own, and shuffle partitions per full cell.
CELLS, LEAST, ROOM = 4, 2048, 4
#: Probes and rows of one product, small enough to be compared where it was computed; pairs a probe gathers before they
#: are ranked, on average; pairs of vectors that are scored at once.
PRODUCT, GATHER, PAIRS = (1024, 512), 16, 1 << 16
SCORE_DIGITS = 9
NO_TIME = -(2**62)

HITS = "probe_id string, event_id string, score double"
CHUNK = "key string, ids array<string>, data binary"
_BLOCK = "key string, probe_ids array<string>, lims array<int>, floors array<double>, q_data binary"


def unit(vector: Column) -> Column:
    """The vector with length 1; its length is computed once per vector, not once per element."""
    def scaled(x: Column) -> Column:
        norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
        return let(norm, lambda n: F.when(n == 0, x).otherwise(F.transform(x, lambda v: v / n)))

    return let(F.transform(vector, lambda v: v.cast("double")), scaled)


def laid_out(index: DataFrame) -> DataFrame:
    """An index table with day, slot, start_us and the vector with unit length; rows without a vector go.

    A stored layout is returned as it is.
    """
    if "unit" in index.columns:
        return index
    start = micros("start_ts")
    return index.where(F.col("embedding").isNotNull()).withColumns({
        "day": F.floor(start / DAY_US), "slot": F.floor(start / SLOT_US), "start_us": F.coalesce(start, F.lit(NO_TIME)),
        "unit": unit(F.col("embedding")),
    }).drop("embedding")


def store(index: DataFrame, path: str, folders: tuple[str, ...] = ("station", "day")) -> None:
    """Write the layout once, by range, so that a station or list with much of the table has many files."""
    order = [*folders, *[c for c in ("start_us", "event_id") if c not in folders]]
    laid = laid_out(index).repartitionByRange(*order).sortWithinPartitions(*order)
    laid.write.mode("overwrite").partitionBy(*folders).parquet(path)


def open_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def only(vectors: DataFrame, keys: DataFrame, folders: list[str]) -> DataFrame:
    """Rows in folders that `keys` names. Broadcast: as many rows at most as the store has folders, which the driver
    lists anyway; the scan's partition filter comes from the same broadcast."""
    return vectors.join(F.broadcast(keys.select(*folders).distinct()), folders, "left_semi")


def window_keys(probes: DataFrame) -> DataFrame:
    """One row per probe with a station and a window, and time slot that the window touches; empty windows have none."""
    asked = probes.where("station IS NOT NULL AND lo_us <= hi_us")
    slots = F.sequence(F.floor(F.col("lo_us") / SLOT_US), F.floor(F.col("hi_us") / SLOT_US))
    keyed = asked.select(
        "probe_id", "station", "lo_us", "hi_us", "lim", unit(F.col("embedding")).alias("probe"), F.explode(slots).alias("slot"))
    return keyed.withColumn("day", F.floor(F.col("slot") * SLOT_US / DAY_US))


def window_pairs(vectors: DataFrame, probes: DataFrame) -> DataFrame:
    """All rows inside the window of a probe, with lim and both vectors; nothing else is joined."""
    keys = window_keys(probes)
    near = only(vectors, keys, ["station", "day"]).select("event_id", "station", "slot", "start_us", "unit")
    inside = F.col("start_us").between(F.col("lo_us"), F.col("hi_us"))
    return near.join(keys.drop("day"), ["station", "slot"]).where(inside).select("probe_id", "event_id", "lim", "unit", "probe")


def window_hits(vectors: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe_id, event_id, score, probe_rank): the best `lim` rows inside each probe's window."""
    product = F.aggregate(F.zip_with("unit", "probe", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    scored = window_pairs(vectors, probes).select("probe_id", "event_id", F.round(product, SCORE_DIGITS).alias("score"), "lim")
    return best(scored, F.col("lim")).drop("lim")


def best(hits: DataFrame, lim: Column) -> DataFrame:
    """`hits` with probe_rank by score, ties to the smaller event id, up to lim."""
    order = Window.partitionBy("probe_id").orderBy(F.col("score").desc(), "event_id")
    return hits.withColumn("probe_rank", F.row_number().over(order)).where(F.col("probe_rank") <= lim)


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Each key of a batch with its rows, in pieces of at most TILE_BYTES."""
    if not batch.num_rows:
        return
    codes = batch.column("key").dictionary_encode()
    numbers = codes.indices.to_numpy()
    batch = batch.take(pa.array(np.argsort(numbers, kind="stable")))
    step = max(1, TILE_BYTES // (8 * max(1, len(batch.column("unit")[0]))))
    ends = np.cumsum(np.bincount(numbers))
    for name, lo, hi in zip(codes.dictionary.to_pylist(), [0, *ends[:-1]], ends):
        for at in range(lo, hi, step):
            yield name, batch.slice(at, min(step, hi - at))


def _one(part: pa.RecordBatch, column: str) -> pa.ListArray:
    """A column's values as one list."""
    values = part.column(column)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (event_id, key, unit) in any order as chunks of one key."""
    for batch in batches:
        for key, part in _runs(batch):
            data = _matrix(part.column("unit"), part.num_rows).tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([key], pa.string()), _one(part, "event_id"), pa.array([data], pa.binary())], names=["key", "ids", "data"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, probe_id, lim, floor, unit) as blocks of one key."""
    for batch in batches:
        for key, part in _runs(batch):
            data = _matrix(part.column("unit"), part.num_rows).tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([key], pa.string()), _one(part, "probe_id"), _one(part, "lim"), _one(part, "floor"), pa.array([data], pa.binary())],
                names=["key", "probe_ids", "lims", "floors", "q_data"])


def _stacked(column: pa.ChunkedArray, widths: list[int]) -> np.ndarray:
    parts = [np.frombuffer(b.as_buffer(), np.float64).reshape(n, -1) for b, n in zip(column, widths)]
    return np.concatenate(parts)


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays([c.flatten() for c in column.chunks])


def _marked(flags: np.ndarray) -> np.ndarray:
    """np.flatnonzero for a few marks among many: eight flags at a time are passed over."""
    flat = flags.reshape(-1)
    if flat.size % 8:
        return np.flatnonzero(flat)
    eights = np.flatnonzero(flat.view(np.uint64))
    n, m = np.nonzero(flat.reshape(-1, 8)[eights])
    return eights[n] * 8 + m


def _scores(q: np.ndarray, x: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Rounded products of pairs in double precision."""
    parts = [np.einsum("ij,ij->i", q[n[at:at + PAIRS]], x[m[at:at + PAIRS]]) for at in range(0, len(n), PAIRS)]
    return np.round(np.concatenate([np.empty(0), *parts]), SCORE_DIGITS)


def _best_of(q: np.ndarray, x: np.ndarray, lims: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probe, row, score) of the best `lims` rows of each probe that reach its floor, ties to the smaller row number.

    Pairs are ranked in single precision, with room for its error, and scored in double precision at the end, or earlier if
    so many are close to each other that this doesn't tell them apart.
    """
    room = (x.shape[1] + 8) * 2.0**-23 + 10.0**-SCORE_DIGITS  # error of a product of unit vectors in single precision
    q32, x32 = q.astype(np.float32), x.astype(np.float32)
    low, most = floor - room, int(lims.max())
    i, j, s, rough = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.float32)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(x), PRODUCT[1]):
        near = q32 @ x32[at:at + PRODUCT[1]].T
        width, end = near.shape[1], at + PRODUCT[1] >= len(x)
        if np.isneginf(low).any() and width >= most:
            low = np.fmax(low, -np.partition(-near, most - 1, axis=1)[:, most - 1] - 2 * room)
        reach = _marked(near >= low[:, None].astype(np.float32))
        held.append((reach // width, reach % width + at, near.reshape(-1)[reach]))
        if sum(len(h[0]) for h in held) >= GATHER * len(q) or end:
            i, j, rough = (np.concatenate([a, *b]) for a, b in zip((i, j, rough), zip(*held)))
            held = []
            order = np.argsort(4.0 * i - rough)  # by probe, then by falling product, which lies between -1 and 1
            i, j, rough = i[order], j[order], rough[order]
            last = np.arange(len(i)) - np.searchsorted(i, i) == lims[i] - 1
            low[i[last]] = np.maximum(low[i[last]], rough[last] - 2 * room)
            reach = rough >= low[i]
            i, j, rough = i[reach], j[reach], rough[reach]
            if end or len(i) > 2 * lims.sum():
                s = _scores(q, x, i, j)
                order = np.lexsort((j, -s, i))
                order = order[(s >= floor[i])[order]]
                i, j, s, rough = i[order], j[order], s[order], rough[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                last = place == lims[i] - 1
                low[i[last]] = np.maximum(low[i[last]], s[last] - room)
                keep = place < lims[i]
                i, j, s, rough = i[keep], j[keep], s[keep], rough[keep]
    return i, j, s


def _cell(rows: pa.Table, probes: pa.Table) -> pa.Table:
    """The best rows of each probe of a cell."""
    out = {"probe_id": [], "event_id": [], "score": [], "lim": []}
    if rows.num_rows and probes.num_rows:
        ids, lims = _flat(rows["ids"]), _flat(probes["lims"]).to_numpy()
        names, floors = _flat(probes["probe_ids"]), _flat(probes["floors"]).to_numpy()
        x = _stacked(rows["data"], pc.list_value_length(rows["ids"]).to_pylist())
        q = _stacked(probes["q_data"], pc.list_value_length(probes["probe_ids"]).to_pylist())
        order = pc.sort_indices(ids)  # so that the smaller number is the smaller id
        ids, x = ids.take(order), x[order.to_numpy()]
        for at in range(0, len(q), PRODUCT[0]):
            part = slice(at, at + PRODUCT[0])
            i, j, s = _best_of(q[part], x, lims[part], floors[part])
            out["probe_id"].append(names.take(pa.array(i + at)))
            out["event_id"].append(ids.take(pa.array(j)))
            out["score"].append(pa.array(s))
            out["lim"].append(pa.array(lims[i + at]))
    types = {"probe_id": pa.string(), "event_id": pa.string(), "score": pa.float64(), "lim": pa.int32()}
    return pa.table({c: pa.chunked_array(v, types[c]) for c, v in out.items()})


def _cells(rows: DataFrame, probes: DataFrame, sizes: DataFrame, side: int, tasks: int) -> DataFrame:
    """(probe_id, event_id, score, lim): the best rows of each cell of rows (event_id, key, unit) and probes
    (probe_id, key, lim, unit, floor); sizes has the rows and probes of each key, side the rows or probes of a part; cells are dealt over `tasks`
    partitions if that is more than a shuffle has anyway."""
    cuts = sizes.select("key", F.ceil(F.col("n_rows") / side).cast("int").alias("r"), F.ceil(F.col("n_probes") / side).cast("int").alias("p"))
    name = lambda number: F.concat_ws("#", number, "key")
    cells = cuts.select("key", F.explode(F.sequence(F.lit(0), F.col("r") - 1)).alias("r"), "p").select(
        "key", "r", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("p")).select(
        F.concat_ws("#", "r", "p", "key").alias("cell"), name(F.col("r")).alias("row_key"), name(F.col("p")).alias("probe_key"))
    packed = rows.join(cuts, "key").select(
        "event_id", name(F.pmod(F.hash("event_id"), "r")).alias("key"), "unit").mapInArrow(chunks, CHUNK)
    blocks = probes.join(cuts, "key").select(
        name(F.pmod(F.hash("probe_id"), "p")).alias("key"), "probe_id", "lim", "floor", "unit").mapInArrow(_blocks, _BLOCK)
    left = packed.join(cells, F.col("key") == F.col("row_key")).select(F.col("cell").alias("row_cell"), "ids", "data")
    right = blocks.join(cells, F.col("key") == F.col("probe_key")).select(F.col("cell").alias("probe_cell"), "probe_ids", "lims", "floors", "q_data")
    if tasks > shuffle_partitions(rows.sparkSession):  # else several full cells often meet in a task while cores wait
        left, right = left.repartition(tasks, "row_cell"), right.repartition(tasks, "probe_cell")
    return left.groupBy("row_cell").cogroup(right.groupBy("probe_cell")).applyInArrow(_cell, HITS + ", lim int")


def tile_hits(vectors: DataFrame, probes: DataFrame, key: str = "station") -> DataFrame:
    """(probe_id, event_id, score): a superset of the best `lim` rows of each probe among rows of its key.

    A probe (probe_id, key, lim, embedding) without a key meets all rows; one without a vector finds nothing.
    """
    return _found(vectors, probes, key).drop("lim")


def tile_best(vectors: DataFrame, probes: DataFrame, key: str = "station") -> DataFrame:
    """(probe_id, event_id, score, probe_rank): the best `lim` rows of each probe among rows of its key."""
    return best(_found(vectors, probes, key), F.col("lim")).drop("lim")


def _found(vectors: DataFrame, probes: DataFrame, key: str) -> DataFrame:
    spark = vectors.sparkSession
    marked = F.concat(F.lit("="), "key")
    asked = materialise(probes.where("embedding IS NOT NULL").select(
        "probe_id", F.coalesce(marked, F.lit("")).alias("key"), F.col("lim").cast("int").alias("lim"), unit(F.col("embedding")).alias("unit")), "probe_units")
    rows = vectors.select("event_id", F.col(key).cast("string").alias("key"), "unit").select(
        "event_id", F.explode(F.array_compact(F.array(F.lit(""), marked))).alias("key"), "unit")
    sizes = materialise(
        asked.groupBy("key").agg(F.count(F.lit(1)).alias("n_probes")).join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows")), "key"), "sizes")
    total = sizes.agg(F.sum(F.col("n_probes") * F.col("n_rows")).alias("pairs"), F.max("n_rows").alias("most")).first()
    width = asked.agg(F.max(F.size("unit"))).first()[0] or 1
    if not total["pairs"]:
        return spark.createDataFrame([], HITS + ", lim int")

    def side(pairs: float) -> int:
        worth = (pairs / (CELLS * spark.sparkContext.defaultParallelism)) ** 0.5
        return max(1, min(GROUP_BYTES // (8 * width), max(LEAST, int(worth))))

    leads = 0
    while total["most"] / LEAD**leads / side(total["pairs"] / LEAD**leads) > FEW_PARTS and leads < MOST_LEADS:
        leads += 1
    floors = None
    for level in range(leads, -1, -1):
        share = LEAD**level
        some = rows.where(F.pmod(F.xxhash64("event_id"), F.lit(share)) == 0) if level else rows
        none = F.lit(float("-inf"))
        floored = asked.withColumn("floor", none) if floors is None else asked.join(floors, "probe_id", "left").withColumn("floor", F.coalesce("floor", none))
        pairs = total["pairs"] / share
        tasks = int(ROOM * pairs / side(pairs) ** 2)
        hits = _cells(some, floored, sizes.withColumn("n_rows", F.ceil(F.col("n_rows") / share)), side(pairs), tasks)
        if level:
            ranked = best(hits, F.col("lim")).where("probe_rank = lim")
            floors = materialise(ranked.groupBy("probe_id").agg(F.min("score").alias("floor")), "floors")
    return hits
