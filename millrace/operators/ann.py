"""A trained approximate index: two levels of lists, rows stored by list.

Level 1 splits all vectors into `top` cells, level 2 splits every cell into `sub` lists, so the number of lists is
top x sub and no task holds more than one matrix of `top` or `sub` centroids per key. Both levels are trained alike, by
Lloyd rounds: a task multiplies its chunks with the centroids of their key and emits one partial sum per centroid it
used; partial sums are added per component. Rows are stored in folders of their top cell, sorted by list.
A search reads the folders that some probe named and scores only rows of probed lists, in the cells of `knn`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import knn
from millrace.session import materialise

ROUNDS = 4
_SUMS = "key string, cell int, total array<double>"


def matrices(centroids: DataFrame) -> DataFrame:
    """(c_key, cells, matrix): the centroids (key, cell, centroid) of a key in one row, in cell order."""
    ordered = F.sort_array(F.collect_list(F.struct("cell", "centroid")))
    return centroids.groupBy(F.coalesce("key", F.lit("")).alias("c_key")).agg(ordered.alias("c")).select(
        "c_key", F.col("c.cell").alias("cells"), F.flatten("c.centroid").alias("matrix"))


def tiles(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """Chunks of rows (event_id, key, unit), each beside the centroids of its key."""
    packed = rows.select("event_id", F.coalesce("key", F.lit("")).alias("key"), "unit").mapInArrow(knn.chunks, knn.CHUNK)
    return packed.join(matrices(centroids), F.col("key") == F.col("c_key")).drop("c_key")


def _scored(batch: pa.RecordBatch, n: int) -> tuple[str, list, np.ndarray, np.ndarray, np.ndarray]:
    """Key, ids, vectors, cells and rounded scores of one tile."""
    cells = np.array(batch.column("cells")[n].as_py())
    centroids = batch.column("matrix")[n].values.to_numpy(zero_copy_only=False).reshape(len(cells), -1)
    ids = batch.column("ids")[n].as_py()
    x = np.frombuffer(batch.column("data")[n].as_buffer(), np.float64).reshape(len(ids), -1)
    return batch.column("key")[n].as_py(), ids, x, cells, np.round(x @ centroids.T, knn.SCORE_DIGITS)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the vectors nearest to each centroid, one row per key run, task and used centroid."""
    key, total, count, cells = None, None, None, None

    def rows() -> pa.RecordBatch:
        used = np.flatnonzero(count)
        return pa.RecordBatch.from_pydict({
            "key": pa.array([key] * len(used), pa.string()), "cell": pa.array(cells[used].astype(np.int32)),
            "total": pa.array(list(total[used]), pa.list_(pa.float64()))})

    for batch in batches:
        for n in range(batch.num_rows):
            k, _, x, own, scores = _scored(batch, n)
            if k != key:
                if key is not None:
                    yield rows()
                key, cells, total, count = k, own, np.zeros((len(own), x.shape[1])), np.zeros(len(own), np.int64)
            nearest = scores.argmax(axis=1)
            np.add.at(total, nearest, x)
            count += np.bincount(nearest, minlength=len(own))
    if key is not None:
        yield rows()


def first_centroids(rows: DataFrame, n: int) -> DataFrame:
    """(key, cell, centroid): n rows of each key, by hash, different vectors only."""
    order = Window.partitionBy("key").orderBy(F.xxhash64("event_id"), "event_id")
    seen = rows.select(F.coalesce("key", F.lit("")).alias("key"), "event_id", "unit")
    return seen.withColumn("cell", F.row_number().over(order) - 1).where(F.col("cell") < n).select(
        "key", "cell", F.col("unit").alias("centroid"))


def lloyd(rows: DataFrame, n: int, rounds: int = ROUNDS) -> DataFrame:
    """(key, cell, centroid), stored: at most n centroids per key of (event_id, key, unit), unit length, by cosine."""
    centroids = materialise(first_centroids(rows, n), "centroids")
    for _ in range(rounds):
        parts = tiles(rows, centroids).mapInArrow(_sums, _SUMS).select("key", "cell", F.posexplode("total").alias("at", "x"))
        sums = parts.groupBy("key", "cell", "at").agg(F.sum("x").alias("x")).groupBy("key", "cell").agg(
            F.sort_array(F.collect_list(F.struct("at", "x"))).alias("total"))
        moved = sums.select("key", "cell", knn.unit(F.col("total.x")).alias("moved"))
        centroids = materialise(
            centroids.join(moved, ["key", "cell"], "left").select("key", "cell", F.coalesce("moved", "centroid").alias("centroid")), "centroids")
    return centroids


def _lists(rows: np.ndarray) -> pa.ListArray:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()))


def _nearest(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):
            key, ids, x, cells, scores = _scored(batch, at)
            best = np.argsort(-scores, axis=1, kind="stable")[:, :n]
            yield pa.RecordBatch.from_pydict({
                "event_id": pa.array(ids, pa.string()), "key": pa.array([key] * len(ids), pa.string()),
                "unit": _lists(x), "cells": _lists(cells[best].astype(np.int32)), "scores": _lists(np.take_along_axis(scores, best, 1))})


def nearest_cells(rows: DataFrame, centroids: DataFrame, n: int = 1) -> DataFrame:
    """(event_id, key, unit, cells, scores): the n nearest centroids of the row's key, ties to the smaller cell."""
    return tiles(rows, centroids).mapInArrow(
        partial(_nearest, n=n), "event_id string, key string, unit array<double>, cells array<int>, scores array<double>")


class ListIndex:
    """Centroids of both levels and the rows by list, under one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.rows = spark.read.parquet(f"{path}/rows")
        self.tops = spark.read.parquet(f"{path}/tops")
        self.subs = spark.read.parquet(f"{path}/subs")

    def probe(self, probes: DataFrame, nprobe: int) -> DataFrame:
        """(event_id, top, list_id): the nprobe nearest lists of each (event_id, unit), of its nprobe nearest top cells."""
        whole = F.lit("").alias("key")
        tops = nearest_cells(probes.select("event_id", whole, "unit"), self.tops, nprobe)
        each = tops.select("event_id", F.explode(F.col("cells").cast("array<string>")).alias("key"), "unit")
        lists = nearest_cells(each, self.subs, nprobe).select(
            "event_id", F.col("key").cast("int").alias("top"), F.inline(F.arrays_zip(F.col("cells").alias("sub"), F.col("scores").alias("score"))))
        order = Window.partitionBy("event_id").orderBy(F.col("score").desc(), "top", "sub")
        near = lists.withColumn("n", F.row_number().over(order)).where(F.col("n") <= nprobe)
        return near.select("event_id", "top", F.concat_ws("-", "top", "sub").alias("list_id"))

    def search(self, probes: DataFrame, nprobe: int) -> DataFrame:
        """(probe_id, event_id, score, probe_rank) of (probe_id, lim, embedding): the best rows of the probed lists."""
        asked = materialise(probes.select("probe_id", F.col("lim").cast("int").alias("lim"), "embedding"), "ann_probes")
        lists = materialise(self.probe(asked.select(F.col("probe_id").alias("event_id"), knn.unit(F.col("embedding")).alias("unit")), nprobe), "probed_lists")
        near = knn.only(self.rows, lists.where("top >= 0"), ["top"])
        keyed = lists.select(F.col("event_id").alias("probe_id"), F.col("list_id").alias("key")).join(asked, "probe_id")
        hits = knn.tile_best(near, keyed, "list_id").drop("probe_rank").join(asked.select("probe_id", "lim"), "probe_id")
        return knn.best(hits, F.col("lim")).drop("lim")


def build(vectors: DataFrame, path: str, top: int, sub: int, rounds: int = ROUNDS) -> ListIndex:
    """Train both levels on all rows of (event_id, unit) and store the rows by list."""
    spark = vectors.sparkSession
    rows = vectors.select("event_id", F.lit("").alias("key"), "unit")
    tops = lloyd(rows, top, rounds)
    placed = nearest_cells(rows, tops).select("event_id", F.col("cells")[0].cast("string").alias("key"), "unit")
    placed = materialise(placed, "top_cells")
    subs = lloyd(placed, sub, rounds)
    lists = nearest_cells(placed, subs).select(
        "event_id", F.col("key").cast("int").alias("top"), F.concat_ws("-", "key", F.col("cells")[0]).alias("list_id"), "unit")
    laid = lists.repartitionByRange("top", "list_id", "event_id").sortWithinPartitions("top", "list_id", "event_id")
    laid.write.mode("overwrite").partitionBy("top").parquet(f"{path}/rows")
    tops.write.mode("overwrite").parquet(f"{path}/tops")
    subs.write.mode("overwrite").parquet(f"{path}/subs")
    return ListIndex(spark, path)
