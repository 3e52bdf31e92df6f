"""From episodes to the searchable table: selection, embedded text, vectors, layout."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import hash_order
from millrace.functions.text import tokenize
from millrace.operators.rules import context_sentence, with_context

DOCUMENT_PREFIX = "search_document: "
QUERY_PREFIX = "search_query: "
READY_SAMPLE = 0
SEED = 42


def sampled_ready(episodes: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """At most n ready episodes in a seeded order (top-n, no full sort)."""
    return (
        episodes.where(F.col("current_state") == "ready")
        .orderBy(hash_order(seed, F.col("episode_id")), "episode_id").limit(n)
    )


def index_selection(episodes: DataFrame, ready: int = READY_SAMPLE, seed: int = SEED) -> DataFrame:
    """All not-ready episodes and a bounded sample of the ready ones."""
    busy = episodes.where(F.col("current_state") == "not ready")
    return busy if ready == 0 else busy.unionByName(sampled_ready(episodes, ready, seed))


def embed_text(text: Column, context: Column) -> Column:
    return F.concat(
        F.lit(DOCUMENT_PREFIX), text,
        F.when(context != "", F.concat(F.lit(" | "), context)).otherwise(F.lit("")),
    )


def query_text(question: Column) -> Column:
    return F.concat(F.lit(QUERY_PREFIX), question)


def token_dimension(token: Column, dim: int) -> Column:
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint") % dim).cast("int")


def _unit_counts(dim: int, name: str):
    """Append unit-length counts of the token places in the last column, which goes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(batch.num_columns - 1)
            owner = np.repeat(np.arange(batch.num_rows), places.value_lengths().to_numpy())
            cells = owner * dim + places.flatten().to_numpy()
            n = np.bincount(cells, minlength=batch.num_rows * dim).reshape(-1, dim).astype(float)
            norm = np.sqrt((n * n).sum(1, keepdims=True))
            unit = n / np.where(norm == 0, 1.0, norm)
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * dim
            vectors = pa.ListArray.from_arrays(pa.array(ends), pa.array(unit.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], vectors], [*batch.schema.names[:-1], name])

    return run


def with_text_vectors(
    rows: DataFrame, text: str, dim: int, name: str = "embedding",
    embedder: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Add a vector of `text`. `embedder` is the hook for another model, e.g. a pandas UDF from
    string to array<double>; by default hashed term frequencies with unit length, counted in one pass
    over the tokens of a batch."""
    if embedder is not None:
        return rows.withColumn(name, embedder(F.col(text)))
    tokens = tokenize(F.coalesce(F.col(text), F.lit("")))
    hashed = rows.withColumn("_places", F.transform(tokens, lambda t: token_dimension(t, dim)))
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])
    return hashed.mapInArrow(_unit_counts(dim, name), schema)


def index_rows(episodes: DataFrame, ready: int = READY_SAMPLE) -> DataFrame:
    """Columns of the searchable table, whole, with the bare and the embedded text."""
    rows = with_context(index_selection(episodes, ready))
    text = lambda source, target: F.coalesce(source, F.lit("")).alias(target)
    return rows.select(
        text("episode_id", "event_id"), text("station", "station"),
        "start_ts", "end_ts",
        text("current_state", "current_state"), text("current_task", "current_task"),
        text("current_sub_task", "current_sub_task"),
        F.col("duration_s").cast("float").alias("duration_s"),
        "is_anomaly",
        text("text", "log_text"),
        embed_text(F.col("text"), context_sentence()).alias("embed_text"),
    )


def write_index(
    rows: DataFrame, path: str, dim: int, embedder: Callable[[Column], Column] | None = None
) -> None:
    """Parquet by station, sorted by start: a station filter prunes folders, a time filter row
    groups. The range layout splits a station that holds much of the table over many files.

    Vectors are computed after the layout: its sampling pass would otherwise compute them twice.
    """
    laid = rows.repartitionByRange("station", "start_ts", "event_id").sortWithinPartitions(
        "station", "start_ts"
    )
    with_text_vectors(laid, "embed_text", dim, embedder=embedder).write.mode(
        "overwrite"
    ).partitionBy("station").parquet(path)
