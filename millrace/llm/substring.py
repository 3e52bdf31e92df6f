"""Repeated passages by compaction of the de Bruijn graph of word windows.

Edges are windows of LENGTH words; the document's next window is the next edge. Every window owns its
minimizer, the k-mer (ANCHOR words) of least hash in it, so equal windows agree on it and on where it lies.
1. Consecutive windows with one minimizer are a path. A path is compacted to one record: minimizer, hash of all
   its words, source coordinates. Minimizers that occur in one document only are dropped before anything else.
2. Occurrences of equal paths are joined; the path's least document decides for all its windows at once.
3. Where several paths share a minimizer, the graph branches (texts that differ nearby, passages that begin or end there).
   One source of each such path is read again at its coordinates, its windows are expanded, and windows of
   different paths are joined.
4. Spans go back to their source coordinates, and words covered by a repeated window are removed.

Hashes have 64 bits and are only compared under the same minimizer hash, so 128 bits have to agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialise, slices
from millrace.llm.words import Runs, mix, windows, word_hashes

LENGTH = 50
ANCHOR = 18
BATCH_BYTES = 2 << 20
_LAST = (1 << 63) - 1


def paths(texts: list[bytes], length: int = LENGTH, anchor: int = ANCHOR):
    """(minimizer hash, path hash, text number, first and last window start in the text) of all paths."""
    hashes, first, _ = word_hashes(texts)
    starts = windows(first, length)
    if not len(starts):
        return None
    run = Runs(hashes)
    at = np.arange(len(hashes) - anchor + 1)
    grams = np.concatenate([run.of(at, at + anchor), np.full(anchor, 2**64 - 1, np.uint64)])
    # leftmost minimum of each stretch of `span` k-mers, doubling the span
    best, span, need = np.arange(len(grams)), 1, length - anchor + 1
    while span * 2 <= need:
        left, right = best[:-span], best[span:]
        best = np.concatenate([np.where(grams[right] < grams[left], right, left), best[len(best) - span :]])
        span *= 2
    left, right = best[starts], best[starts + need - span]
    owner = np.where(grams[right] < grams[left], right, left)
    new = np.ones(len(starts), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + 1)
    head = np.flatnonzero(new)
    low, owner = starts[head], owner[head]
    high = starts[np.concatenate([head[1:], [len(starts)]]) - 1]
    whole = mix(run.of(low, high + length) ^ (owner - low).astype(np.uint64), 21)
    text = np.searchsorted(first, low, side="right") - 1
    return grams[owner], whole, text, low - first[text], high - first[text]


def _bytes(part: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode() for t in part.column("text").to_pylist()]


def _compacted(length: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                found = paths(_bytes(part), length, anchor)
                if found is None:
                    continue
                gram, whole, text, low, high = found
                text = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(gram.view(np.int64)), pa.array(whole.view(np.int64)), part.column("doc_id").take(text),
                        part.column("key").take(text), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)),
                    ],
                    ["gram", "path", "doc_id", "key", "low", "high"],
                )

    return run


def _expanded(length: int):
    """The windows of wanted paths, read at their source coordinates."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                hashes, first, _ = word_hashes(_bytes(part))
                lists = part.column("wanted")
                owner = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                flat = lists.flatten()
                low, high = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("low", "high"))
                count = high - low + 1
                row = np.repeat(np.arange(len(low)), count)
                offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = first[owner[row]] + low[row] + offset
                window = Runs(hashes).of(start, start + length)
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        flat.field("gram").take(row), flat.field("path").take(row), flat.field("least").take(row),
                        pa.array(offset.astype(np.int32)), pa.array(window.view(np.int64)),
                    ],
                    ["gram", "path", "least", "offset", "window"],
                )

    return run


def _same_text(id_a: str, key_a: str, id_b: str, key_b: str):
    return F.col(id_a).eqNullSafe(F.col(id_b)) & (F.col(key_a) == F.col(key_b))


def repeated_windows(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, key, gone): starts (first, last) of windows that also start in a document with a smaller id.

    key is xxhash64 of the text. Null ids are no smaller than any other; different texts of one id don't count
    against each other.
    """
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("key"), "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    # Read twice and not stored: the paths of all texts are as large as the texts.
    found = texts.mapInArrow(
        _compacted(length, anchor), f"gram long, path long, doc_id {id_type}, key long, low int, high int"
    )
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    shared = found.groupBy("gram").agg(F.min(order).alias("a"), F.max(order).alias("b")).where("a < b").select("gram")
    shared = materialise(shared, "shared_grams")  # so that the join's partition of a hot gram can be split
    found = materialise(found.join(shared, "gram"), "shared_paths").withColumn("ord", order)

    place = F.struct("ord", "doc_id", "key", "low", "high")
    merged = materialise(found.groupBy("gram", "path").agg(F.min(place).alias("source")), "merged_paths")
    forks = merged.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    wanted = (
        merged.join(forks, "gram")
        .select("gram", "path", F.col("source.ord").alias("least"), "source.low", "source.high",
                F.col("source.doc_id").alias("w_id"), F.col("source.key").alias("w_key"))
        .groupBy("w_id", "w_key").agg(F.collect_list(F.struct("gram", "path", "least", "low", "high")).alias("wanted"))
    )
    sources = texts.join(wanted, _same_text("doc_id", "key", "w_id", "w_key")).select("text", "wanted")
    edges = materialise(
        sources.mapInArrow(_expanded(length), "gram long, path long, least long, offset int, window long"), "windows"
    )
    least = edges.groupBy("gram", "window").agg(F.min("least").alias("first_doc"), F.max("least").alias("last_doc"))
    # only windows whose document comes before the path's own least document say more than that
    parted = (
        edges.join(least.where("first_doc < last_doc").drop("last_doc"), ["gram", "window"]).where("first_doc < least")
        .groupBy("gram", "path").agg(F.collect_set(F.struct("offset", "first_doc")).alias("parts"))
    )
    # one record per path: its least document, and for a path at a fork the least one of each window
    known = merged.select("gram", "path", F.col("source.ord").alias("least")).join(parted, ["gram", "path"], "left")
    known = materialise(known, "judged_paths")
    judged = found.join(known, ["gram", "path"])
    spans = F.when(F.col("least") < F.col("ord"), F.array(F.struct(F.col("low").alias("first"), F.col("high").alias("last")))).when(
        F.col("parts").isNotNull(),
        F.transform(
            F.filter("parts", lambda p: p["first_doc"] < F.col("ord")),
            lambda p: F.struct((F.col("low") + p["offset"]).alias("first"), (F.col("low") + p["offset"]).alias("last")),
        ),
    )
    return (
        judged.select("doc_id", "key", spans.alias("spans")).where(F.size("spans") > 0)
        .groupBy("doc_id", "key").agg(F.flatten(F.collect_list("spans")).alias("gone"))
    )


def kept_words(text: bytes, first: np.ndarray, last: np.ndarray, length: int) -> tuple[int, list[bytes]]:
    """Number of words, and those no window of the spans covers."""
    words = text.split()
    if not len(first):
        return len(words), words
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, last + length, -1)
    gone = np.cumsum(cover)[:-1] > 0
    return len(words), [w for w, g in zip(words, gone.tolist()) if not g]


def dedup(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, text, kept_sha256): each whole text without words in repeated windows.

    text: the kept words joined by one space. Words are runs without blank, tab and line ends, unchanged.
    Null and empty texts have no words. Repeated rows, and different texts under one id, don't remove each other's
    words. Only doc_id and text are read, so other columns can't clash; an empty table gives an empty one.
    """
    gone = repeated_windows(docs, length, anchor).select(F.col("doc_id").alias("g_id"), F.col("key").alias("g_key"), "gone")
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), "text").join(
        gone, _same_text("doc_id", "key", "g_id", "g_key"), "left"
    ).select("doc_id", "text", "gone")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, text string, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                spans = part.column("gone")
                flat = spans.flatten()
                first, last = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("first", "last"))
                ends = np.cumsum(np.nan_to_num(spans.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
                total, removed, text, digest = [], [], [], []
                begin = 0
                for t, end in zip(_bytes(part), ends.tolist()):
                    n, kept = kept_words(t, first[begin:end], last[begin:end], length)
                    begin = end
                    joined = b" ".join(kept)
                    total.append(n)
                    removed.append(n - len(kept))
                    text.append(joined.decode())
                    digest.append(hashlib.sha256(joined).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(text, pa.string()), pa.array(digest, pa.string())],
                    ["doc_id", "n_words", "n_removed", "text", "kept_sha256"],
                )

    return rows.mapInArrow(run, schema)
