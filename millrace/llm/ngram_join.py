"""Jaccard join of word n-gram sets: banded MinHash LSH, then exact verification.

Texts with the same words are one class. A class has TREES signatures (bands) of MAX_DEPTH MinHash values. Bands
are cut to the longest prefix at which the expected recall of pairs at the threshold reaches the target; what
shares this prefix in some band is a bucket. That depth follows from threshold, target and TREES alone, so no trie
is built: all longer matches share the prefix too. The values after it only enter the sketch.

Within a bucket, classes whose signatures agree far less than any linked pair's would are parted again.
What is left connected is verified exactly: shingle sets as bit rows, intersections by popcount, in blocks of
bounded size that deal a large group over many tasks. Only sums per class and a spanning
forest of the links leave a task, never the pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialise, slices
from millrace.llm.components import components, in_blocks, local_roots, of_two_blocks, runs
from millrace.llm.words import Runs, mix, windows, word_hashes

N = 5
THRESHOLD = 0.8
TREES = 24
MAX_DEPTH = 6
TARGET_RECALL = 0.9999
#: Classes and words of a block: what one task compares at once.
BLOCK_CLASSES = 1024
BLOCK_WORDS = 1_000_000
#: Buckets part classes whose signatures agree this many standard deviations less than the threshold.
DEVIATIONS = 6
BATCH_BYTES = 1 << 20
_U = np.uint64


def forest_depth(threshold: float = THRESHOLD, trees: int = TREES, target: float = TARGET_RECALL) -> int:
    """Longest prefix whose expected recall at the threshold reaches the target, shortened from MAX_DEPTH."""
    depth = MAX_DEPTH
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    n = TREES * MAX_DEPTH
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) * _U(2) + _U(1), rng.integers(1, 1 << 63, n, dtype=np.uint64)


def shingles(texts: list[bytes], n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams of all texts, text number of each, words per text, and word hashes' Runs bounds.

    A text of 1 to n-1 words has one shingle, all its words; an empty one has none.
    """
    hashes, first, _ = word_hashes(texts)
    lane = Runs(hashes)
    counts = np.diff(first)
    start = windows(first, n)
    short = np.flatnonzero((counts > 0) & (counts < n))
    begin = np.concatenate([start, first[short]])
    stop = np.concatenate([start + n, first[short + 1]])
    owner = np.searchsorted(first, begin, side="right") - 1
    # an empty text shares its first word with the next one; searchsorted takes the last such text
    order = np.argsort(owner, kind="stable")
    keys = np.stack([lane.of(first[:-1], first[1:]), Runs(hashes, 1).of(first[:-1], first[1:])])
    return lane.of(begin, stop)[order], owner[order], counts, keys


def _signed(depth: int, n: int):
    a, b = _multipliers()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                texts = [(t or "").encode() for t in part.column("text").to_pylist()]
                grams, owner, counts, keys = shingles(texts, n)
                full = np.flatnonzero(counts)
                values = np.zeros((len(texts), len(a)), np.uint32)
                if len(full):
                    heads = np.searchsorted(owner, full)
                    for k in range(len(a)):
                        hashed = (grams * a[k] + b[k]) >> _U(32)
                        values[full, k] = np.minimum.reduceat(hashed, heads)
                trees = values.reshape(len(texts), TREES, MAX_DEPTH)
                codes = np.zeros((len(texts), TREES), _U)
                for d in range(depth):
                    codes = mix(codes ^ trees[:, :, d].astype(_U), d + 9)
                sketch = (values & 255).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)),
                        pa.array(counts.astype(np.int64)),
                        pa.array(list(codes.view(np.int64)), pa.list_(pa.int64())),
                        pa.array([s.tobytes() for s in sketch], pa.binary()),
                    ],
                    ["id", "k1", "k2", "words", "codes", "sketch"],
                )

    return run


def _tied(least: float):
    """Star edges (u, v) of the classes of each bucket whose sketches agree in at least `least` of their places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs = [], []
        for group in runs(batches, ("tree", "code", "_b1", "_b2")):
            n = group.num_rows
            if n < 2:
                continue
            c = group.column("c").to_numpy()
            block = group.column("_b").to_numpy()
            s = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(n, -1)
            apart = of_two_blocks(group)
            root = np.arange(n)
            for i in range(n - 1):
                rest = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
                if apart:
                    rest = rest[block[rest] != block[i]]
                if len(rest):
                    hit = rest[(s[rest] == s[i]).mean(1) >= least]
                    for r in np.unique(root[hit]):
                        root[root == max(r, root[i])] = min(r, root[i])
            tied = np.flatnonzero(root != np.arange(n))
            us.append(c[tied])
            vs.append(c[root[tied]])
            if len(us) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])
                us, vs = [], []
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    return run


def linked_pairs(sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i, j of the sets (sorted distinct hashes) with a Jaccard similarity of at least the threshold."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets])
    order = np.argsort(sizes, kind="stable")
    flat = np.concatenate([sets[k] for k in order])
    row = np.repeat(np.arange(n), sizes[order])
    _, column, often = np.unique(flat, return_inverse=True, return_counts=True)
    shared = often[column] > 1  # a shingle of one set alone is in no intersection
    _, column = np.unique(column[shared], return_inverse=True)
    width = (int(column.max()) + 64) // 64 if len(column) else 1
    bits = np.zeros((n, width), _U)
    np.bitwise_or.at(bits, (row[shared], column // 64), _U(1) << (column % 64).astype(_U))
    size = sizes[order]
    left, right = [], []
    for i in range(n - 1):
        stop = np.searchsorted(size, size[i] / threshold + 1e-9, side="right")
        if stop > i + 1:
            both = np.bitwise_count(bits[i + 1 : stop] & bits[i]).sum(1, dtype=np.int64)
            hit = np.flatnonzero(both >= threshold * (size[i] + size[i + 1 : stop] - both) - 1e-9) + i + 1
            left.append(np.full(len(hit), i))
            right.append(hit)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return order[np.concatenate(left)], order[np.concatenate(right)]


def _verified(threshold: float, n_gram: int):
    """(c, root, links): per class of a block pair, the documents of classes it is linked to, and a star of the links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ("component", "_b1", "_b2")):
            n = group.num_rows
            if n < 2:
                continue
            block = group.column("_b").to_numpy()
            c, copies = group.column("c").to_numpy(), group.column("n").to_numpy()
            texts = [t.encode() for t in group.column("text").to_pylist()]
            grams, owner, _, _ = shingles(texts, n_gram)
            cuts = np.searchsorted(owner, np.arange(n + 1))
            i, j = linked_pairs([np.unique(grams[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], threshold)
            if of_two_blocks(group):
                once = block[i] != block[j]
                i, j = i[once], j[once]
            if len(i):
                links = np.bincount(i, copies[j], minlength=n) + np.bincount(j, copies[i], minlength=n)
                root = local_roots(n, i, j)
                hit = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[hit]), pa.array(c[root[hit]]), pa.array(links[hit].astype(np.int64))], ["c", "root", "links"]
                )

    return run


def join(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, target: float = TARGET_RECALL) -> DataFrame:
    """(id, class_id, n_links) for each row of `docs` (id, text; other columns are not read).

    n_links: other rows whose Jaccard similarity is at least `threshold`, copies included. class_id: the
    smallest id reachable by links, its own if there is none. Words are runs without blank, tab and
    line ends, taken as they are. Null and empty texts have no shingle and no link; texts of fewer than n
    words link with their copies only. Repeated rows count as copies; null ids come last in a class. An
    empty table gives an empty one.
    """
    depth = forest_depth(threshold, TREES, target)
    texts = docs.select("id", "text")
    schema = "id {}, k1 long, k2 long, words long, codes array<long>, sketch binary".format(
        docs.schema["id"].dataType.simpleString()
    )
    signed = materialise(texts.mapInArrow(_signed(depth, n), schema), "signed")
    classes = signed.where("words > 0").groupBy("k1", "k2").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.max("words").alias("words"),
        F.first("codes").alias("codes"), F.first("sketch").alias("sketch"),
    )
    classes = materialise(classes.withColumn("c", F.monotonically_increasing_id()), "classes")

    leaves = classes.where(F.col("words") >= n).select("c", F.posexplode("codes").alias("tree", "code"))
    buckets = leaves.groupBy("tree", "code").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    buckets = materialise(buckets, "buckets")  # plain inputs let the join's partition of a hot bucket be split
    members = (
        leaves.join(buckets, ["tree", "code"])
        .withColumn("blocks", F.ceil(F.col("m") / BLOCK_CLASSES)).drop("m")
        .join(classes.select("c", "sketch"), "c")
    )
    places = TREES * MAX_DEPTH
    least = threshold - DEVIATIONS * float(np.sqrt(threshold * (1 - threshold) / places))
    star = in_blocks(members, ["tree", "code"], "c", "blocks").mapInArrow(_tied(least), "u long, v long")
    near = components(star).withColumnRenamed("id", "c")

    chosen = near.join(classes.select("c", "k1", "k2", "rep", "n", "words"), "c")
    heft = near.join(classes.select("c", "words"), "c").groupBy("component").agg(
        F.greatest(
            F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES), F.least(F.count(F.lit(1)), F.ceil(F.sum("words") / BLOCK_WORDS))
        ).alias("blocks")
    )
    chosen = materialise(chosen.join(heft, "component"), "chosen")
    keyed = signed.select("id", "k1", "k2").join(
        chosen, ["k1", "k2"]
    ).where(F.col("id").eqNullSafe(F.col("rep"))).select("id", "c", "component", "blocks", "n", "k1", "k2").dropDuplicates(["c"])
    wanted = keyed.withColumnRenamed("id", "w_id")
    found = texts.join(wanted, F.col("id").eqNullSafe(F.col("w_id"))).select("c", "component", "blocks", "n", "text", "k1", "k2")
    found = _own_text(found, n)
    checked = materialise(
        in_blocks(found, ["component"], "c", "blocks").mapInArrow(_verified(threshold, n), "c long, root long, links long"),
        "checked",
    )
    linked = checked.groupBy("c").agg(F.sum("links").alias("links"))
    groups = components(checked.select(F.col("c").alias("u"), F.col("root").alias("v"))).withColumnRenamed("id", "c")
    named = classes.select("c", "k1", "k2", "rep", "n").join(groups, "c", "left").withColumn(
        "component", F.coalesce("component", "c")
    )
    names = named.groupBy("component").agg(F.min("rep").alias("class_id"))
    labels = named.join(names, "component").join(linked, "c", "left").select(
        "k1", "k2", "class_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    some = signed.where("words > 0").select("id", "k1", "k2").join(labels, ["k1", "k2"]).select("id", "class_id", "n_links")
    none = signed.where("words = 0").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return some.unionByName(none)


def _own_text(found: DataFrame, n: int) -> DataFrame:
    """Rows whose text has the class's words (ids may repeat), one per class."""
    columns = ["c", "component", "blocks", "n", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                texts = [(t or "").encode() for t in part.column("text").to_pylist()]
                hashes, first, _ = word_hashes(texts)
                same = np.ones(len(texts), bool)
                for lane, k in enumerate(("k1", "k2")):
                    same &= Runs(hashes, lane).of(first[:-1], first[1:]).view(np.int64) == part.column(k).to_numpy()
                yield part.select(columns).filter(pa.array(same))

    return found.mapInArrow(run, found.select(*columns).schema).dropDuplicates(["c"])
