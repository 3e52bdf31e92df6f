"""Periodic runs of words: maximal stretches that repeat with a smallest period, found by tiles per period octave.

Octave k holds the periods 2**k to 2**(k+1) - 1. Its anchors are the word numbers divisible by 2**k: a run of such a
period has an anchor c with c and c + period inside. A text is exploded into overlapping tiles per octave (the low
octaves share one scale), whose margins hold two periods on either side of their anchors. A tile is solved alone: for
each anchor c its boundary Z-functions, the lengths for which the words from c on equal those from c + q on, and
backwards, give the interval of period q around it, cut off at the tile's ends. The intervals are shuffled by
(document, period) and stitched: fragments of one run overlap by at least a period, different runs by less. Of
equal intervals the smallest period stays.

Z values are computed for all anchors and periods of an octave at once: equal words first, then half a period by
prefix hashes, then the full length by doubling steps; every interval is compared word by word at the end. A text of
up to `core` words is one tile of every octave and is solved where it is read; tiles of longer texts are dealt over
the cluster as rows. So the work is n log n words, and no task holds more than one text or a bounded number of tiles.

Defined cases. Null and empty texts have no words and no runs. Texts of any length are read whole. Repeated rows are
documents of their own. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialise, slices
from millrace.llm.words import Runs, word_hashes

CORE = 16_384
MIN_LENGTH = 12
SLICE_BYTES = 4 << 20
_PAIRS = 1 << 22

_TILE = "struct<first:long,anchor_lo:long,anchor_hi:long,k_lo:int,k_hi:int,codes:binary>"
_SCAN = (
    "row long, id long, n_words long, whole_sha256 string, text string, "
    f"fragments array<struct<period:long,start:long,stop:long>>, tiles array<{_TILE}>"
)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner of each item, and its number within the owner."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


class Tiles:
    """Tiles as one array of word codes. Positions are places in it; tile t holds the words lo[t] to hi[t] - 1.

    first: word number of a tile's first word; anchors are multiples of the octave between anchor_lo and anchor_hi.
    """

    def __init__(self, codes, lo, hi, first, anchor_lo, anchor_hi, k_lo, k_hi, min_length=MIN_LENGTH):
        self.codes, self.lo, self.hi, self.first = codes, lo, hi, first
        self.anchor_lo, self.anchor_hi, self.k_lo, self.k_hi = anchor_lo, anchor_hi, k_lo, k_hi
        self.min_length = min_length
        self.hashes = Runs(codes)
        # Of the known run around a place that ends last: its end and period. What it explains is not measured again.
        self.known_stop, self.known_period = np.zeros(len(codes), np.int64), np.ones(len(codes), np.int64)

    def same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.hashes.of(a, a + n) == self.hashes.of(b, b + n)

    def boundary_z(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
        """Length up to `limit` on which words from a and b on are equal (step 1), or words before them (step -1)."""
        z = np.zeros(len(a), np.int64)
        if not len(a):
            return z
        size = 1 << int(limit.max()).bit_length()
        while size:
            todo = np.flatnonzero(z + size <= limit)
            at = z[todo] if step > 0 else -z[todo] - size
            equal = self.same(a[todo] + at, b[todo] + at, np.full(len(todo), size))
            z[todo[equal]] += size
            size >>= 1
        return z

    def anchors(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Tile and place of each anchor of octave k."""
        active = np.flatnonzero((self.k_lo <= k) & (k <= self.k_hi))
        low = -(-self.anchor_lo[active] >> k)
        high = -(-self.anchor_hi[active] >> k)
        owner, number = _spread(np.maximum(high - low, 0))
        tile = active[owner]
        return tile, ((low[owner] + number) << k) - self.first[tile] + self.lo[tile]

    def octave(self, k: int) -> np.ndarray:
        """Rows (tile, start, stop, period) of octave k: places, each interval once with its smallest period here."""
        tile, c = self.anchors(k)
        size, found = 1 << k, []
        for at in range(0, len(c), max(1, _PAIRS >> k)):
            t, a = tile[at : at + max(1, _PAIRS >> k)], c[at : at + max(1, _PAIRS >> k)]
            beside = np.minimum(a[:, None] + np.arange(size, 2 * size), len(self.codes) - 1)
            i, j = np.nonzero(self.codes[beside] == self.codes[a][:, None])
            t, a, q = t[i], a[i], j + size
            explained = (a + q < self.known_stop[a]) & (q % self.known_period[a] == 0)
            keep = (a + q < self.hi[t]) & ~explained
            found.append(self.measured(t[keep], a[keep], q[keep]))
        return self.distinct(np.concatenate(found)) if found else np.zeros((0, 4), np.int64)

    def measured(self, t: np.ndarray, a: np.ndarray, q: np.ndarray) -> np.ndarray:
        need = np.maximum(q, self.min_length - q)
        half = (need + 1) // 2
        ahead, behind = a + q + half <= self.hi[t], a - half >= self.lo[t]
        ahead[ahead] = self.same(a[ahead], a[ahead] + q[ahead], half[ahead])
        behind[behind] = self.same(a[behind] - half[behind], a[behind] + q[behind] - half[behind], half[behind])
        some = ahead | behind
        t, a, q, need = t[some], a[some], q[some], need[some]
        forward = self.boundary_z(a, a + q, self.hi[t] - a - q, 1)
        back = self.boundary_z(a, a + q, a - self.lo[t], -1)
        long_enough = forward + back >= need
        return np.stack([t, a - back, a + q + forward, q], axis=1)[long_enough]

    def distinct(self, rows: np.ndarray) -> np.ndarray:
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
        return rows[fresh]

    def compared(self, rows: np.ndarray) -> np.ndarray:
        """Whether the words of each interval repeat with its period and the words beside it don't."""
        t, start, stop, q = rows.T
        owner, number = _spread(stop - start - q)
        place = start[owner] + number
        differs = np.bincount(owner[self.codes[place] != self.codes[place + q[owner]]], minlength=len(rows)) > 0
        edge = len(self.codes) - 1
        left = (start > self.lo[t]) & (self.codes[np.maximum(start - 1, 0)] == self.codes[np.minimum(start - 1 + q, edge)])
        right = (stop < self.hi[t]) & (self.codes[np.minimum(stop, edge)] == self.codes[stop - q])
        return ~(differs | left | right)

    def fragments(self) -> np.ndarray:
        """Rows (tile, start, stop, period), word numbers."""
        out = [np.zeros((0, 4), np.int64)]
        for k in range(int(self.k_lo.min(initial=0)), int(self.k_hi.max(initial=-1)) + 1):
            rows = self.octave(k)
            if not len(rows):
                continue
            if not self.compared(rows).all():
                raise ArithmeticError("two different runs of words have one hash")
            out.append(rows)
            rows = rows[np.argsort(rows[:, 2], kind="stable")]
            owner, number = _spread(rows[:, 2] - rows[:, 1])
            place = rows[owner, 1] + number
            later = rows[owner, 2] > self.known_stop[place]
            self.known_stop[place[later]], self.known_period[place[later]] = rows[owner[later], 2], rows[owner[later], 3]
        rows = self.distinct(np.concatenate(out))
        shift = self.first[rows[:, 0]] - self.lo[rows[:, 0]]
        return np.stack([rows[:, 0], rows[:, 1] + shift, rows[:, 2] + shift, rows[:, 3]], axis=1)


def _octaves(n: int) -> int:
    """Largest k of a period up to n / 2; -1 if there is none."""
    return (n // 2).bit_length() - 1


def tile_plan(n: int, core: int) -> list[tuple[int, int, int, int, int, int]]:
    """(first, stop, anchor_lo, anchor_hi, k_lo, k_hi) of each tile of a text of n words."""
    last = _octaves(n)
    base = max(0, (core // 16).bit_length() - 1)
    scales = [(0, min(base, last), core)] + [(k, k, 16 << k) for k in range(base + 1, last + 1)]
    out = []
    for k_lo, k_hi, step in scales:
        size = 1 << k_hi
        for at in range(0, n, step):
            first, stop = max(0, at - 2 * size), min(n, at + step + 4 * size)
            out.append((first, stop, at, min(n, at + step), k_lo, k_hi))
            if first == 0 and stop == n and at + step >= n:
                break
    return out


def _scan(batches: Iterator[pa.RecordBatch], core: int, min_length: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", SLICE_BYTES):
            yield _scanned(batch, core, min_length)


def _scanned(batch: pa.RecordBatch, core: int, min_length: int) -> pa.RecordBatch:
    texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column("text").cast(pa.binary())]
    codes, first, _ = word_hashes(texts)
    n = np.diff(first)
    here = np.flatnonzero(n <= core)
    octaves = np.array([_octaves(int(x)) for x in n[here]], np.int64)
    zero = np.zeros(len(here), np.int64)
    tiles = Tiles(codes, first[here], first[here + 1], zero, zero, n[here], zero, octaves, min_length)
    fragments: list[list] = [[] for _ in texts]
    for t, start, stop, period in tiles.fragments().tolist():
        fragments[here[t]].append({"period": period, "start": start, "stop": stop})
    dealt: list[list] = [[] for _ in texts]
    for d in np.flatnonzero(n > core).tolist():
        _, dense = np.unique(codes[first[d] : first[d + 1]], return_inverse=True)
        dense = dense.astype(np.int32)
        for lo, hi, anchor_lo, anchor_hi, k_lo, k_hi in tile_plan(int(n[d]), core):
            dealt[d].append({"first": lo, "anchor_lo": anchor_lo, "anchor_hi": anchor_hi, "k_lo": k_lo, "k_hi": k_hi, "codes": dense[lo:hi].tobytes()})
    kept = [t.decode() if fragments[d] or dealt[d] else None for d, t in enumerate(texts)]
    tile = pa.struct([("first", pa.int64()), ("anchor_lo", pa.int64()), ("anchor_hi", pa.int64()), ("k_lo", pa.int32()), ("k_hi", pa.int32()), ("codes", pa.binary())])
    fragment = pa.struct([("period", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])
    return pa.RecordBatch.from_pydict({
        "row": batch.column("row"), "id": batch.column("id"), "n_words": pa.array(n),
        "whole_sha256": pa.array([hashlib.sha256(b" ".join(t.split())).hexdigest() for t in texts]), "text": pa.array(kept, pa.string()),
        "fragments": pa.array(fragments, pa.list_(fragment)), "tiles": pa.array(dealt, pa.list_(tile)),
    })


def _solved(batches: Iterator[pa.RecordBatch], min_length: int) -> Iterator[pa.RecordBatch]:
    """(row, period, start, stop) of tile rows, one tile at a time."""
    for batch in batches:
        for tile in batch.to_pylist():
            codes = np.frombuffer(tile["codes"], np.int32).astype(np.uint64)
            one = {c: np.array([tile[c]], np.int64) for c in ("first", "anchor_lo", "anchor_hi", "k_lo", "k_hi")}
            found = Tiles(codes, np.array([0]), np.array([len(codes)]), **one, min_length=min_length).fragments()
            yield pa.RecordBatch.from_pydict({
                "row": np.full(len(found), tile["row"]), "period": found[:, 3], "start": found[:, 1], "stop": found[:, 2]})


def scan(docs: DataFrame, core: int = CORE, min_length: int = MIN_LENGTH) -> DataFrame:
    """One stored row per row of (id, text): fragments of texts of one tile, or the tiles of longer ones.

    Texts are kept where a run may be, so that others are never read or moved again.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return materialise(rows.mapInArrow(partial(_scan, core=core, min_length=min_length), _SCAN), "period_scan")


def stitched(fragments: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(row, start, stop, period) of the runs that (row, period, start, stop) are fragments of."""
    before = Window.partitionBy("row", "period").orderBy("start", "stop")
    reached = F.max("stop").over(before.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.coalesce(F.col("start") > reached - F.col("period"), F.lit(True)).cast("int")
    parts = fragments.withColumn("_new", starts).withColumn("_run", F.sum("_new").over(before))
    runs = parts.groupBy("row", "period", "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    least = runs.groupBy("row", "start", "stop").agg(F.min("period").alias("period"))
    return least.where(F.col("stop") - F.col("start") >= F.greatest(F.lit(min_length), 2 * F.col("period")))


def runs(scanned: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(row, start, stop, period) of all runs of a scan; tiles are dealt over the cluster, a row each."""
    here = scanned.select("row", F.inline("fragments"))
    tiles = scanned.select("row", F.inline("tiles")).repartition("row", "k_lo", "first")
    dealt = tiles.mapInArrow(partial(_solved, min_length=min_length), "row long, period long, start long, stop long")
    return stitched(here.select("row", "period", "start", "stop").unionByName(dealt), min_length)


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without what their runs repeat: words of a run after its first period go."""
    for whole in batches:
        for batch in slices(whole, "text", SLICE_BYTES):
            texts = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
                if not found:
                    texts.append(None)
                    continue
                words = text.encode().split()
                depth = np.zeros(len(words) + 1, np.int64)
                np.add.at(depth, [r["start"] + r["period"] for r in found], 1)
                np.add.at(depth, [r["start"] + r["length"] for r in found], -1)
                texts.append(b" ".join([words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]))
            digests = [old if t is None else hashlib.sha256(t).hexdigest() for t, old in zip(texts, batch.column("whole_sha256").to_pylist())]
            columns = {c: batch.column(c) for c in ("row", "id", "n_words", "runs")}
            yield pa.RecordBatch.from_pydict({
                **columns, "collapsed": pa.array([None if t is None else t.decode() for t in texts], pa.string()), "collapsed_sha256": pa.array(digests)})


def with_runs(docs: DataFrame, core: int = CORE, min_length: int = MIN_LENGTH) -> DataFrame:
    """(row, id, n_words, runs, collapsed, collapsed_sha256) of all rows of (id, text).

    runs: array of (start, length, period) by start, then period. collapsed: the kept words joined by one space, null
    if the text has no runs (then the digest is of all its words).
    """
    scanned = scan(docs, core, min_length)
    run = F.struct("start", (F.col("stop") - F.col("start")).alias("length"), "period")
    by_row = runs(scanned, min_length).groupBy("row").agg(F.array_sort(F.collect_list(run)).alias("runs"))
    order = F.array_sort(F.transform(F.col("runs"), lambda r: F.struct(r["start"], r["period"], r["length"])))
    by_row = by_row.select("row", F.transform(order, lambda r: F.struct(r["start"], r["length"], r["period"])).alias("runs"))
    joined = scanned.select("row", "id", "n_words", "whole_sha256", "text").join(by_row, "row", "left")
    schema = "row long, id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string, collapsed_sha256 string"
    none = F.array().cast("array<struct<start:long,length:long,period:long>>")
    return joined.withColumn("runs", F.coalesce("runs", none)).mapInArrow(_collapse, schema)


def longest(found: Column) -> Column:
    """The longest of an array of runs; ties: smallest start, then period; null if there is none."""
    least = F.array_min(F.transform(found, lambda r: F.struct((-r["length"]).alias("m"), r["start"].alias("start"), r["period"].alias("period"))))
    return F.when(F.size(found) > 0, F.struct(least["start"].alias("start"), (-least["m"]).alias("length"), least["period"].alias("period")))
