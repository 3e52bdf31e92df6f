"""Quality scores: random Fourier features, ridge by partition-summed normal equations, isotonic calibration.

1. Each whole text becomes a row of document statistics.
2. cos(W x + b) with Gaussian W approximates a Gaussian kernel over the standardised statistics.
3. Each partition sums z z', z y, y y of its labelled rows, by fold; the sums meet in one matrix of
   fixed size per fold, from which the ridge weights and the penalty come.
4. Out-of-fold scores are counted in SCORE_BINS bins; pool-adjacent-violators on these counts turns scores
   into shares of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fresh, materialise, slices
from millrace.llm.words import word_hashes

#: The model is fitted on at most about so many labelled rows, chosen by a hash of doc_id.
TRAIN_ROWS = 400_000
#: Partitions of the fit; each sends FOLDS matrices of FEATURES x FEATURES.
FIT_PARTITIONS = 16
FEATURES = 256
FOLDS = 4
SCORE_BINS = 2000
PENALTIES = (1e-4, 1e-3, 1e-2, 1e-1)
SEED = 20_240_607
#: A document is predicted good from this score on.
THRESHOLD = 0.3
BATCH_BYTES = 2 << 20

STATS = (
    "log_bytes", "log_words", "word_bytes", "distinct", "repeated", "upper", "digits", "blank", "line_ends",
    "stops", "shouts", "symbols", "bars", "foreign", "bare", "log_line_words", "long_words", "short_words", "entropy",
)


def _classes() -> np.ndarray:
    """Byte value by class: lower, upper, digit, blank, line end, stop, shout, symbol, bar, foreign."""
    groups = [
        b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\v\f", b"\n",
        b".,;:'\"()-", b"!?", b"#$%&*+/<=>@\\^_`~", b"|[]{}", bytes(range(128, 256)),
    ]
    out = np.zeros((256, len(groups)))
    for k, group in enumerate(groups):
        out[list(group), k] = 1
    return out


_CLASSES = _classes()
_LETTER = np.zeros(256, np.int64)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256), *range(48, 58)]] = 1


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of STATS per text; an empty text has zeros."""
    n = len(texts)
    bytes_ = np.array([len(t) for t in texts], float)
    histogram = np.stack([np.bincount(np.frombuffer(t, np.uint8), minlength=256) for t in texts])
    kinds = histogram @ _CLASSES
    size = np.maximum(bytes_, 1)[:, None]
    share = kinds / size
    p = histogram / size
    entropy = -(p * np.log2(p, out=np.zeros_like(p), where=p > 0)).sum(1)

    hashes, first, (starts, ends) = word_hashes(texts)
    words = np.diff(first).astype(float)
    owner = np.repeat(np.arange(n), np.diff(first))
    many = np.maximum(words, 1)
    lengths = ends - starts
    seen = np.sort((owner.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
    new = np.ones(len(seen), bool)
    new[1:] = seen[1:] != seen[:-1]
    distinct = np.bincount((seen[new] >> np.uint64(44)).astype(np.int64), minlength=n)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    bare = letters[ends] == letters[starts]

    def per_word(flag: np.ndarray) -> np.ndarray:
        return np.bincount(owner, flag, minlength=n) / many

    letter_count = np.maximum(kinds[:, 0] + kinds[:, 1], 1)
    return np.column_stack([
        np.log1p(bytes_), np.log1p(words), np.log1p(np.bincount(owner, lengths, minlength=n) / many),
        distinct / many, per_word(again), kinds[:, 1] / letter_count, share[:, 2], share[:, 3], share[:, 4],
        share[:, 5], share[:, 6], share[:, 7], share[:, 8], share[:, 9], per_word(bare),
        np.log1p(words / (kinds[:, 4] + 1)), per_word(lengths >= 20), per_word(lengths == 1), entropy,
    ])


def _texts(part: pa.RecordBatch, text: str) -> list[bytes]:
    return [(t or "").encode() for t in part.column(text).to_pylist()]


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, STATS...) of every whole text, stored once in the shared folder."""
    schema = docs.select("doc_id").withColumns({s: F.lit(0.0) for s in STATS}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                stats = statistics(_texts(part, "text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c) for c in stats.T)], ["doc_id", *STATS]
                )

    return materialise(docs.select("doc_id", "text").mapInArrow(run, schema), "stats")


def held_out(doc_id: Column) -> Column:
    """Rows no label is learned from; a null doc_id is one of them."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray  # raw scores
    values: np.ndarray  # calibrated scores at the knots

    @staticmethod
    def projection() -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(SEED)
        width = np.sqrt(len(STATS))  # of the kernel, in standard deviations
        return rng.normal(size=(len(STATS), FEATURES - 1)) / width, rng.uniform(0, 2 * np.pi, FEATURES - 1)

    @classmethod
    def features(cls, x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
        w, b = cls.projection()
        z = np.cos(np.clip((x - mean) / scale, -6, 6) @ w + b) * np.sqrt(2 / (FEATURES - 1))
        return np.column_stack([z, np.ones(len(x))])

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(x), 0.5)
        raw = self.features(x, self.mean, self.scale) @ self.weights
        return np.clip(np.interp(raw, self.knots, self.values), 0.0, 1.0)


def _sums(mean: np.ndarray, scale: np.ndarray):
    size = FEATURES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, size, size))
        for batch in batches:
            x = np.column_stack([batch.column(s).to_numpy(zero_copy_only=False) for s in STATS])
            y = batch.column("_y").to_numpy(zero_copy_only=False)
            fold = batch.column("_fold").to_numpy(zero_copy_only=False)
            z = np.column_stack([Model.features(x, mean, scale), y])
            for f in range(FOLDS):
                total[f] += z[fold == f].T @ z[fold == f]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(FOLDS), pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], ["fold", "sums"]
        )

    return run


def _add(key: tuple, rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b, float) for b in rows["sums"].to_pylist())
    return pa.table({"fold": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


def _ridge(sums: np.ndarray, penalty: float) -> np.ndarray:
    a, b = sums[:-1, :-1], sums[:-1, -1]
    n = max(sums[-2, -2], 1.0)  # the constant feature counts the rows
    shrink = np.full(len(a), penalty * n)
    shrink[-1] = 1e-9 * n
    return np.linalg.solve(a + np.diag(shrink), b)


def _loss(sums: np.ndarray, w: np.ndarray) -> float:
    return float(sums[-1, -1] - 2 * w @ sums[:-1, -1] + w @ sums[:-1, :-1] @ w)


def isotonic(count: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Non-decreasing share of positives by bin: neighbours that fall are pooled."""
    blocks: list[list[float]] = []
    for n, k in zip(count.tolist(), positive.tolist()):
        blocks.append([n, k, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n2, k2, m2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n2, blocks[-1][1] + k2, blocks[-1][2] + m2]
    return np.concatenate([np.full(int(m), k / n) for n, k, m in blocks]) if blocks else np.zeros(0)


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """A model of `labels` (doc_id, quality), learned from rows that are not held out.

    Labels that are null or belong to no document are left out, several labels of one document are
    averaged. Without any label the model scores everything 0.5.
    """
    truth = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.avg(F.col("quality").cast("double")).alias("_y")
    )
    rows = stats.join(truth, "doc_id")
    total = truth.count()
    empty = Model(np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0))
    if total > TRAIN_ROWS:
        grain = 1 << 20
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(grain)) < int(grain * TRAIN_ROWS / total))
    rows = rows.withColumn("_fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int"))
    rows = materialise(rows.repartition(FIT_PARTITIONS), "labelled")
    found = rows.agg(
        F.count(F.lit(1)), *[F.avg(s) for s in STATS], *[F.stddev_pop(s) for s in STATS]
    ).first()
    if not found[0]:
        return empty
    mean = np.array(found[1 : 1 + len(STATS)], float)
    scale = np.array(found[1 + len(STATS) :], float)
    scale[scale < 1e-9] = 1.0

    size = FEATURES + 1
    partial = rows.mapInArrow(_sums(mean, scale), "fold int, sums binary")
    summed = partial.groupBy("fold").applyInArrow(_add, "fold int, sums binary").collect()
    folds = np.zeros((FOLDS, size, size))
    for r in summed:
        folds[r["fold"]] = np.frombuffer(r["sums"], float).reshape(size, size)
    whole = folds.sum(0)
    penalty = min(PENALTIES, key=lambda p: sum(_loss(f, _ridge(whole - f, p)) for f in folds))
    apart = np.stack([_ridge(whole - f, penalty) for f in folds])
    weights = _ridge(whole, penalty)

    low, high = -0.5, 1.5

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, SCORE_BINS))
        for batch in batches:
            x = np.column_stack([batch.column(s).to_numpy(zero_copy_only=False) for s in STATS])
            fold = batch.column("_fold").to_numpy(zero_copy_only=False)
            raw = (Model.features(x, mean, scale) * apart[fold]).sum(1)
            place = np.clip((raw - low) / (high - low) * SCORE_BINS, 0, SCORE_BINS - 1).astype(np.int64)
            y = batch.column("_y").to_numpy(zero_copy_only=False)
            for k, v in enumerate((np.ones(len(y)), y, raw)):
                sums[k] += np.bincount(place, v, minlength=SCORE_BINS)
        used = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(s[used]) for s in sums)], ["bin", "n", "pos", "raw"])

    bins = (
        rows.mapInArrow(binned, "bin long, n double, pos double, raw double")
        .groupBy("bin").agg(F.sum("n"), F.sum("pos"), F.sum("raw")).orderBy("bin").collect()
    )
    n, positive, raw = (np.array([r[k] for r in bins], float) for k in (1, 2, 3))
    return Model(mean, scale, weights, raw / n, isotonic(n, positive))


def scored(stats: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """Rows of `document_statistics` with their score."""
    kept = [c for c in stats.columns if c not in STATS]
    schema = stats.select(*kept).withColumn(name, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(s).to_numpy(zero_copy_only=False) for s in STATS])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(model.scores(x))], [*kept, name])

    return stats.mapInArrow(run, schema)


def good_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` whose whole text scores at least `threshold`, with all their columns.

    Null and empty texts are scored like any other text (all statistics zero). Repeated rows get the
    same score, clashing columns are only passed on, an empty table stays empty.
    """
    (score,) = fresh(docs, "score")
    schema = docs.withColumn(score, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                scores = pa.array(model.scores(statistics(_texts(part, "text"))))
                yield pa.RecordBatch.from_arrays([*part.columns, scores], [*part.schema.names, score])

    return docs.mapInArrow(run, schema).where(F.col(score) >= threshold).drop(score)
