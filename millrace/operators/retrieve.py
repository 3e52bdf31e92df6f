"""Batch retrieval: all questions of a table in one job.

Stages: probes per question -> nearest rows -> window fallback -> pooling over stations ->
optional lexical fusion -> time dedup -> top k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.columns import micros
from millrace.operators import ann, knn, lexical
from millrace.operators.questions import FILTERED, VECTOR, checked_mode, parse_questions
from millrace.session import materialise

# Over-fetch before dedup, and the dedup window.
OVERFETCH = 4
DEDUP_S = 10
TOP_K = 5
HIT_FIELDS = ("station", "start_ts", "current_task")
Texts = lexical.TextIndex | None


def _probe(questions: DataFrame, station: Column, lim: Column, bounded: bool) -> DataFrame:
    null_us = F.lit(None).cast("bigint")
    return questions.select(
        F.concat_ws("#", "question_id", station).alias("probe_id"),
        "question_id",
        station.alias("station"),
        (micros("window_lo") if bounded else null_us).alias("lo_us"),
        (micros("window_hi") if bounded else null_us).alias("hi_us"),
        lim.cast("int").alias("lim"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )


def vector_probes(questions: DataFrame, k: int = TOP_K) -> DataFrame:
    return _probe(questions, F.lit(None).cast("string"), F.lit(k * OVERFETCH), False)


def station_probes(parsed: DataFrame, k: int = TOP_K) -> DataFrame:
    """One probe per named station; several stations share the fetch, at least two each."""
    n = F.size("stations")
    lim = F.when(n == 1, F.lit(k * OVERFETCH)).otherwise(
        F.greatest(F.lit(2), F.floor(F.lit(k) / n) + 1) * OVERFETCH
    )
    each = parsed.where(n > 0).withColumn("_lim", lim).withColumn("_st", F.explode("stations"))
    return _probe(each, F.col("_st"), F.col("_lim"), True)


def nearest(index: DataFrame, probes: DataFrame, k: int = TOP_K, fallback: bool = True) -> DataFrame:
    """Ranked rows per probe; a probe whose window is empty falls back to its whole station.

    `index` is an index table or a stored layout (`knn.store`), whose folders are pruned. Windows are searched by key
    first; only probes without a window, or with an empty one, go through the tiles.
    """
    vectors, probes = index if "unit" in index.columns else materialise(knn.laid_out(index), "layout"), materialise(probes, "probes")
    windowed = F.col("lo_us").isNotNull() & F.col("hi_us").isNotNull()
    inside = materialise(knn.window_hits(vectors, probes), "window_hits")
    empty = probes.where(windowed).join(inside.select("probe_id").distinct(), "probe_id", "left_anti")
    rest = probes.where(~windowed).unionByName(empty) if fallback else probes.where(~windowed)
    found = knn.tile_best(vectors, rest.select("probe_id", F.col("station").alias("key"), "lim", "embedding"))
    return _ranked(inside, probes, True).unionByName(_ranked(found, probes, False))


def _ranked(hits: DataFrame, probes: DataFrame, in_window: bool) -> DataFrame:
    """`hits` (probe_id, event_id, score) with the question of their probe; rows of a repeated probe count each time."""
    info = probes.select("probe_id", "question_id", "lim")
    ranked = knn.best(hits.select("probe_id", "event_id", "score").join(info, "probe_id"), F.col("lim"))
    return ranked.select("question_id", "probe_id", "event_id", "score", "probe_rank", F.lit(in_window).alias("in_window"))


def pool(hits: DataFrame) -> DataFrame:
    """One row per (question, event) with its best score, ranked by score."""
    pooled = hits.groupBy("question_id", "event_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("question_id").orderBy(F.col("score").desc(), "event_id")
    return pooled.withColumn("rank", F.row_number().over(w))


def with_fields(hits: DataFrame, index: DataFrame, fields: tuple[str, ...] = HIT_FIELDS) -> DataFrame:
    """Index columns of the hits. The hits are few, so the index is scanned, not shuffled."""
    return hits.join(index.select("event_id", *fields), "event_id")


def time_dedup(hits: DataFrame, k: int = TOP_K, window_s: float = DEDUP_S) -> DataFrame:
    """Walk each question's hits by rank; drop one that repeats a kept hit of the same station
    and task within the window; stop at k.

    The list per question is bounded by the over-fetch, so the fold is a short array expression.
    """
    extra = [c for c in ("bm25", "rrf_score") if c in hits.columns]
    fields = ["event_id", "score", *HIT_FIELDS, *extra]
    return _walked(_lists(hits, "rank", *fields).select("question_id", F.sort_array("_hits").alias("_hits")), fields, k, window_s)


def _lists(hits: DataFrame, *fields: str) -> DataFrame:
    """(question_id, _hits): the hits of each question. They are moved first: lists of single hits are no smaller than hits."""
    return hits.repartition("question_id").groupBy("question_id").agg(F.collect_list(F.struct(*fields)).alias("_hits"))


def _walked(lists: DataFrame, fields: list[str], k: int, window_s: float) -> DataFrame:
    """What `time_dedup` keeps of lists in rank order, with their other columns."""
    gap = int(window_s * 1_000_000)

    def step(kept: Column, h: Column) -> Column:
        repeats = F.exists(
            kept,
            lambda x: x["station"].eqNullSafe(h["station"])
            & (F.coalesce(x["current_task"], F.lit("")) == F.coalesce(h["current_task"], F.lit("")))
            & (F.abs(micros(x["start_ts"]) - micros(h["start_ts"])) <= gap),
        )
        return F.when((F.size(kept) >= k) | F.coalesce(repeats, F.lit(False)), kept).otherwise(
            F.concat(kept, F.array(h))
        )

    kept = F.aggregate("_hits", F.slice("_hits", 1, 0), step)
    names = [c for c in lists.columns if c != "_hits"]
    return lists.select(*names, F.posexplode(kept).alias("_pos", "_hit")).select(
        *names, (F.col("_pos") + 1).alias("rank"), *[F.col(f"_hit.{c}").alias(c) for c in fields]
    )


def _finish(
    pooled: DataFrame, questions: DataFrame, index: DataFrame, k: int, rerank: bool, window_s: float, texts: Texts
) -> DataFrame:
    """texts: the stored text index of the hits; without one it is built for this call."""
    if rerank:
        pooled = lexical.fuse(lexical.score_hits(pooled, questions, texts or index))
    return time_dedup(with_fields(pooled, index), k, window_s)


def retrieve_vector(
    questions: DataFrame, index: DataFrame, k: int = TOP_K, rerank: bool = False,
    dedup_s: float = DEDUP_S, texts: Texts = None,
) -> DataFrame:
    hits = nearest(index, vector_probes(questions, k), k)
    return _finish(pool(hits), questions, index, k, rerank, dedup_s, texts)


def filtered_candidates(parsed: DataFrame, index: DataFrame, k: int = TOP_K) -> DataFrame:
    """Pooled candidates of the filtered mode; questions without a station search everything."""
    probes = station_probes(parsed, k).unionByName(
        vector_probes(parsed.where(F.size("stations") == 0), k)
    )
    return pool(nearest(index, probes, k))


def retrieve_filtered(
    questions: DataFrame, index: DataFrame, k: int = TOP_K, rerank: bool = False,
    window_s: int = 5, dedup_s: float = DEDUP_S, texts: Texts = None,
) -> DataFrame:
    parsed = parse_questions(questions, window_s)
    return _finish(filtered_candidates(parsed, index, k), questions, index, k, rerank, dedup_s, texts)


def filter_counts(parsed: DataFrame, index: DataFrame, bucket_s: int = 600) -> DataFrame:
    """(question_id, station, n): index rows that pass the station filter and, if the question has
    a window, the time filter.

    Without a window the answer is the size of the station. With one, buckets that lie inside the
    window count through their totals and only the two outer buckets are compared row by row,
    so no list of (question, row) pairs of a station is built.
    """
    w = bucket_s * 1_000_000
    asked = parsed.select(
        "question_id", F.explode("stations").alias("station"),
        micros("window_lo").alias("_lo"), micros("window_hi").alias("_hi"),
    )
    rows = index.select("station", micros("start_ts").alias("_at")).groupBy("station", "_at").agg(
        F.count(F.lit(1)).alias("_n")
    ).withColumn("_bucket", F.floor(F.col("_at") / w))
    totals = rows.groupBy("station").agg(F.sum("_n").alias("n"))
    free = asked.where("_lo is null").join(totals, "station", "left").select(
        "question_id", "station", F.coalesce("n", F.lit(0)).alias("n")
    )
    bounded = asked.where("_lo is not null")
    touched = bounded.withColumn(
        "_bucket", F.explode(F.sequence(F.floor(F.col("_lo") / w), F.floor(F.col("_hi") / w)))
    )
    whole = (F.col("_bucket") * w >= F.col("_lo")) & (F.col("_bucket") * w + (w - 1) <= F.col("_hi"))
    full = touched.where(whole).join(
        rows.groupBy("station", "_bucket").agg(F.sum("_n").alias("_n")), ["station", "_bucket"]
    )
    part = touched.where(~whole).join(rows, ["station", "_bucket"]).where(
        "_at >= _lo and _at <= _hi"
    )
    inside = full.select("question_id", "station", "_n").unionByName(
        part.select("question_id", "station", "_n")
    ).groupBy("question_id", "station").agg(F.sum("_n").alias("n"))
    return free.unionByName(
        bounded.join(inside, ["question_id", "station"], "left").select(
            "question_id", "station", F.coalesce("n", F.lit(0)).alias("n")
        )
    )


def route_by_mode(
    questions: DataFrame, index: DataFrame, k: int = TOP_K, window_s: int = 5,
    dedup_s: float = DEDUP_S, rerank: bool = False, texts: Texts = None,
) -> DataFrame:
    """Questions carry a `mode`; the answerless mode retrieves nothing, an unknown mode fails.

    Both searches run as probes of one pass over the index; with `rerank` both pass through the fusion.
    """
    parsed = parse_questions(questions, window_s).withColumn("mode", checked_mode(F.col("mode")))
    plain = (F.col("mode") == VECTOR) | (
        (F.col("mode") == FILTERED) & (F.size("stations") == 0)
    )
    probes = station_probes(parsed.where(F.col("mode") == FILTERED), k).unionByName(
        vector_probes(parsed.where(plain), k)
    )
    return _finish(pool(nearest(index, probes, k)), questions, index, k, rerank, dedup_s, texts)


CONFIGS = (
    ("vetorial", False, False), ("vetorial+BM25", False, True),
    ("filtrado", True, False), ("filtrado+BM25", True, True),
)


# Name of a search that stands for both.
BOTH = "ambas"


def ablation_hits(
    questions: DataFrame, index: DataFrame, k: int = TOP_K, window_s: int = 5,
    dedup_s: float = DEDUP_S, texts: Texts = None,
) -> DataFrame:
    """Hits of the four configurations: two candidate searches, each used with and without fusion.

    Candidates of both searches come from one pass: the question id carries the search name.
    """
    parsed = parse_questions(questions, window_s)
    # Where no question of an id names a station, both searches ask the same: it is asked once, under the name BOTH.
    same = parsed.groupBy("question_id").agg(F.bool_and(F.coalesce(F.size("stations") == 0, F.lit(False))).alias("_same"))
    parsed = materialise(parsed.join(same, "question_id", "left"), "parsed")
    alike = F.coalesce("_same", F.lit(False))
    named = lambda df, name: df.withColumn(
        "question_id", F.concat(F.lit(f"{name}|"), "question_id")
    )
    once, apart = named(parsed.where(alike), BOTH), parsed.where(~alike)
    plain, filtered = named(apart, "vetorial"), named(apart, "filtrado")
    probes = (
        vector_probes(once.unionByName(plain).unionByName(filtered.where(F.size("stations") == 0)), k)
        .unionByName(station_probes(filtered, k))
    )
    pooled = pool(nearest(index, probes, k))
    asked = once.unionByName(plain).unionByName(filtered)
    # A candidate is scored, gets its index columns and is moved once; both rankings are read from its question's list.
    fused = with_fields(lexical.fuse(lexical.score_hits(pooled, asked, texts or index)), index)
    fields = ["event_id", "score", *HIT_FIELDS]
    by = lambda rank: F.sort_array(
        F.transform("_hits", lambda h: F.struct(h[rank].alias("rank"), *[h[c].alias(c) for c in fields]))
    )
    rankings = F.array(*[F.struct(F.lit(mark).alias("_mark"), by(rank).alias("_hits")) for mark, rank in (("", "dense_rank"), ("+BM25", "rank"))])
    kept = _walked(_lists(fused, "dense_rank", "rank", *fields).select("question_id", F.inline(rankings)), fields, k, dedup_s)
    parts = F.split("question_id", r"\|")
    search = F.element_at(parts, 1)
    names = F.when(search == BOTH, F.array(F.lit("vetorial"), F.lit("filtrado"))).otherwise(F.array(search))
    return kept.withColumn("_search", F.explode(names)).withColumn("config", F.concat("_search", "_mark")).withColumn(
        "question_id", F.element_at(parts, 2)
    ).drop("_search", "_mark")


def assign_lists(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """(event_id, list_id, unit) of a layout's rows: the nearest of the given centroids (list_id, centroid)."""
    placed = ann.nearest_cells(vectors.select("event_id", F.lit("").alias("key"), "unit"), _cells(centroids))
    return placed.select("event_id", F.col("cells")[0].alias("list_id"), "unit")


def _cells(centroids: DataFrame) -> DataFrame:
    return centroids.select(F.lit("").alias("key"), F.col("list_id").cast("int").alias("cell"), knn.unit(F.col("centroid")).alias("centroid"))


def mean_centroids(vectors: DataFrame, group: str) -> DataFrame:
    """Mean vector per group: the partial sums are one row per (group, dimension) and task."""
    dims = vectors.select(group, F.posexplode("embedding").alias("_d", "_x"))
    means = dims.groupBy(group, "_d").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return means.groupBy(group).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("_d", "_m"))), lambda p: F.round(p["_m"], 12)
        ).alias("centroid")
    ).withColumnRenamed(group, "list_id")


def ann_search(
    questions: DataFrame, index: DataFrame, centroids: DataFrame, nprobe: int, k: int
) -> DataFrame:
    """Approximate search over given centroids: only rows of the probed lists are scored.

    An index that is trained, stored by list and reused is `ann.build`.
    """
    rows = materialise(assign_lists(knn.laid_out(index), centroids), "listed")
    probes = materialise(vector_probes(questions, k), "probes")
    probed = ann.nearest_cells(
        probes.select(F.col("probe_id").alias("event_id"), F.lit("").alias("key"), knn.unit(F.col("embedding")).alias("unit")),
        _cells(centroids), nprobe)
    keyed = probed.select(F.col("event_id").alias("probe_id"), F.explode(F.col("cells").cast("array<string>")).alias("key")).join(probes, "probe_id")
    found = knn.tile_best(rows, keyed.select("probe_id", "key", "lim", "embedding"), "list_id")
    return _ranked(found, probes, False)


def trained_search(questions: DataFrame, index: ann.ListIndex, nprobe: int, k: int) -> DataFrame:
    """The same against a trained index: only folders that some question probes are read."""
    probes = materialise(vector_probes(questions, k), "probes")
    return _ranked(index.search(probes, nprobe), probes, False)
