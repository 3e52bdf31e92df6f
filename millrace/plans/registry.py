"""Registered queries: every operator over whole tables, flattened to comparable columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.functions.columns import map_text, micros, ts_text
from millrace.operators import episodes as ep
from millrace.operators import golden as gs
from millrace.operators import index as ix
from millrace.operators import lexical as lx
from millrace.operators import metrics as mt
from millrace.operators import perturb as pt
from millrace.operators import prompts as pr
from millrace.operators import questions as qs
from millrace.operators import retrieve as rt
from millrace.operators import rules as ru
from millrace.operators import stats as st
from millrace.operators.intervals import activity_join
from millrace.operators.ordered import evenly_spaced, group_sizes
from millrace.plans import fixtures as fx
from millrace.session import materialise, scratch_path
from millrace.sources import results as rs
from millrace.sources import silver as sv
from millrace.streaming import incremental as inc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

REPLICATES = st.REPLICATES
SPACED = 20
QUOTA = 30
#: Columns of the comparison of runs.
COMPARED = ("key_fact_recall", "faithfulness", "factual_correctness", "verdict_correct")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(col: Column | str) -> Column:
    """Six digits by way of a decimal, so that both engines round the same number."""
    value = F.col(col) if isinstance(col, str) else col
    return F.round(value.cast("decimal(18,9)"), 6).cast("double")


def joined(col: Column | str) -> Column:
    return F.array_join(col, "|")


def _silver_view(df: DataFrame) -> DataFrame:
    return df.select(
        "id", "station", ts_text("event_timestamp").alias("event_timestamp"), "current_state",
        "current_task", "current_task_duration", "current_sub_task",
        map_text(F.col("sensors")).alias("sensors"), "split",
    )


def _silver(s: SparkSession, d: str) -> DataFrame:
    return sv.parse(fx.bronze_lines(s, d))


def _log(s: SparkSession, d: str) -> DataFrame:
    """The machine log as accepted rows (no broken lines)."""
    return fx.factory_events(s, d)


# A. Scans, sources, sinks

@query
def silver_parse(s, d):
    return _silver_view(_silver(s, d))


@query
def silver_rejects(s, d):
    return sv.rejected(sv.classified(fx.bronze_lines(s, d)))


@query
def silver_dedup(s, d):
    return _silver_view(sv.dedup(_silver(s, d)))


@query
def ingest_counts(s, d):
    return sv.ingest_counts(_silver(s, d)).withColumn("split", F.coalesce("split", F.lit("all")))


@query
def split_tagged_union(s, d):
    lines = fx.bronze_lines(s, d)
    paths = {}
    for split in sv.SPLITS:
        paths[split] = scratch_path(s, f"log-{split}")
        lines.where(F.col("split") == split).select("value").write.text(paths[split])
    return sv.read_logs(s, paths)


@query
def silver_export(s, d):
    path = scratch_path(s, "silver")
    sv.export_silver(sv.dedup(_silver(s, d)), path)
    return _silver_view(s.read.parquet(path))


@query
def gold_rebuild(s, d):
    path = scratch_path(s, "gold-table")
    rows = fx.gold(s, d)
    sv.rebuild_gold(rows.unionByName(rows), path)
    return s.read.parquet(path).select("episode_id", "station", "n_events", "duration_s", "text")


@query
def index_table(s, d):
    path = scratch_path(s, "index")
    ix.write_index(ix.index_rows(fx.gold(s, d)), path, 64)
    millionth = lambda w, i: F.concat(i.cast("string"), F.lit(":"), F.round(w * 1000000).cast("bigint").cast("string"))
    cells = F.filter(F.transform("embedding", lambda w, i: F.when(w != 0, millionth(w, i))), lambda c: c.isNotNull())
    return s.read.parquet(path).select(
        "event_id", "station", ts_text("start_ts").alias("start_ts"),
        ts_text("end_ts").alias("end_ts"), "current_state", "current_task", "current_sub_task",
        F.round(F.col("duration_s").cast("double"), 3).alias("duration_s"), "is_anomaly",
        "log_text", "embed_text", F.size("embedding").alias("dim"), joined(cells).alias("vector"),
    )


def _generation_view(df: DataFrame) -> DataFrame:
    return df.select(
        "run", "id", "system", "tier", "subtype", "question", "reference", "answer",
        joined("retrieved_ids").alias("retrieved_ids"),
        joined("retrieved_contexts").alias("retrieved_contexts"),
        F.size("scores").alias("n_scores"),
        F.col("usage.total_tokens").alias("total_tokens"), r6("latency_s").alias("latency_s"),
    )


def _generation_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "model", "prompt", "rerank", "id", "tier", "subtype", "system", "question", "reference",
        "answer", "retrieved_ids", "retrieved_contexts", "scores", "usage", "latency_s",
    )


@query
def read_generations(s, d):
    path = scratch_path(s, "generations")
    rs.write_generations(_generation_columns(fx.generations(s, d)), path, fx.RUNS)
    return _generation_view(rs.read_generations(s, path))


@query
def append_results(s, d):
    """Two appends of overlapping result sets; the second adds only what is new."""
    path = scratch_path(s, "append")
    rows = fx.generations(s, d)
    columns, key = _generation_columns(rows), ["model", "prompt", "rerank", "id", "system"]
    rs.append_new(columns.where("system <> 'baseline'"), path, key, rs.GENERATION_SCHEMA)
    rs.append_new(columns, path, key, rs.GENERATION_SCHEMA)
    return rs.read_log(s, path, rs.GENERATION_SCHEMA).select("model", "id", "system", "answer")


@query
def read_golden(s, d):
    path = scratch_path(s, "golden")
    rows = gs.golden_set(fx.mined(s, d), fx.PAIR_WINDOW_S)
    # A golden set has three times eight items, so one array file is its natural form.
    rows.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*rows.columns)))).alias("value")).write.text(path)
    return _golden_view(rs.read_golden(s, path))


@query
def read_labels(s, d):
    path = scratch_path(s, "labels")
    rs.write_sheet(fx.label_sheet(s, d).select("amostra", "rotulo", "comentario"), path)
    return rs.with_label(rs.read_sheet(s, path)).groupBy("label_kind", "label", "comentario").agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def process_activities(s, d):
    path = scratch_path(s, "activities")
    fx.activities(s, d).write.json(path)
    return rs.read_activities(s, path).select(
        "activityId", "processDefinitionKey", ts_text("startTime").alias("startTime"),
        ts_text("endTime").alias("endTime"), "durationInMillis",
    )


@query
def judge_scores(s, d):
    path = scratch_path(s, "judge")
    raw = fx.scores(s, d)
    raw.write.json(path)
    read = s.read.schema(raw.schema).json(path)
    return rs.judge_scores(read, "phi4").select(
        "judge", "run", "id", "system", "tier", *[r6(m).alias(m) for m in rs.JUDGE_METRICS]
    )


# B. Projections, filters, predicates

@query
def filter_split(s, d):
    return sv.of_split(_log(s, d), "train").select(
        "id", "station", ts_text("event_timestamp").alias("event_timestamp"), "current_state",
        "current_task", "current_sub_task",
    )


@query
def filter_station_state(s, d):
    return sv.of_station(_log(s, d), "MM_1", "not ready").select("id", "current_task")


@query
def sensor_access(s, d):
    return _log(s, d).select(
        "id", sv.sensor_text("k").alias("k_text"), sv.sensor_int("k").alias("k_int"),
        sv.sensor_int("none").alias("missing"),
    )


@query
def index_selection(s, d):
    return ix.index_selection(fx.gold(s, d), 25).select("episode_id", "current_state")


@query
def scalar_filter(s, d):
    """Index rows per (question, station) that pass the station and time filter."""
    parsed = qs.parse_questions(fx.questions(s, d), fx.WINDOW_S)
    return rt.filter_counts(parsed, fx.index_table(s, d))


@query
def drop_calibration(s, d):
    return gs.drop_calibration(fx.gold(s, d)).select("episode_id", "current_task")


@query
def near_median_negatives(s, d):
    return gs.near_median(fx.gold(s, d)).select("episode_id", "duration_s", "subtask_median_s")


@query
def min_events_filter(s, d):
    return ep.dropped_counts(ep.all_episodes(_log(s, d)))


def _hits_view(df: DataFrame, *extra: str) -> DataFrame:
    return df.select("question_id", "rank", "event_id", r6("score").alias("score"), *extra)


@query
def mode_routing(s, d):
    return _hits_view(rt.route_by_mode(
        fx.questions(s, d), fx.index_store(s, d), rt.TOP_K, fx.WINDOW_S, fx.DEDUP_S
    ))


# C. Joins

@query
def bpm_context(s, d):
    return ru.with_context(fx.gold(s, d)).select(
        "episode_id", "station", "current_task", "activity", "process", "next_station"
    )


@query
def subtask_stats_join(s, d):
    rows = fx.gold(s, d).select("episode_id", "current_state", "current_sub_task", "duration_s")
    return ep.attach_stats(rows, ep.subtask_stats(rows)).select(
        "episode_id", "median_ms", "threshold_ms"
    )


@query
def activity_interval_join(s, d):
    pairs = activity_join(_log(s, d).select("id", "event_timestamp"), fx.activities(s, d))
    return pairs.groupBy("activityId").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
    )


@query
def cross_station_pairs(s, d):
    return gs.cross_station_pairs(fx.mined(s, d), fx.PAIR_WINDOW_S)


@query
def unique_in_window(s, d):
    return gs.unique_in_window(fx.mined(s, d), fx.PAIR_WINDOW_S).select("station", "episode_id")


@query
def resume_anti_join(s, d):
    rows = fx.generations(s, d).select("id", "system", "run")
    todo, done = (rows.where(F.col("run") == f"{m}[estrito]") for m in fx.RUNS)
    return rs.resume(todo, done, ["id", "system"]).select("id", "system")


@query
def report_rows(s, d):
    rounded = [*mt.METRICS, "latency_s"]
    return fx.report(s, d).select(
        "run", "id", "tier", "subtype", "system", *[r6(c).alias(c) for c in rounded],
        "prompt_tokens", "total_tokens",
    )


def _pairs(s: SparkSession, d: str) -> DataFrame:
    long = mt.long_metrics(fx.report(s, d))
    return mt.paired(long, "system", "rag_filtrado", "rag_vetorial")


@query
def paired_join(s, d):
    return _pairs(s, d).select("run", "id", "tier", "metric", r6("a").alias("a"), r6("b").alias("b"))


@query
def evidence_match(s, d):
    hits = rt.pool(rt.nearest(fx.index_store(s, d), rt.vector_probes(fx.questions(s, d))))
    return mt.evidence_match(hits, fx.evidence(s, d))


@query
def foreign_context(s, d):
    """Every answer against the pool of all answers."""
    answers = fx.generations(s, d).where("system <> 'baseline'").select(
        "run", "id", "system", "answer", "retrieved_ids", "retrieved_contexts"
    )
    answers = materialise(answers, "answers")
    return pt.foreign_context(answers, answers)


@query
def limit_semi_join(s, d):
    return mt.first_questions(
        fx.generations(s, d).select("run", "id", "system"), fx.answered_golden(s, d), 50
    )


@query
def bpm_impact_groups(s, d):
    return ru.impact_groups(fx.mined(s, d)).select(
        "station", "current_task", "activity", "process", "next_station", "episode_id"
    )


# D. Aggregations

@query
def episodes(s, d):
    return fx.episodes(s, d).select(
        "episode_id", "station", "current_state", "current_task", "current_sub_task",
        ts_text("start_ts").alias("start_ts"), ts_text("end_ts").alias("end_ts"), "duration_s",
        "n_events", map_text(F.col("sensors_start")).alias("sensors_start"),
        map_text(F.col("sensors_end")).alias("sensors_end"),
    )


@query
def sensor_delta(s, d):
    return fx.episodes(s, d).select(
        "episode_id",
        F.array_join(F.transform(
            F.array_sort(F.map_keys("sensors_changed")),
            lambda k: F.concat(
                k, F.lit(":"), F.element_at("sensors_changed", k)["start"], F.lit(">"),
                F.element_at("sensors_changed", k)["end"],
            ),
        ), "|").alias("changed"),
    )


@query
def subtask_median_mad(s, d):
    return ep.subtask_stats(fx.gold(s, d)).select(
        "current_sub_task", "n_episodes", "median_ms", "mad_ms", "threshold_ms"
    )


@query
def anomaly_flag(s, d):
    """The whole way from raw rows to flags, without a stored episode table."""
    return ep.gold_episodes(_log(s, d)).select(
        "episode_id", "duration_s", "is_anomaly", "subtask_median_s", "subtask_threshold_s"
    )


@query
def split_counts(s, d):
    return sv.split_counts(_log(s, d))


@query
def episode_summary(s, d):
    return ep.episode_summary(fx.gold(s, d))


@query
def bm25_corpus_stats(s, d):
    return lx.corpus_stats(fx.documents(s, d)).select(
        "term", "df", "n_docs", r6("avg_len").alias("avg_len")
    )


@query
def retrieval_metrics(s, d):
    hits = rt.retrieve_filtered(
        fx.questions(s, d), fx.index_store(s, d), rt.TOP_K, False, fx.WINDOW_S, fx.DEDUP_S
    )
    return mt.metrics_from_hits(hits, fx.questions(s, d), fx.evidence(s, d)).select(
        "question_id", "tier", *[r6(m).alias(m) for m in mt.RETRIEVAL_METRICS]
    )


@query
def metrics_report(s, d):
    return mt.metrics_report(mt.long_metrics(fx.report(s, d))).select(
        "run", "system", "metric", F.coalesce("tier", F.lit("all")).alias("tier"),
        r6("mean").alias("mean"), "n",
    )


@query
def cost_report(s, d):
    return mt.cost_report(fx.report(s, d)).select(
        "run", "system",
        *[r6(c).alias(c) for c in ("latency_s_mean", "prompt_tokens_mean", "total_tokens_mean")],
    )


@query
def missing_scores(s, d):
    return mt.missing_scores(fx.report(s, d))


def _ci(df: DataFrame, keys: list[str], *rounded: str) -> DataFrame:
    return df.select(*keys, "n", *[r6(c).alias(c) for c in rounded])


@query
def bootstrap_ci(s, d):
    out = st.bootstrap_ci(mt.long_metrics(fx.report(s, d)), ["run", "system", "metric"], "value", REPLICATES)
    return _ci(out, ["run", "system", "metric"], "mean", "ci_low", "ci_high")


@query
def paired_bootstrap(s, d):
    out = st.paired_bootstrap(_pairs(s, d), ["run", "metric"], REPLICATES)
    return _ci(out, ["run", "metric"], "diff", "ci_low", "ci_high", "p_approx")


@query
def statistic_bootstrap(s, d):
    pairs = fx.judge_pairs(s, d)
    out = st.statistic_bootstrap(
        st.cuts(pairs), ["cut"], ["y_true", "y_pred"], st.agreement_stats, REPLICATES, names=["statistic"]
    )
    rank = lambda df, by: st.spearman(df, by, "human", "judge_units").drop("n")
    ordinal = st.statistic_bootstrap(
        pairs.withColumn("cut", F.lit("ordinal")).withColumn("judge_units", st.units("judge")),
        ["cut"], ["human", "judge_units"], rank, REPLICATES,
    ).withColumn("statistic", F.lit("spearman"))
    return out.unionByName(ordinal).select(
        "cut", "statistic", "n_valid",
        *[r6(c).alias(c) for c in ("estimate", "ci_low", "ci_high")],
    )


@query
def spearman(s, d):
    return st.spearman(fx.judge_pairs(s, d), ["run"], "human", "judge").select(
        "run", "n", r6("stat").alias("spearman")
    )


@query
def agreement(s, d):
    return st.agreement(st.cuts(fx.judge_pairs(s, d)), ["run", "cut"]).select(
        "run", "cut", "tp", "fn", "fp", "tn",
        *[r6(c).alias(c) for c in ("accuracy", "balanced_accuracy", "kappa")],
    )


@query
def judge_mean_by_label(s, d):
    return st.judge_mean_by_label(rs.with_label(fx.label_sheet(s, d))).select(
        "label", "n", r6("judge_mean").alias("judge_mean")
    )


@query
def judge_noise(s, d):
    return st.judge_noise(fx.noise_measures(s, d), ["run"]).select(
        "run", "n_valid", "identical", r6("amplitude_mean").alias("amplitude_mean"),
        r6("amplitude_max").alias("amplitude_max"),
    )


@query
def perturb_report(s, d):
    out = st.perturb_report(fx.perturb_rows(s, d), REPLICATES)
    keep = ("tolerance", "mean_original", "mean_perturbed", "delta_mean", "delta_ci_low",
            "delta_ci_high", "detection_mean", "detection_ci_low", "detection_ci_high")
    return out.select("cond", "n", "fell", "same", "rose", *[r6(c).alias(c) for c in keep])


@query
def positive_control_summary(s, d):
    out = st.positive_control_summary(fx.perturb_rows(s, d))
    return out.select("n", *[r6(c).alias(c) for c in ("mean", "share_ge_08", "min", "max")])


@query
def run_difference(s, d):
    """Every later run against the first one, question by question."""
    first, later = (f"{m}[estrito]" for m in fx.RUNS)
    pairs = mt.paired(mt.long_metrics(fx.report(s, d), COMPARED), "run", later, first)
    out = st.paired_bootstrap(pairs, ["system", "metric"], REPLICATES)
    return _ci(out, ["system", "metric"], "diff", "ci_low", "ci_high", "p_approx")


@query
def refusal_matrix(s, d):
    out = mt.refusal_matrix(fx.generations(s, d), fx.answered_golden(s, d))
    return out.withColumn("key_fact_mean", r6("key_fact_mean"))


def _scored_answers(s: SparkSession, d: str) -> DataFrame:
    """Answers with retrieval, their judge score and their kind."""
    answers = mt.answer_checks(fx.generations(s, d).where("system <> 'baseline'"))
    score = fx.tidy_scores(s, d).select("run", "id", "system", "faithfulness")
    return answers.join(score, ["run", "id", "system"])


@query
def refusal_score_bands(s, d):
    return mt.refusal_score_bands(_scored_answers(s, d)).withColumn("mean", r6("mean"))


@query
def tier_subtype_counts(s, d):
    return mt.tier_subtype_counts(fx.generations(s, d).select("tier", "subtype", "id").distinct())


@query
def metric_compare(s, d):
    rows = materialise(fx.report(s, d), "report")
    return mt.metric_compare(rows, COMPARED, REPLICATES)


# E. Window functions

@query
def episode_boundaries(s, d):
    return ep.boundaries(_log(s, d)).select("id", "station", "is_boundary", "episode_no")


@query
def unique_in_second(s, d):
    return gs.unique_in_second(fx.mined(s, d))


@query
def unique_combo(s, d):
    return gs.unique_combo(fx.mined(s, d))


@query
def range_count(s, d):
    return gs.range_count(fx.mined(s, d), fx.PAIR_WINDOW_S)


@query
def rank_in_question(s, d):
    hits = rt.nearest(fx.index_store(s, d), rt.vector_probes(fx.questions(s, d)))
    return _hits_view(mt.rank_in_question(hits))


@query
def avg_rank(s, d):
    counted = fx.judge_pairs(s, d).groupBy("run", "judge").agg(F.count(F.lit(1)).alias("n"))
    return st.average_ranks(counted, ["run"], "judge", "n").select("run", r6("judge").alias("judge"), "rank")


@query
def cell_row_number(s, d):
    rows = fx.tidy_scores(s, d).where("faithfulness is not null").select(
        "run", "system", "id", "faithfulness"
    )
    return st.cell_row_numbers(rows, ["run", "system"], ["faithfulness", "id"]).select(
        "run", "system", "id", "ordinal", "cell_size"
    )


# F. Sort, limit, top-k, retrieval

@query
def mode_routing_reranked(s, d):
    return _hits_view(rt.route_by_mode(
        fx.questions(s, d), fx.index_store(s, d), rt.TOP_K, fx.WINDOW_S, fx.DEDUP_S, rerank=True, texts=fx.hit_texts(s, d)
    ))


@query
def knn_topk(s, d):
    hits = rt.nearest(fx.index_store(s, d), rt.vector_probes(fx.questions(s, d)))
    return _hits_view(rt.pool(hits))


@query
def knn_filtered(s, d):
    """Questions with one station: station and window filter, no fallback."""
    parsed = qs.parse_questions(fx.questions(s, d), fx.WINDOW_S).where(F.size("stations") == 1)
    hits = rt.nearest(fx.index_store(s, d), rt.station_probes(parsed), rt.TOP_K, fallback=False)
    return _hits_view(hits.withColumn("rank", F.col("probe_rank")))


@query
def window_fallback(s, d):
    parsed = qs.parse_questions(fx.questions(s, d), fx.WINDOW_S)
    hits = rt.nearest(fx.index_store(s, d), rt.station_probes(parsed))
    return hits.select(
        "question_id", F.substring_index("probe_id", "#", -1).alias("station"), "event_id",
        r6("score").alias("score"), F.col("probe_rank").alias("rank"),
    )


@query
def ann_partitioned(s, d):
    index = fx.index_table(s, d)
    centroids = rt.mean_centroids(index, "label")
    return _hits_view(rt.pool(rt.ann_search(fx.questions(s, d), index, centroids, 3, rt.TOP_K)))


@query
def ann_trained(s, d):
    """Hits of the trained list index; held against the exact ones by tests/test_retrieval.py."""
    return _hits_view(rt.pool(rt.trained_search(fx.questions(s, d), fx.list_index(s, d), fx.NPROBE, rt.TOP_K)))


@query
def multi_station_merge(s, d):
    parsed = qs.parse_questions(fx.questions(s, d), fx.WINDOW_S).where(F.size("stations") > 1)
    return _hits_view(rt.pool(rt.nearest(fx.index_store(s, d), rt.station_probes(parsed))))


@query
def greedy_time_dedup(s, d):
    index = fx.index_store(s, d)
    hits = rt.pool(rt.nearest(index, rt.vector_probes(fx.questions(s, d))))
    return _hits_view(rt.time_dedup(rt.with_fields(hits, index), rt.TOP_K, fx.DEDUP_S))


@query
def bm25_score(s, d):
    out = lx.bm25_topk(fx.table(s, d, "benchmark"), fx.document_texts(s, d), 20)
    return out.select("item_id", "doc_id", "rank", r6("bm25").alias("bm25"))


@query
def rrf_fuse(s, d):
    index, questions = fx.index_store(s, d), fx.questions(s, d)
    hits = rt.pool(rt.nearest(index, rt.vector_probes(questions)))
    return _hits_view(
        lx.fuse(lx.score_hits(hits, questions, fx.hit_texts(s, d))).withColumn("bm25", r6("bm25"))
        .withColumn("rrf_score", r6(F.col("rrf_score") * 1000)),
        "dense_rank", "bm25", "bm25_rank", "rrf_score",
    )


@query
def retrieve_vector(s, d):
    return _hits_view(rt.retrieve_vector(
        fx.questions(s, d), fx.index_store(s, d), rt.TOP_K, True, fx.DEDUP_S, fx.hit_texts(s, d)
    ))


@query
def retrieve_filtered(s, d):
    return _hits_view(rt.retrieve_filtered(
        fx.questions(s, d), fx.index_store(s, d), rt.TOP_K, True, fx.WINDOW_S, fx.DEDUP_S, fx.hit_texts(s, d)
    ))


def _ablation(s: SparkSession, d: str) -> DataFrame:
    questions = fx.questions(s, d)
    hits = materialise(rt.ablation_hits(
        questions, fx.index_store(s, d), rt.TOP_K, fx.WINDOW_S, fx.DEDUP_S, fx.hit_texts(s, d)
    ), "ablation")
    return mt.metrics_from_hits(hits, questions, fx.evidence(s, d), [name for name, *_ in rt.CONFIGS])


@query
def retrieval_ablation(s, d):
    per = _ablation(s, d)
    return per.groupingSets([["config"], ["config", "tier"]], "config", "tier").agg(
        *[r6(F.avg(m)).alias(m) for m in mt.RETRIEVAL_METRICS], F.count(F.lit(1)).alias("n")
    ).withColumn("tier", F.coalesce("tier", F.lit("all")))


@query
def rank_changes(s, d):
    return mt.rank_changes(_ablation(s, d)).select(
        "base", "question_id",
        *[r6(c).alias(c) for c in
          ("mrr_before", "mrr_after", "hit_at_k_before", "hit_at_k_after")],
    )


@query
def top_longest(s, d):
    return sv.top_longest(_log(s, d)).select("id", "station", "current_task_duration")


@query
def evenly_spaced_sample(s, d):
    rows = fx.judge_pairs(s, d).withColumn("quota", F.lit(SPACED))
    return evenly_spaced(rows, ["run"], ["judge", "doc_id"], "quota").select("run", "doc_id")


def _label_pool(s: SparkSession, d: str) -> DataFrame:
    return _scored_answers(s, d).where(
        (F.col("kind") != tx.REFUSAL) & F.col("faithfulness").isNotNull()
    ).select("run", "system", "id", "faithfulness")


@query
def round_robin_quota(s, d):
    cells = group_sizes(_label_pool(s, d), ["run", "system"], "n")
    return st.round_robin_quota(cells, ["run", "system"], QUOTA)


@query
def blind_shuffle(s, d):
    rows = fx.judge_pairs(s, d).withColumn("key", F.lpad(F.col("doc_id").cast("string"), 9, "0"))
    return st.blind_shuffle(rows, "key").select("sample", "doc_id")


@query
def every_nth(s, d):
    return st.every_nth(fx.answered_golden(s, d).select("id"), "id", 30)


@query
def per_station_round_robin(s, d):
    rows = gs.drop_calibration(fx.mined(s, d))
    return gs.station_round_robin(rows, gs.TIME_STATIONS, 12, "42a").select(
        "position", "station", "episode_id"
    )


@query
def pair_quota_select(s, d):
    pairs = gs.cross_station_pairs(fx.mined(s, d), fx.PAIR_WINDOW_S)
    return gs.quota_pairs(pairs)


@query
def label_sample(s, d):
    return st.label_sample(_label_pool(s, d), QUOTA).select(
        "sample", "run", "system", "id", r6("faithfulness").alias("faithfulness")
    )


SUBSET = 25


def _sample(s: SparkSession, d: str) -> DataFrame:
    return st.label_sample(_label_pool(s, d), QUOTA)


@query
def labelling_sheet(s, d):
    return st.labelling_sheet(_sample(s, d), fx.generations(s, d))


@query
def labelling_key(s, d):
    return st.labelling_key(_sample(s, d), fx.generations(s, d)).withColumn("faithfulness_juiz", r6("faithfulness_juiz"))


@query
def labelling_subset(s, d):
    sample = materialise(_sample(s, d), "sample")
    answers = fx.generations(s, d)
    sheet, key = st.labelling_sheet(sample, answers), st.labelling_key(sample, answers)
    return st.sheet_subset(sheet, key, SUBSET).select("amostra", "pergunta", "resposta")


@query
def claim_scores(s, d):
    scored = st.claim_scores(fx.claim_verdicts(s, d), ["run", "id", "system"])
    return scored.withColumn("share_supported", r6("share_supported"))


@query
def golden_evidence(s, d):
    """Every episode that counts as evidence of a question, those of impact groups too."""
    mined = fx.mined(s, d)
    return gs.golden_evidence(materialise(gs.golden_set(mined, fx.PAIR_WINDOW_S), "golden"), mined)


# G. Set operations

@query
def index_union(s, d):
    gold = fx.gold(s, d)
    ready = ix.sampled_ready(gold, 40)
    return gold.where("current_state = 'not ready'").unionByName(ready).groupBy(
        "station", "current_state"
    ).agg(F.count(F.lit(1)).alias("n"), F.max("episode_id").alias("last_id"))


@query
def pos_neg_union(s, d):
    return gs.anomaly_cases(fx.mined(s, d)).select("episode_id", "is_anomaly", "duration_s")


@query
def common_questions(s, d):
    return mt.common_questions(fx.generations(s, d))


@query
def unused_candidates(s, d):
    mined = fx.mined(s, d)
    used = gs.cross_station_pairs(mined, fx.PAIR_WINDOW_S)
    ids = used.select(F.explode(F.array("a_id", "b_id")).alias("episode_id"))
    return gs.drop_calibration(mined).join(ids, "episode_id", "left_anti").select("episode_id")


@query
def distinct_claims(s, d):
    return fx.generations(s, d).select(
        "run", "id", "system", joined(pt.distinct_claims(tx.dotted(F.col("answer")))).alias("claims"),
    )


# H. Scalar and text operators

@query
def parse_questions(s, d):
    return qs.parse_questions(fx.questions(s, d), fx.WINDOW_S).select(
        "question_id", joined("stations").alias("stations"), ts_text("ts").alias("ts"),
        ts_text("window_lo").alias("window_lo"), ts_text("window_hi").alias("window_hi"),
    )


@query
def episode_text(s, d):
    return fx.gold(s, d).withColumn("text", ep.narrative()).select("episode_id", "text")


@query
def bpm_text(s, d):
    return ru.with_context(fx.gold(s, d)).select("episode_id", ru.context_sentence().alias("bpm"))


@query
def embed_text(s, d):
    docs = ru.with_context(fx.gold(s, d)).select(
        F.col("episode_id").alias("id"),
        ix.embed_text(F.col("text"), ru.context_sentence()).alias("text"),
    )
    asked = fx.questions(s, d).select(
        F.col("question_id").alias("id"), ix.query_text(F.col("question")).alias("text")
    )
    return docs.unionByName(asked)


@query
def text_vectors(s, d):
    rows = ix.with_text_vectors(fx.gold(s, d).select("episode_id", "text"), "text", 64)
    return rows.select("episode_id", F.posexplode("embedding").alias("dim", "w")).where(
        "w <> 0"
    ).select("episode_id", "dim", r6("w").alias("weight"))


@query
def tokenize(s, d):
    rows = fx.documents(s, d).withColumn("tokens", tx.tokenize(F.col("text")))
    return rows.select(
        "doc_id", F.md5(joined("tokens")).alias("digest"), F.size("tokens").alias("n_tokens")
    )


@query
def hit_text(s, d):
    return fx.index_table(s, d).select("event_id", tx.hit_text().alias("text"))


def _context_hits(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    questions, index = fx.questions(s, d), fx.index_table(s, d)
    hits = rt.retrieve_vector(questions, index, rt.TOP_K, False, fx.DEDUP_S)
    extra = ("end_ts", "current_state", "current_sub_task", "duration_s", "is_anomaly", "log_text")
    return questions, rt.with_fields(hits, index, extra)


@query
def assemble_prompts(s, d):
    questions, hits = _context_hits(s, d)
    hits = materialise(hits, "prompt-hits")
    strict = pr.assemble(questions, hits, pr.STRICT).withColumn("template", F.lit("estrito"))
    lenient = pr.assemble(questions, hits, pr.LENIENT).withColumn("template", F.lit("brando"))
    plain = pr.assemble_baseline(questions).withColumn("template", F.lit("baseline"))
    return strict.unionByName(lenient).unionByName(plain)


@query
def context_text(s, d):
    return fx.index_table(s, d).select(
        "event_id", tx.context_text(ts_text("start_ts")).alias("line")
    )


def _checked(s: SparkSession, d: str) -> DataFrame:
    return mt.answer_checks(fx.generations(s, d))


@query
def key_fact_recall(s, d):
    return _checked(s, d).select("run", "id", "system", r6("key_fact_recall").alias("key_fact_recall"))


@query
def anomaly_verdict(s, d):
    return _checked(s, d).select("run", "id", "system", "verdict")


@query
def classify_answer(s, d):
    return _checked(s, d).select("run", "id", "system", "kind")


@query
def ungrounded_numbers(s, d):
    return _checked(s, d).select("run", "id", "system", "ungrounded")


@query
def split_claims(s, d):
    return pt.claims(fx.generations(s, d), ["run", "id", "system"])


@query
def perturb_neutral(s, d):
    return fx.generations(s, d).select(
        "run", "id", "system", pt.neutral(F.col("answer")).alias("changed")
    )


@query
def perturb_numbers(s, d):
    return fx.generations(s, d).select(
        "run", "id", "system",
        pt.swap_numbers(F.col("answer"), F.col("question"), F.col("retrieved_contexts"))
        .alias("changed"),
    )


@query
def perturb_station(s, d):
    rows = fx.generations(s, d)
    return rows.join(F.broadcast(pt.station_universe(rows))).select(
        "run", "id", "system",
        pt.swap_station(
            F.col("answer"), F.col("question"), F.col("retrieved_contexts"), F.col("universe")
        ).alias("changed"),
    )


@query
def question_text(s, d):
    """All question and reference templates over all mined episodes."""
    rows = fx.mined(s, d).withColumn(
        "motor", F.replace("current_sub_task", F.lit("calibrating "), F.lit(""))
    )
    second = F.date_format("start_ts", "yyyy-MM-dd HH:mm:ss")
    impact = ru.with_context(rows).select(
        "episode_id", gs.impact_question().alias("impact_question"), gs.impact_reference().alias("impact_reference")
    )
    return rows.select(
        "episode_id",
        gs.time_question(F.col("station"), second).alias("time_question"),
        gs.described_question().alias("described_question"), gs.fact().alias("fact"),
        gs.pair_question(F.col("station"), F.lit("OV_1"), second).alias("pair_question"),
        gs.anomaly_question(F.col("motor"), second).alias("anomaly_question"),
        gs.anomaly_reference(F.col("motor")).alias("anomaly_reference"),
    ).join(impact, "episode_id")


def _golden_view(df: DataFrame) -> DataFrame:
    return df.select(
        "id", "tier", "subtype", "question", "reference",
        joined("evidence_episode_ids").alias("evidence"), "evidence_mode",
        joined("meta.stations").alias("stations"), F.col("meta.timestamp").alias("moment"),
        F.col("meta.is_anomaly").alias("is_anomaly"),
    )


@query
def golden_set(s, d):
    return _golden_view(gs.golden_set(fx.mined(s, d), fx.PAIR_WINDOW_S))


@query
def run_labels(s, d):
    rows = fx.generations(s, d).select("model", "prompt", "rerank").distinct()
    rows = rows.unionByName(rows.withColumn("prompt", F.lit("brando"))).unionByName(
        rows.withColumn("rerank", F.lit("bm25"))
    )
    m, p, r = F.col("model"), F.col("prompt"), F.col("rerank")
    return rows.select(
        "model", "prompt", "rerank", rs.run_slug(m).alias("slug"),
        rs.model_family(m).alias("family"), rs.run_label(m, p, r).alias("label"),
        rs.run_folder(m, p, r, fx.RUNS[0]).alias("folder"),
        (rs.model_family(m) == rs.model_family(F.lit("Alpha2:13b"))).alias("same_family"),
    )


@query
def perturb_variants(s, d):
    answers = _scored_answers(s, d).where("faithfulness is not null").select(
        "run", "id", "system", "question", "answer", "retrieved_ids", "retrieved_contexts",
        "faithfulness",
    )
    return pt.variants(materialise(answers, "answers"), 40)


@query
def positive_controls(s, d):
    return pt.positive_controls(fx.generations(s, d), 60)


# I. Streaming

def _stream_log(s: SparkSession, d: str) -> str:
    """The machine log as NDJSON files per split, as the landing folder would hold it."""
    path = scratch_path(s, "landing")
    fx.bronze_lines(s, d).repartition(4).write.partitionBy("split").text(path)
    return path


@query
def stream_silver(s, d):
    out, ck = scratch_path(s, "stream-silver"), scratch_path(s, "stream-checkpoint")
    inc.stream_silver(s, _stream_log(s, d), out, ck)
    return _silver_view(s.read.parquet(out))


@query
def stream_episodes(s, d):
    """The log arrives in four parts in time order; the job runs after each, with two days of delay."""
    root, ck = scratch_path(s, "stream-episodes"), scratch_path(s, "stream-checkpoint")
    landing = scratch_path(s, "stream-landing")
    rows = _log(s, d).drop("event_id", "split")
    at = micros("event_timestamp")
    cuts = rows.agg(F.percentile_approx(at, [0.25, 0.5, 0.75], 10000)).first()[0]
    bounds = [None, *cuts, None]
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        part = rows if lo is None else rows.where(at > lo)
        (part if hi is None else part.where(at <= hi)).write.mode("append").parquet(landing)
        stream = s.readStream.schema(rows.schema).parquet(landing)
        last = inc.stream_episodes(stream, root, ck, 2 * 86400)
    out = inc.closed_episodes(s, root).unionByName(inc.flush_open(s, root, last, rows))
    return out.select(
        "episode_id", "station", "current_state", "n_events", "duration_s",
        ts_text("end_ts").alias("end_ts"),
    )
