"""Retrieval and answer metrics, reports over long metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators.stats import bootstrap_ci
from millrace.sources.results import BASELINE_METRICS, JUDGE_METRICS

RETRIEVAL_METRICS = ("hit_at_k", "mrr", "recall_at_k")
METRICS = (*RETRIEVAL_METRICS, "key_fact_recall", "verdict_correct", *JUDGE_METRICS)
BASELINE = "baseline"


def hit_ranks(retrieved: Column, evidence: Column) -> Column:
    """1-based positions of retrieved ids that are evidence."""
    marked = F.transform(
        retrieved, lambda x, i: F.when(F.array_contains(evidence, x), i + 1)
    )
    return F.filter(marked, lambda r: r.isNotNull())


def retrieval_metrics(retrieved: Column, evidence: Column, mode: Column) -> Column:
    """struct<hit_at_k, mrr, recall_at_k>: `any` counts one found id as full recall."""
    ranks = hit_ranks(retrieved, evidence)
    found = F.size(F.array_intersect(retrieved, evidence))
    hit = F.when(F.size(ranks) > 0, 1.0).otherwise(0.0)
    recall = F.when(mode == "any", hit).otherwise(found / F.size(F.array_distinct(evidence)))
    return F.struct(
        hit.alias("hit_at_k"),
        F.when(F.size(ranks) > 0, 1.0 / F.array_min(ranks)).otherwise(0.0).alias("mrr"),
        recall.alias("recall_at_k"),
    )


def evidence_match(hits: DataFrame, evidence: DataFrame) -> DataFrame:
    """Hits (question_id, rank, event_id) that are evidence: an equi-join on both ids."""
    return hits.join(
        evidence.select("question_id", "event_id").distinct(), ["question_id", "event_id"],
        "left_semi",
    ).select("question_id", "rank", "event_id")


def metrics_from_hits(
    hits: DataFrame, questions: DataFrame, evidence: DataFrame, configs: Sequence[str] = ()
) -> DataFrame:
    """Retrieval metrics per question for ranked hits; questions without hits count as zero.

    Evidence is a table of (question_id, event_id), so a question whose evidence is a large part
    of the index needs no list. If `hits` carries a config column, metrics are per configuration of
    `configs`, also of one that found nothing.
    """
    key = [c for c in ("config", "question_id") if c in hits.columns]
    pairs = evidence.select("question_id", "event_id").distinct()
    sizes = pairs.groupBy("question_id").agg(F.count(F.lit(1)).alias("_evidence"))
    found = hits.join(pairs, ["question_id", "event_id"]).groupBy(*key).agg(
        F.min("rank").alias("_first"), F.count_distinct("event_id").alias("_found")
    )
    asked = questions.select("question_id", "tier", "evidence_mode")
    if "config" in key:
        asked = asked.withColumn("config", F.explode(F.array(*map(F.lit, configs))))
    rows = asked.join(sizes, "question_id", "left").join(found, key, "left")
    hit = F.when(F.col("_first").isNotNull(), 1.0).otherwise(0.0)
    return rows.select(
        *key, "tier",
        hit.alias("hit_at_k"),
        F.coalesce(1.0 / F.col("_first"), F.lit(0.0)).alias("mrr"),
        F.when(F.col("evidence_mode") == "any", hit)
        .otherwise(F.coalesce(F.col("_found") / F.col("_evidence"), F.lit(0.0)))
        .alias("recall_at_k"),
    )


def answer_checks(answers: DataFrame) -> DataFrame:
    """Deterministic answer metrics as columns."""
    kf = tx.key_fact_recall(F.col("answer"), F.col("reference"), F.col("question"))
    return answers.withColumn("key_fact_recall", kf).withColumn(
        "verdict", tx.anomaly_verdict(F.col("answer"))
    ).withColumn(
        "kind", tx.classify_answer(F.col("answer"), F.col("key_fact_recall"))
    ).withColumn(
        "ungrounded",
        tx.ungrounded_numbers(F.col("answer"), F.col("question"), F.col("retrieved_contexts")),
    )


def evidence_table(golden: DataFrame) -> DataFrame:
    """(id, episode_id) from the lists of a question set; questions without a list have no row here."""
    return golden.select("id", F.explode("evidence_episode_ids").alias("episode_id")).distinct()


def found_evidence(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(run, id, system, first_rank, n_found) of answers whose retrieved ids hold evidence.

    The evidence of an impact question may be a third of all episodes: it is joined on both ids
    and never gathered into a list.
    """
    ids = answers.select("run", "id", "system", F.posexplode("retrieved_ids").alias("_pos", "episode_id"))
    return ids.join(evidence.select("id", "episode_id").distinct(), ["id", "episode_id"]).groupBy("run", "id", "system").agg(
        (F.min("_pos") + 1).alias("first_rank"), F.count_distinct("episode_id").alias("n_found")
    )


def report_rows(
    generations: DataFrame, golden: DataFrame, scores: DataFrame, evidence: DataFrame | None = None
) -> DataFrame:
    """One row per (run, id, system): answer and retrieval metrics plus judge scores.

    evidence: (id, episode_id) of all questions, by default from the lists in `golden`. The joins are on the
    question id and on (run, id, system); no broadcast is forced, so the engine picks one only for a
    table it has measured as small.
    """
    evidence = evidence_table(golden) if evidence is None else evidence
    sizes = evidence.groupBy("id").agg(F.count_distinct("episode_id").alias("_evidence"))
    key = ["run", "id", "system"]
    rows = (
        generations.join(golden.select("id", "evidence_mode"), "id").join(sizes, "id", "left")
        .join(found_evidence(generations, evidence), key, "left")
        .join(scores.drop("tier", "judge"), key, "left")
    )
    rag = F.col("system") != BASELINE
    hit = F.when(F.col("first_rank").isNotNull(), 1.0).otherwise(0.0)
    measured = F.struct(
        hit.alias("hit_at_k"), F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("mrr"),
        F.when(F.col("evidence_mode") == "any", hit)
        .otherwise(F.coalesce(F.col("n_found") / F.col("_evidence"), F.lit(0.0))).alias("recall_at_k"),
    )
    expected = F.when(F.col("subtype") == "anomalia_sim", "sim").when(
        F.col("subtype") == "anomalia_nao", "nao"
    )
    verdict = tx.anomaly_verdict(F.col("answer"))
    return rows.withColumn("_m", measured).select(
        "run", "id", "tier", "subtype", "system",
        *[F.when(rag, F.col(f"_m.{m}")).alias(m) for m in RETRIEVAL_METRICS],
        tx.key_fact_recall(F.col("answer"), F.col("reference"), F.col("question"))
        .alias("key_fact_recall"),
        F.when(expected.isNotNull(), F.when(verdict == expected, 1.0).otherwise(0.0))
        .alias("verdict_correct"),
        *JUDGE_METRICS,
        "latency_s",
        F.coalesce("usage.prompt_tokens", F.lit(0)).alias("prompt_tokens"),
        F.coalesce("usage.total_tokens", F.lit(0)).alias("total_tokens"),
    )


def long_metrics(rows: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """(run, id, tier, system, metric, value) without null values."""
    return rows.unpivot(
        ["run", "id", "tier", "system"], [F.col(m).cast("double").alias(m) for m in metrics],
        "metric", "value",
    ).where("value is not null and not isnan(value)")


def metrics_report(long: DataFrame) -> DataFrame:
    """Mean and n per (run, system, metric), overall (tier null) and by tier."""
    return long.groupingSets(
        [["run", "system", "metric"], ["run", "system", "metric", "tier"]],
        "run", "system", "metric", "tier",
    ).agg(F.avg("value").alias("mean"), F.count("value").alias("n"))


def cost_report(rows: DataFrame) -> DataFrame:
    return rows.groupBy("run", "system").agg(
        F.avg("latency_s").alias("latency_s_mean"),
        F.avg("prompt_tokens").alias("prompt_tokens_mean"),
        F.avg("total_tokens").alias("total_tokens_mean"),
    )


def missing_scores(rows: DataFrame) -> DataFrame:
    """Null judge scores per (run, system, metric) among the metrics expected of the system."""
    flags = rows.unpivot(
        ["run", "system"], [F.col(m).isNull().cast("bigint").alias(m) for m in JUDGE_METRICS],
        "metric", "missing",
    )
    expected = (F.col("system") != BASELINE) | F.col("metric").isin(*BASELINE_METRICS)
    return flags.where(expected).groupBy("run", "system", "metric").agg(
        F.sum("missing").alias("missing")
    )


def common_questions(rows: DataFrame) -> DataFrame:
    """(system, id) present in every run: an n-way intersection in one aggregation."""
    runs = rows.agg(F.count_distinct("run").alias("_runs"))
    seen = rows.groupBy("system", "id").agg(F.count_distinct("run").alias("_n"))
    return seen.join(F.broadcast(runs)).where("_n = _runs").select("system", "id")


def refusal_matrix(answers: DataFrame, golden: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """Evidence in context against answer behaviour, per run and system over common questions.

    evidence: (id, episode_id) of all questions, by default from the lists in `golden`.
    """
    evidence = evidence_table(golden) if evidence is None else evidence
    rag = answers.where(F.col("system") != BASELINE)
    shared = rag.join(common_questions(rag), ["system", "id"], "left_semi").join(
        golden.select("id").distinct(), "id", "left_semi"
    )
    rows = answer_checks(
        shared.join(found_evidence(shared, evidence).drop("n_found"), ["run", "id", "system"], "left")
    ).withColumn("hit", F.col("first_rank").isNotNull())
    hit, refusal = F.col("hit"), F.col("kind") == tx.REFUSAL
    return rows.groupBy("run", "system").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(hit).alias("with_evidence"),
        F.count_if(hit & refusal).alias("undue_refusal"),
        F.count_if(hit & (F.col("kind") == tx.PARTIAL)).alias("partial_caveat"),
        F.count_if(~hit & refusal).alias("correct_refusal"),
        F.count_if(~hit & ~refusal).alias("answered_without_evidence"),
        F.count_if(F.col("ungrounded") > 0).alias("with_ungrounded_number"),
        F.avg("key_fact_recall").alias("key_fact_mean"),
    )


def refusal_score_bands(rows: DataFrame) -> DataFrame:
    """Judge score of full refusals: zero, middle, one (from 0.999), mean."""
    f = F.col("faithfulness")
    return rows.where((F.col("kind") == tx.REFUSAL) & f.isNotNull()).groupBy("run").agg(
        F.count(F.lit(1)).alias("n_refusals"),
        F.count_if(f == 0).alias("zero"),
        F.count_if((f > 0) & (f < 0.999)).alias("middle"),
        F.count_if(f >= 0.999).alias("one"),
        F.avg(f).alias("mean"),
    )


def tier_subtype_counts(golden: DataFrame) -> DataFrame:
    return golden.groupBy("tier", "subtype").agg(F.count(F.lit(1)).alias("n"))


def paired(long: DataFrame, side: str, a: str, b: str) -> DataFrame:
    """Per (run or system, id, metric) the values of two sides of column `side`, both present.

    One pivot-style aggregation instead of a self-join.
    """
    rest = [c for c in ("run", "system") if c != side]
    return (
        long.where(F.col(side).isin(a, b))
        .groupBy(*rest, "id", "tier", "metric")
        .agg(
            F.max(F.when(F.col(side) == a, F.col("value"))).alias("a"),
            F.max(F.when(F.col(side) == b, F.col("value"))).alias("b"),
        )
        .where("a is not null and b is not null")
    )


def rank_changes(per_question: DataFrame) -> DataFrame:
    """Questions whose MRR or hit differ between a base configuration and its fused form."""
    base = F.regexp_replace("config", r"\+BM25$", "")
    fused = F.col("config").endswith("+BM25")
    sides = per_question.groupBy(base.alias("base"), "question_id").agg(*[
        F.max(F.when(fused if after else ~fused, F.col(m))).alias(f"{m}_{name}")
        for m in ("mrr", "hit_at_k") for name, after in (("before", False), ("after", True))
    ])
    return sides.where(
        "abs(mrr_after - mrr_before) > 1e-9 or hit_at_k_after <> hit_at_k_before"
    )


def first_questions(rows: DataFrame, golden: DataFrame, n: int) -> DataFrame:
    """Rows of the first n questions in id order (a top-n, not a full sort)."""
    return rows.join(golden.select("id").orderBy("id").limit(n), "id", "left_semi")


def rank_in_question(hits: DataFrame) -> DataFrame:
    w = Window.partitionBy("question_id").orderBy(F.col("score").desc(), "event_id")
    return hits.withColumn("rank", F.row_number().over(w))


def metric_compare(
    rows: DataFrame, metrics: Sequence[str], replicates: int, systems: Sequence[str] = ("rag_filtrado", "rag_vetorial"),
) -> DataFrame:
    """Runs side by side: chosen metrics with interval, mean latency and tokens, one row per
    (system, run). The pivot list is fixed, so no extra job looks for its values."""
    chosen = rows.where(F.col("system").isin(*systems))
    by = ["run", "system", "metric"]
    ci = bootstrap_ci(long_metrics(chosen, metrics), by, "value", replicates)
    text = F.concat(
        F.round(F.col("mean").cast("decimal(18,9)"), 2).cast("string"), F.lit(" ["),
        F.round(F.col("ci_low").cast("decimal(18,9)"), 2).cast("string"), F.lit("; "),
        F.round(F.col("ci_high").cast("decimal(18,9)"), 2).cast("string"), F.lit("]"),
    )
    wide = ci.withColumn("_t", text).groupBy("run", "system").pivot("metric", list(metrics)).agg(
        F.first("_t")
    )
    cost = cost_report(chosen).select(
        "run", "system", F.round("latency_s_mean", 6).alias("latency_s_mean"),
        F.round("total_tokens_mean", 6).alias("total_tokens_mean"),
    )
    return wide.join(cost, ["run", "system"])
