"""Readers and writers for question sets, generations, judge scores, labels and activities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import materialise

GOLDEN_SCHEMA = (
    "id string, tier string, subtype string, question string, reference string, "
    "evidence_episode_ids array<string>, evidence_mode string, "
    "meta struct<stations: array<string>, timestamp: string, is_anomaly: boolean>"
)
GENERATION_SCHEMA = (
    "model string, prompt string, rerank string, id string, tier string, subtype string, "
    "system string, question string, reference string, answer string, "
    "retrieved_ids array<string>, retrieved_contexts array<string>, scores array<double>, "
    "usage struct<prompt_tokens: bigint, completion_tokens: bigint, total_tokens: bigint>, "
    "latency_s double"
)
ACTIVITY_SCHEMA = (
    "activityId string, processDefinitionKey string, startTime timestamp, endTime timestamp, "
    "durationInMillis bigint"
)
# Judge metrics, and the ones a system without retrieval is scored on.
JUDGE_METRICS = (
    "faithfulness", "answer_relevancy", "llm_context_precision_with_reference",
    "context_recall", "factual_correctness",
)
BASELINE_METRICS = ("answer_relevancy", "factual_correctness")
DEFAULT_PROMPT = "estrito"
DEFAULT_RERANK = "off"


def run_label(model: Column, prompt: Column, rerank: Column, always_prompt: bool = False) -> Column:
    """`model[prompt]+rerank`; default settings leave no mark unless always_prompt is set."""
    prompt = F.coalesce(prompt, F.lit(DEFAULT_PROMPT))
    rerank = F.coalesce(rerank, F.lit(DEFAULT_RERANK))
    shown = F.lit(True) if always_prompt else prompt != DEFAULT_PROMPT
    return F.concat(
        model,
        F.when(shown, F.concat(F.lit("["), prompt, F.lit("]"))).otherwise(F.lit("")),
        F.when(rerank != DEFAULT_RERANK, F.concat(F.lit("+"), rerank)).otherwise(F.lit("")),
    )


def run_slug(model: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(model), "[^a-z0-9.]+", "-"), F.lit("-"))


def model_family(model: Column) -> Column:
    """Leading letters of the last path part of a model name, else the whole name."""
    low = F.lower(model)
    last = F.substring_index(low, "/", -1)
    head = F.regexp_extract(last, "^[a-z]+", 0)
    return F.when(head != "", head).otherwise(low)


def run_folder(model: Column, prompt: Column, rerank: Column, legacy_model: str) -> Column:
    """Result folder of a run; the legacy model with default settings owns the root."""
    default = (model == legacy_model) & (prompt == DEFAULT_PROMPT) & (rerank == DEFAULT_RERANK)
    return F.when(default, F.lit(".")).otherwise(
        F.concat(
            run_slug(model),
            F.when(prompt != DEFAULT_PROMPT, F.concat(F.lit("__"), prompt)).otherwise(F.lit("")),
            F.when(rerank != DEFAULT_RERANK, F.concat(F.lit("__"), rerank)).otherwise(F.lit("")),
        )
    )


def write_generations(rows: DataFrame, path: str, models: Sequence[str]) -> None:
    """JSONL under <path>/<run folder>/, a pass over the stored rows per model of `models`.

    A single partitioned write sorts the wide rows of a task by folder, which holds them all in memory.
    """
    rows = materialise(rows, "generations")
    for model in models:
        slug = rows.sparkSession.range(1).select(run_slug(F.lit(model))).first()[0]
        rows.where(F.col("model") == model).write.json(f"{path}/folder={slug}")


def read_generations(spark: SparkSession, path: str) -> DataFrame:
    """JSONL under <path>/<run folder>/; a missing model name falls back to the folder."""
    rows = spark.read.schema(GENERATION_SCHEMA).option("recursiveFileLookup", "true").json(path)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    rows = rows.withColumn("model", F.coalesce("model", folder))
    return rows.withColumn(
        "run", run_label(F.col("model"), F.col("prompt"), F.col("rerank"), always_prompt=True)
    )


def append_new(rows: DataFrame, path: str, key: Sequence[str], schema: str) -> None:
    """Append the rows whose key is not in the log yet; a second call adds nothing."""
    todo = resume(rows, read_log(rows.sparkSession, path, schema), key)
    todo.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def resume(rows: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key does not occur in `done`."""
    return rows.join(done.select(*key).distinct(), list(key), "left_anti")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GOLDEN_SCHEMA).option("multiLine", "true").json(path)


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Semicolon CSV, every field quoted, with or without a byte order mark."""
    return (
        spark.read.option("sep", ";").option("header", "true").option("quote", '"')
        .option("escape", '"').option("multiLine", "true").csv(path)
    )


def write_sheet(rows: DataFrame, path: str) -> None:
    (
        rows.write.mode("overwrite").option("sep", ";").option("header", "true")
        .option("quoteAll", "true").option("escape", '"').csv(path)
    )


def with_label(sheet: DataFrame, column: str = "rotulo") -> DataFrame:
    """Upper-cased, trimmed label and its kind: blank, refusal, label or invalid."""
    label = F.upper(F.trim(F.coalesce(F.col(column), F.lit(""))))
    return sheet.withColumn("label", label).withColumn(
        "label_kind",
        F.when(F.col("label") == "", "blank")
        .when(F.col("label") == "R", "refusal")
        .when(F.col("label").isin("0", "1", "2"), "label")
        .otherwise("invalid"),
    )


def read_activities(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ACTIVITY_SCHEMA).json(path)


def judge_scores(raw: DataFrame, judge: str | None = None) -> DataFrame:
    """External judge output to one row per (judge, run, id, system): known metrics only, NaN to null.

    The run is part of the key if there is such a column. A metric column may carry a suffix after the
    known name, e.g. a mode in brackets.
    """
    key = [c for c in ("judge", "run", "id", "system") if c in raw.columns]

    def pick(metric: str) -> Column:
        names = [c for c in raw.columns if c == metric or c.startswith(metric + "(")]
        values = [F.col(f"`{c}`").try_cast("double") for c in names]
        cleaned = [F.when(~F.isnan(v), v) for v in values]
        return (F.coalesce(*cleaned) if cleaned else F.lit(None).cast("double")).alias(metric)

    out = raw.select(*key, "tier", *[pick(m) for m in JUDGE_METRICS])
    out = out.groupBy(*key).agg(
        F.max("tier").alias("tier"), *[F.max(m).alias(m) for m in JUDGE_METRICS]
    )
    return out if judge is None else out.where(F.col("judge") == judge)
