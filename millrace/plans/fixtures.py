"""Views over the given tables that play the roles of machine log, index, questions and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.functions.columns import num1, second_text, ts_text
from millrace.functions.process_rules import STATIONS
from millrace.operators import episodes as ep
from millrace.operators import ann, knn
from millrace.operators import golden as gs
from millrace.operators import lexical as lx
from millrace.operators import metrics as mt
from millrace.session import materialise, scratch_path, tune
from millrace.sources import results as rs

# Task of a working station, by station code.
WORK_TASKS = {
    "MM_1": "milling the workpiece",
    "EC_1": "detecting the workpiece color",
    "SM_1": "sorting the workpiece",
    "HBW_1": "unloading a workpiece from slot 1",
    "OV_1": "burning the workpiece",
    "VGR_1": "picking up and transporting the workpiece from the sink_1 to the oven",
    "WT_1": "conveying the workpiece",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


# Rows of a source that one task parses and sorts.
ROWS_PER_TASK = 250_000


def spread(rows: DataFrame) -> DataFrame:
    """The rows over all cores, at most about ROWS_PER_TASK to a task, if the source has fewer splits than that takes.

    Parsing is bound by the processor, and parsed lines are sorted by the task that parsed them; a source has a split per
    core or per row group, whatever its rows. A table of many files is left where it is.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, -(-rows.count() // ROWS_PER_TASK))
    return rows.repartition(tasks) if rows.rdd.getNumPartitions() < tasks else rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def _station(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in STATIONS]), (code % len(STATIONS) + 1).cast("int"))


def factory_events(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None) -> DataFrame:
    """The machine log; with `ids` (event_id) only those events, chosen before anything is parsed or moved."""
    ev = table(spark, sf_dir, "events")
    ev = spread(ev) if ids is None else ev.join(ids, "event_id", "left_semi")
    work = F.create_map(*[F.lit(x) for kv in WORK_TASKS.items() for x in kv])
    kind = F.col("event_type")
    return ev.select(
        "event_id",
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"),
        _station(F.col("user_id")).alias("station"),
        F.col("ts").cast("timestamp").alias("event_timestamp"),
        F.when(kind == "signup", "ready").otherwise("not ready").alias("current_state"),
        F.when(kind == "signup", F.lit(None).cast("string"))
        .when(kind.isin("error", "click"), "calibrating all components")
        .otherwise(F.element_at(work, _station(F.col("user_id")))).alias("current_task"),
        F.when(kind == "signup", F.lit(None).cast("string"))
        .when(kind.isin("error", "click"), "calibrating motor 4")
        .otherwise("moving towards the oven").alias("current_sub_task"),
        F.col("value").alias("current_task_duration"),
        F.create_map(
            F.lit("k"), F.get_json_object("props", "$.k"),
            F.lit("m"), (F.col("event_id") % 3).cast("string"),
            F.lit("pos"), F.col("value").cast("decimal(10,2)").cast("string"),
        ).alias("sensors"),
        F.when(F.col("event_id") % 10 < 7, "train").otherwise("test").alias("split"),
    )


def bronze_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NDJSON text of the machine log with broken, blank and repeated lines."""
    ev = factory_events(spark, sf_dir)
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    text = lambda c: F.coalesce(quoted(F.col(c)), F.lit("null"))
    doc = F.concat(
        F.lit('{"id": '), text("id"), F.lit(', "station": '), text("station"),
        F.lit(', "timestamp": "'), ts_text("event_timestamp"),
        F.lit('", "current_state": '), text("current_state"),
        F.lit(', "current_task": '), text("current_task"),
        F.lit(', "current_task_duration": '), F.col("current_task_duration").cast("string"),
        F.lit(', "current_sub_task": '), text("current_sub_task"),
        F.lit(', "k": '), F.col("sensors")["k"], F.lit(', "m": '), F.col("sensors")["m"],
        F.lit(', "pos": '), quoted(F.col("sensors")["pos"]), F.lit("}"),
    )
    n = F.col("event_id")
    value = (
        F.when(n % 97 == 0, F.substring(doc, 1, 60)).when(n % 101 == 0, F.lit("  "))
        .when(n % 103 == 0, F.lit("[1]")).when(n % 107 == 0, F.lit('{"station": "MM_1"}'))
        .when(n % 109 == 0, F.concat(F.lit('{"id": '), text("id"), F.lit(', "timestamp": "soon"}')))
        .otherwise(doc)
    )
    # A second copy of some rows arrives with the test file.
    copies = F.when(n % 50 == 0, F.array("split", F.lit("test"))).otherwise(F.array("split"))
    return ev.select(value.alias("value"), F.explode(copies).alias("split"))


_GOLD: dict[tuple[str, str], DataFrame] = {}


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The episode table, written once per session and folder as the pipeline would keep it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _GOLD:
        rows = ep.gold_episodes(factory_events(spark, sf_dir))
        _GOLD[key] = materialise(rows, "gold")
    tune(spark)
    return _GOLD[key]


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ep.build_episodes(factory_events(spark, sf_dir))


def mined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not-ready episodes whose task names the reading at its start, so that tasks vary."""
    return gold(spark, sf_dir).where("current_state = 'not ready'").withColumn(
        "current_task",
        F.concat("current_task", F.lit(" (k "), F.col("sensors_start")["k"], F.lit(")")),
    )


# Test windows are wide because the given events are minutes apart.
WINDOW_S = 600
DEDUP_S = 3600
PAIR_WINDOW_S = 60.0


def index_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The searchable table, written once per session and folder as the pipeline would keep it; questions read it several times."""
    return spark.read.parquet(_stored(spark, sf_dir, "index_rows", lambda path: index_rows(spark, sf_dir).write.parquet(path)))


def index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a vector."""
    vec = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("event_id"), "embedding", "label"
    )
    ev = factory_events(spark, sf_dir, vec.select("event_id")).drop("split")
    rows = ev.join(vec, "event_id")
    log = F.concat(
        F.lit("Estação "), "station", F.lit(" ficou "), "current_state", F.lit(" por "),
        num1(F.col("current_task_duration")), F.lit("s, leitura k "), F.col("sensors")["k"],
        F.lit(" m "), F.col("sensors")["m"], F.lit("."),
    )
    return rows.select(
        F.col("event_id").alias("vec_id"),
        F.col("id").alias("event_id"), "station",
        F.col("event_timestamp").alias("start_ts"), F.col("event_timestamp").alias("end_ts"),
        "current_state",
        F.coalesce("current_task", F.lit("")).alias("current_task"),
        F.coalesce("current_sub_task", F.lit("")).alias("current_sub_task"),
        F.col("current_task_duration").alias("duration_s"),
        (F.col("sensors")["m"] == "0").alias("is_anomaly"),
        log.alias("log_text"), F.col("sensors")["k"].alias("k"), "embedding", "label",
    )


_STORED: dict[tuple[str, str, str], str] = {}


def _stored(spark: SparkSession, sf_dir: str, name: str, write) -> str:
    """Path of an index that `write(path)` makes once per session and folder, as the pipeline would keep it."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = scratch_path(spark, name)
        write(path)
        _STORED[key] = path
    tune(spark)
    return _STORED[key]


def index_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The searchable table in folders of station and day."""
    return knn.open_store(spark, _stored(spark, sf_dir, "vectors", lambda path: knn.store(index_table(spark, sf_dir), path)))


def hit_texts(spark: SparkSession, sf_dir: str) -> lx.TextIndex:
    return lx.TextIndex(spark, _stored(spark, sf_dir, "hit_texts", lambda path: lx.of_hits(index_table(spark, sf_dir), path)))


def document_texts(spark: SparkSession, sf_dir: str) -> lx.TextIndex:
    return lx.TextIndex(spark, _stored(spark, sf_dir, "document_texts", lambda path: lx.build(documents(spark, sf_dir), path)))


# Trained lists: 8 cells of 8 lists. The given vectors have no clusters to speak of, so recall needs many of them.
LIST_CELLS, LISTS_PER_CELL, NPROBE = 8, 8, 40


def list_index(spark: SparkSession, sf_dir: str) -> ann.ListIndex:
    return ann.ListIndex(spark, _stored(spark, sf_dir, "lists", lambda path: ann.build(
        index_store(spark, sf_dir), path, LIST_CELLS, LISTS_PER_CELL)))


def _pair_of(n: Column) -> Column:
    return n + 1 - 2 * (n % 2)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per indexed row, in six shapes; its vector is that of the row's neighbour."""
    rows = index_table(spark, sf_dir)
    own = rows.select("vec_id", "event_id", "station", "start_ts", "k")
    other = rows.select(
        F.col("vec_id").alias("_pair"), F.col("event_id").alias("pair_id"),
        F.col("station").alias("pair_station"), "embedding",
    )
    joined = own.join(other, _pair_of(F.col("vec_id")) == F.col("_pair"))
    shape = F.col("vec_id") % 6
    second = second_text("start_ts")
    k = F.concat(F.lit(" com leitura k "), "k", F.lit("?"))
    st = F.concat(F.lit("A estação "), "station")
    question = (
        F.when(shape == 0, F.concat(st, F.lit(" ficou not ready em "), second, k))
        .when(shape == 1, F.concat(st, F.lit(" ficou not ready em "), F.substring(second, 1, 16), k))
        .when(shape == 2, F.concat(F.lit("O que a estação "), "station", F.lit(" fez"), k))
        .when(shape == 3, F.concat(
            F.lit("Por volta de "), second, F.lit(", o que as estações "), "station",
            F.lit(" e "), "pair_station", F.lit(" faziam?")))
        .when(shape == 4, F.concat(F.lit("O que ocorreu em "), second, k))
        .otherwise(F.concat(
            st, F.lit(" parou em "),
            second_text(F.col("start_ts") + F.expr("interval 25 minutes")), F.lit("?")))
    )
    return joined.select(
        F.concat(F.lit("q"), F.lpad(F.col("vec_id").cast("string"), 6, "0")).alias("question_id"),
        question.alias("question"), "embedding",
        F.when(shape < 2, "factual").when(shape == 3, "cross_station").otherwise("causal")
        .alias("tier"),
        F.when(shape == 2, "any").otherwise("all").alias("evidence_mode"),
        F.when(F.col("vec_id") % 3 == 0, "sem_rag").when(F.col("vec_id") % 3 == 1, "vetorial")
        .otherwise("filtrada").alias("mode"),
        F.when(shape.isin(2, 3), F.array("event_id", "pair_id"))
        .otherwise(F.array("event_id")).alias("evidence_ids"),
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("question_id", F.explode("evidence_ids").alias("event_id"))


RUNS = ("alpha:7b", "beta:9b")
SYSTEMS = ("baseline", "rag_vetorial", "rag_filtrado")


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of two runs and three systems to one question per not-ready episode."""
    base = gold(spark, sf_dir).where("current_state = 'not ready'").withColumnRenamed("text", "log_text")
    line = tx.context_text(ts_text("start_ts"))
    base = base.withColumn("_ctx", F.struct(F.col("episode_id").alias("id"), line.alias("line")))
    day = Window.partitionBy("station", F.to_date("start_ts")).orderBy("start_ts", "episode_id")
    base = base.withColumn("_l1", F.lag("_ctx", 1).over(day)).withColumn(
        "_l2", F.lag("_ctx", 2).over(day)
    )
    h = (
        F.dayofmonth("start_ts") * 1440 + F.hour("start_ts") * 60 + F.minute("start_ts")
        + F.col("n_events")
    )
    rows = base.withColumn("h", h).withColumn(
        "_rs",
        F.explode(F.array(*[
            F.struct(F.lit(r).alias("r"), F.lit(m).alias("model"), F.lit(s).alias("s"),
                     F.lit(name).alias("system"))
            for r, m in enumerate(RUNS) for s, name in enumerate(SYSTEMS)
        ])),
    ).select("*", "_rs.*").where("r = 0 or station <> 'WT_1'")
    rows = rows.withColumn("x", F.col("h") + 3 * F.col("s") + 5 * F.col("r"))
    hits = (
        F.when(F.col("s") == 0, F.array().cast(_ctx_type()))
        .when(F.col("s") == 1, F.when(F.col("x") % 2 == 0, F.array("_l1", "_ctx", "_l2"))
              .otherwise(F.array("_l1", "_l2")))
        .otherwise(F.when(F.col("x") % 3 != 0, F.array("_ctx", "_l1")).otherwise(F.array("_l2", "_l1")))
    )
    rows = rows.withColumn("_hits", F.filter(hits, lambda c: c.isNotNull()))
    motor = F.replace("current_sub_task", F.lit("calibrating "), F.lit(""))
    judged = F.col("h") % 4 == 0
    question = F.when(judged, gs.anomaly_question(motor, second_text("start_ts"))).otherwise(
        gs.time_question(F.col("station"), second_text("start_ts"))
    )
    rows = rows.withColumn("question", question).withColumn(
        "reference", F.when(judged, gs.anomaly_reference(motor)).otherwise(gs.fact())
    )
    number = num1(F.col("duration_s"))
    x = F.col("x") % 7
    answer = (
        F.when(x == 0, F.col("reference"))
        .when(x == 1, F.translate("reference", "0123456789", "1234567890"))
        .when(x == 2, F.lit(
            "Não há informação suficiente nos episódios para responder a essa pergunta."))
        .when(x == 3, F.concat("log_text", F.lit(" Causa: não há registro da ação corretiva.")))
        .when(x == 4, F.concat(
            F.lit("1. **Diagnóstico**: "), "log_text",
            F.lit("\n\n2. Causa provável: duração de "), F.replace(number, F.lit("."), F.lit(",")),
            F.lit("s na estação "), "station",
            F.lit(".\n\n3. Ação corretiva: verificar os sensores da estação "), "station",
            F.lit(" antes de reiniciar. Não foi possível confirmar a causa.")))
        .when(x == 5, F.concat(F.lit("Sim, a duração foi anormalmente longa: "), number, F.lit("s.")))
        .otherwise(F.lit("Não, a duração está dentro do normal."))
    )
    rows = rows.withColumn("answer", answer)
    prompt_tokens = (F.length("question") + 100 * F.col("s")).cast("bigint")
    n_answer = F.length("answer").cast("bigint")
    return rows.select(
        "model", F.lit("estrito").alias("prompt"), F.lit("off").alias("rerank"),
        F.concat("model", F.lit("[estrito]")).alias("run"),
        F.col("episode_id").alias("id"),
        F.when(F.col("h") % 3 == 0, "factual").when(F.col("h") % 3 == 1, "cross_station")
        .otherwise("causal").alias("tier"),
        F.when(judged, F.when(F.col("is_anomaly"), "anomalia_sim").otherwise("anomalia_nao"))
        .otherwise("estacao_horario").alias("subtype"),
        "system", "question", "reference", "answer",
        F.transform("_hits", lambda c: c["id"]).alias("retrieved_ids"),
        F.transform("_hits", lambda c: c["line"]).alias("retrieved_contexts"),
        F.transform("_hits", lambda c, i: (F.lit(100) - i) / 100.0).alias("scores"),
        F.struct(
            prompt_tokens.alias("prompt_tokens"), n_answer.alias("completion_tokens"),
            (prompt_tokens + n_answer).alias("total_tokens"),
        ).alias("usage"),
        (F.col("x") % 50 / 10.0).alias("latency_s"),
        "h", "s", "r", "x",
    )


def _ctx_type() -> str:
    return "array<struct<id: string, line: string>>"


def answered_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of every answered question: its own episode."""
    return gold(spark, sf_dir).where("current_state = 'not ready'").select(
        F.col("episode_id").alias("id"),
        F.array("episode_id").alias("evidence_episode_ids"), F.lit("all").alias("evidence_mode"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge scores of the answers; the last metric keeps the long name of its source."""
    g = generations(spark, sf_dir).select("run", "id", "system", "tier", "h", "s", "r", "x")
    rag = F.col("s") > 0
    hundredth = lambda e: (e % 101) / 100.0
    h, s, r, x = (F.col(c) for c in "hsrx")
    nan = F.lit(float("nan"))
    return g.select(
        F.lit("phi4").alias("judge"), "run", "id", "system", "tier",
        F.when(rag, F.when(x % 13 == 0, nan).otherwise(hundredth(h * 37 + s * 11 + r * 7)))
        .alias("faithfulness"),
        hundredth(h * 17 + s).alias("answer_relevancy"),
        F.when(rag, hundredth(h * 23 + s)).alias("llm_context_precision_with_reference"),
        F.when(rag, hundredth(h * 31 + r)).alias("context_recall"),
        F.when(x % 17 == 0, nan).otherwise(hundredth(h * 29 + r))
        .alias("factual_correctness(mode=f1)"),
    )


def claim_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict per context line of an answer with retrieval, some unreadable, in the role of the external checker's."""
    g = generations(spark, sf_dir).where("system <> 'baseline'")
    rows = g.select("run", "id", "system", "x", F.posexplode_outer("retrieved_contexts").alias("pos", "claim"))
    code = (F.col("x") + F.col("pos")) % 4
    return rows.select(
        "run", "id", "system", (F.col("x") % 3).cast("int").alias("n_declined"), (F.col("pos") + 1).cast("int").alias("claim_no"),
        F.when(code == 3, F.lit(None)).otherwise(code > 0).alias("supported"),
    )


def tidy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.judge_scores(scores(spark, sf_dir))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.report_rows(
        generations(spark, sf_dir), answered_golden(spark, sf_dir), tidy_scores(spark, sf_dir)
    )


def judge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    n = F.col("doc_id")
    return lab.select(
        "doc_id", (F.col("quality") + 1 - F.col("toxic")).cast("int").alias("human"),
        ((n * 37) % 101 / 100.0).alias("judge"), (n % 3).cast("int").alias("run"),
    )


def label_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    mark = (
        F.when(n % 17 == 0, "").when(n % 19 == 0, " r ").when(n % 23 == 0, "x")
        .otherwise(F.col("human").cast("string"))
    )
    return judge_pairs(spark, sf_dir).select(
        F.concat(F.lit("A"), n.cast("string")).alias("amostra"), mark.alias("rotulo"),
        F.lit('o "texto"; longo').alias("comentario"), F.col("judge"), "run",
    )


def noise_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, j = F.col("doc_id"), F.col("judge")
    reps = F.array(
        j, F.when(n % 5 == 0, j + 0.125).otherwise(j), F.when(n % 7 == 0, F.lit(None)).otherwise(j),
    )
    return judge_pairs(spark, sf_dir).select(
        "run", n.alias("sample"), F.posexplode(reps).alias("rep", "value")
    )


def perturb_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, j = F.col("doc_id"), F.col("judge")
    c = n % 5
    return judge_pairs(spark, sf_dir).select(
        F.lpad(n.cast("string"), 9, "0").alias("key"),
        F.element_at(
            F.array(*[F.lit(x) for x in ("neutra", "numero", "estacao", "contexto", "referencia")]),
            (c + 1).cast("int"),
        ).alias("cond"),
        F.when(c < 4, j).alias("original"),
        F.when(c == 0, j + (n % 9 - 4) / 64.0).otherwise(F.greatest(F.lit(0.0), j - c / 16.0))
        .alias("perturbed"),
    )


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One activity per (station, hour) with events, from the hour start over forty minutes."""
    hours = factory_events(spark, sf_dir).select(
        "station", F.date_trunc("hour", "event_timestamp").alias("startTime")
    ).distinct()
    return hours.select(
        F.concat(F.lit("Task_"), "station", F.lit("_"), F.date_format("startTime", "yyyyMMddHH"))
        .alias("activityId"),
        F.concat(F.lit("process_"), "station").alias("processDefinitionKey"),
        "startTime", (F.col("startTime") + F.expr("interval 40 minutes")).alias("endTime"),
        F.lit(2400000).cast("bigint").alias("durationInMillis"),
    )
