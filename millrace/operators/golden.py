"""Question set mined from not-ready episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.columns import hash_order, micros, num1, second_text
from millrace.operators.ordered import running_total
from millrace.operators.rules import impact_groups, impact_picks

SEED = 42
TIER_SIZE = 8
WINDOW_S = 5.0
# Station order of the two factual halves, and quotas per station pair.
TIME_STATIONS = ("HBW_1", "VGR_1", "OV_1", "MM_1", "SM_1")
DESCRIBED_STATIONS = ("HBW_1", "OV_1", "VGR_1", "MM_1", "SM_1")
PAIR_QUOTAS = (("HBW_1", "VGR_1", 4), ("MM_1", "SM_1", 2), ("SM_1", "VGR_1", 1), ("HBW_1", "OV_1", 1))
MOTOR = "calibrating motor 4"
N_POSITIVE, N_NEGATIVE = 3, 2
IMPACT = "impacto_bpm"
MICROS = 1_000_000


def drop_calibration(episodes: DataFrame) -> DataFrame:
    return episodes.where(~F.col("current_task").contains("calibrat"))


def unique_by(episodes: DataFrame, *keys: Column | str) -> DataFrame:
    """(episode_id, station, start_ts) of episodes that are alone in their key group.

    An aggregation with map-side merge, not a window: a crowded group is one row per task.
    """
    return episodes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("episode_id").alias("episode_id")
    ).where("_n = 1").select("episode_id")


def unique_in_second(episodes: DataFrame) -> DataFrame:
    return unique_by(episodes, "station", F.date_trunc("second", "start_ts"))


def unique_combo(episodes: DataFrame) -> DataFrame:
    return unique_by(episodes, "station", "current_task", "current_sub_task")


def keep_ids(episodes: DataFrame, ids: DataFrame) -> DataFrame:
    return episodes.join(ids, "episode_id", "left_semi")


def range_count(episodes: DataFrame, window_s: float) -> DataFrame:
    """Per episode: episodes of its station that start within ± window_s of its start.

    Starts and window ends are laid out on one time line; the count is the difference of two
    running totals, so a crowded station or a crowded moment is split over slices.
    """
    w = int(window_s * MICROS)
    at = micros("start_ts")
    marks = episodes.select(
        "station", "episode_id",
        F.explode(F.array(
            F.struct((at - w).alias("us"), F.lit(0).alias("kind")),
            F.struct(at.alias("us"), F.lit(1).alias("kind")),
            F.struct((at + w).alias("us"), F.lit(2).alias("kind")),
        )).alias("_m"),
    ).select(
        "station", "episode_id", "_m.*", (F.col("_m.kind") == 1).cast("bigint").alias("_point")
    )
    counted = running_total(marks, ["station"], ["us", "kind", "episode_id"], "_point", "_seen")
    return counted.groupBy("station", "episode_id").agg(
        (F.max(F.when(F.col("kind") == 2, F.col("_seen")))
         - F.max(F.when(F.col("kind") == 0, F.col("_seen")))).alias("n_near")
    )


def _buckets(episodes: DataFrame, w: int) -> DataFrame:
    """One row per (station, time bucket of width w): count, outermost starts, second start."""
    rows = episodes.select(
        "station", "episode_id", micros("start_ts").alias("us"),
        F.floor(micros("start_ts") / w).alias("bucket"),
    )
    summary = rows.groupBy("station", "bucket").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct("us", "episode_id")).alias("lo"),
        F.max("us").alias("hi"),
    )
    second = Window.partitionBy("station", "bucket").orderBy("us", "episode_id")
    # The rank limit runs before the shuffle too: two rows per bucket and task leave it.
    nexts = (
        rows.withColumn("_rn", F.row_number().over(second)).where("_rn <= 2").where("_rn = 2")
        .select("station", "bucket", F.col("us").alias("second_us"))
    )
    return summary.join(nexts, ["station", "bucket"], "left")


def unique_in_window(episodes: DataFrame, window_s: float = WINDOW_S) -> DataFrame:
    """(station, us, episode_id) of episodes alone in their station within ± window_s.

    With buckets as wide as the window only three neighbours matter: the own bucket must hold one
    start, the last start of the bucket before and the first of the bucket after must be outside.
    """
    w = int(window_s * MICROS)
    return _alone(_buckets(episodes, w), w)


def _alone(buckets: DataFrame, w: int) -> DataFrame:
    around = buckets.select(
        "station",
        F.explode(F.array(
            F.struct((F.col("bucket") + 1).alias("bucket"), F.lit(-1).alias("side"),
                     F.col("hi").alias("edge"), F.lit(0).cast("bigint").alias("n"),
                     F.lit(None).cast("string").alias("episode_id")),
            F.struct((F.col("bucket") - 1).alias("bucket"), F.lit(1).alias("side"),
                     F.col("lo.us").alias("edge"), F.lit(0).cast("bigint").alias("n"),
                     F.lit(None).cast("string").alias("episode_id")),
            F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("side"),
                     F.col("lo.us").alias("edge"), F.col("n").alias("n"),
                     F.col("lo.episode_id").alias("episode_id")),
        )).alias("_a"),
    ).select("station", "_a.*")
    joined = around.groupBy("station", "bucket").agg(
        F.max(F.when(F.col("side") == -1, F.col("edge"))).alias("before"),
        F.max(F.when(F.col("side") == 1, F.col("edge"))).alias("after"),
        F.max(F.when(F.col("side") == 0, F.col("edge"))).alias("us"),
        F.max("n").alias("n"),
        F.max("episode_id").alias("episode_id"),
    )
    alone = (
        (F.col("n") == 1)
        & (F.col("before").isNull() | (F.col("before") < F.col("us") - w))
        & (F.col("after").isNull() | (F.col("after") > F.col("us") + w))
    )
    return joined.where(alone).select("station", "bucket", "us", "episode_id")


def cross_station_pairs(episodes: DataFrame, window_s: float = WINDOW_S) -> DataFrame:
    """(a, b): b of another station starts 0 … window-1 s after a, and each is the only episode of
    its station within ± window_s of a's start (hence also alone in its second).

    a's are at least a window apart per station, and the b side is one summary row per station and
    bucket, so a bucket yields at most one pair per pair of stations however full it is.
    """
    w = int(window_s * MICROS)
    summary = _buckets(episodes, w)
    a = _alone(summary, w).select(
        F.col("station").alias("a_station"), F.col("us").alias("a_us"),
        F.col("episode_id").alias("a_id"), "bucket",
    )
    spots = a.select("*", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("side")).select(
        "a_station", "a_us", "a_id", "side", (F.col("bucket") + F.col("side")).alias("bucket")
    )
    near = spots.join(summary, "bucket").where("station <> a_station")
    lo, hi = F.col("a_us") - w, F.col("a_us") + w
    side = F.col("side")
    inside = (
        F.when(side == -1, F.when(F.col("hi") >= lo, F.lit(2)).otherwise(F.lit(0)))
        .when(side == 0, F.least("n", F.lit(2)))
        .otherwise(
            F.when(F.col("lo.us") > hi, F.lit(0))
            .when(F.col("second_us") <= hi, F.lit(2)).otherwise(F.lit(1))
        )
    )
    per_station = near.groupBy("a_id", "a_station", "a_us", "station").agg(
        F.sum(inside).alias("_n"),
        F.min(F.when((side >= 0) & (F.col("lo.us") <= hi), F.col("lo"))).alias("_b"),
    )
    gap = F.col("_b.us") - F.col("a_us")
    return per_station.where((F.col("_n") == 1) & (gap >= 0) & (gap <= w - MICROS)).select(
        "a_id", "a_station", F.col("_b.episode_id").alias("b_id"),
        F.col("station").alias("b_station"), gap.alias("gap_us"),
    )


def station_round_robin(
    candidates: DataFrame, stations: tuple[str, ...], n: int, seed: int | str = SEED
) -> DataFrame:
    """Item i is the next unused candidate of station i mod S, in a seeded order per station."""
    order = F.array_position(F.array(*[F.lit(s) for s in stations]), F.col("station"))
    w = Window.partitionBy("station").orderBy(hash_order(seed, F.col("episode_id")), "episode_id")
    ranked = (
        candidates.where(F.col("station").isin(*stations))
        .withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n)
    )
    return ranked.withColumn("_station_no", order).orderBy("turn", "_station_no").limit(n).withColumn(
        "position", F.row_number().over(Window.orderBy("turn", "_station_no"))
    ).drop("turn", "_station_no")


def quota_pairs(pairs: DataFrame, n: int = TIER_SIZE, seed: int = SEED) -> DataFrame:
    """n pairs, an episode at most once: quotas per station pair first, then rounds over the pairs
    of stations, frequent ones first.

    A pair survives if no pair with a better seeded rank shares one of its episodes.
    """
    keyed = pairs.withColumn("s1", F.least("a_station", "b_station")).withColumn(
        "s2", F.greatest("a_station", "b_station")
    ).withColumn("_rank", hash_order(seed, F.concat("a_id", F.lit("|"), "b_id")))
    best = (
        keyed.select(F.explode(F.array("a_id", "b_id")).alias("_ep"), "_rank")
        .groupBy("_ep").agg(F.min("_rank").alias("_best"))
    )
    side = lambda name: best.select(
        F.col("_ep").alias(name), F.col("_best").alias(f"_{name}")
    )
    free = keyed.join(side("a_id"), "a_id").join(side("b_id"), "b_id").where(
        "_rank = _a_id and _rank = _b_id"
    ).drop("_a_id", "_b_id")
    frequency = keyed.groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("_freq"))
    quotas = F.create_map(*[
        x for i, (s1, s2, q) in enumerate(PAIR_QUOTAS)
        for x in (F.lit(f"{s1}|{s2}"), F.struct(F.lit(q).alias("q"), F.lit(i).alias("pos")))
    ])
    quota = F.try_element_at(quotas, F.concat("s1", F.lit("|"), "s2"))
    w = Window.partitionBy("s1", "s2").orderBy("_rank")
    # A station pair can supply at most n pairs, so the rank limit cuts before the shuffle.
    ranked = free.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    placed = ranked.join(frequency, ["s1", "s2"]).withColumn("_q", F.coalesce(quota["q"], F.lit(0)))
    in_quota = F.col("_r") <= F.col("_q")
    order = [
        F.when(in_quota, F.lit(0)).otherwise(F.lit(1)),
        F.when(in_quota, quota["pos"]).otherwise(F.col("_r") - F.col("_q")),
        F.when(in_quota, F.col("_r")).otherwise(-F.col("_freq")),
        F.col("s1"), F.col("s2"),
    ]
    top = placed.select(
        "a_id", "a_station", "b_id", "b_station",
        *[c.alias(f"_o{i}") for i, c in enumerate(order)],
    ).orderBy(*[f"_o{i}" for i in range(5)]).limit(n)
    return top.withColumn(
        "position", F.row_number().over(Window.orderBy(*[f"_o{i}" for i in range(5)]))
    ).drop(*[f"_o{i}" for i in range(5)])


def near_median(episodes: DataFrame) -> DataFrame:
    """Normal episodes close to their sub-task median."""
    return episodes.where(
        "not is_anomaly and duration_s >= 0.8 * subtask_median_s"
        " and duration_s <= 1.25 * subtask_median_s"
    )


def sampled(episodes: DataFrame, n: int, seed: int | str) -> DataFrame:
    return episodes.orderBy(hash_order(seed, F.col("episode_id")), "episode_id").limit(n)


def anomaly_cases(
    episodes: DataFrame, n_pos: int = N_POSITIVE, n_neg: int = N_NEGATIVE, seed: int = SEED
) -> DataFrame:
    """Sampled anomalies and sampled near-median episodes of one sub-task."""
    motor = episodes.where(F.col("current_sub_task") == MOTOR)
    alone = keep_ids(motor, unique_in_second(motor))
    return sampled(alone.where("is_anomaly"), n_pos, seed).unionByName(
        sampled(near_median(alone), n_neg, seed)
    )


# Fixed wording of questions and references.

def fact(prefix: str = "") -> Column:
    c = lambda name: F.col(prefix + name)
    return F.concat(
        F.lit("A estação "), c("station"), F.lit(" ficou not ready por "), num1(c("duration_s")),
        F.lit("s executando '"), c("current_task"), F.lit("', sub-tarefa '"),
        c("current_sub_task"), F.lit("'."),
    )


def time_question(station: Column, second: Column) -> Column:
    return F.concat(
        F.lit("A estação "), station, F.lit(" ficou not ready em "), second,
        F.lit(". Qual tarefa e sub-tarefa ela estava executando e quanto tempo durou?"),
    )


def described_question() -> Column:
    return F.concat(
        F.lit("Qual foi a duração do episódio em que a estação "), "station",
        F.lit(" executou '"), "current_task", F.lit("' na sub-tarefa '"), "current_sub_task",
        F.lit("'?"),
    )


def pair_question(a_station: Column, b_station: Column, second: Column) -> Column:
    return F.concat(
        F.lit("Por volta de "), second, F.lit(", as estações "), a_station, F.lit(" e "), b_station,
        F.lit(
            " ficaram not ready quase ao mesmo tempo. O que cada uma estava fazendo e por quanto "
            "tempo?"
        ),
    )


def anomaly_question(motor: Column, second: Column) -> Column:
    return F.concat(
        F.lit("A calibração do "), motor, F.lit(" da estação "), "station",
        F.lit(" iniciada em "), second,
        F.lit(" foi anormalmente longa em relação ao tempo típico?"),
    )


def anomaly_reference(motor: Column) -> Column:
    excess = F.col("duration_s").cast("decimal(18,3)") - F.col("subtask_median_s").cast("decimal(18,3)")
    yes = F.concat(
        F.lit("Sim. A calibração do "), motor, F.lit(" durou "), num1(F.col("duration_s")),
        F.lit("s, "), num1(excess), F.lit("s acima da mediana de "),
        num1(F.col("subtask_median_s")), F.lit("s para essa sub-tarefa (limiar "),
        num1(F.col("subtask_threshold_s")), F.lit("s): duração anômala."),
    )
    no = F.concat(
        F.lit("Não. A calibração do "), motor, F.lit(" durou "), num1(F.col("duration_s")),
        F.lit("s, dentro do normal (mediana de "), num1(F.col("subtask_median_s")),
        F.lit("s para essa sub-tarefa)."),
    )
    return F.when(F.col("is_anomaly"), yes).otherwise(no)


def impact_question() -> Column:
    return F.concat(
        F.lit("Se a estação "), "station", F.lit(" ficar parada enquanto executa '"),
        "current_task",
        F.lit(
            "', qual atividade do processo é interrompida e qual é a próxima estação da linha?"
        ),
    )


def impact_reference() -> Column:
    return F.concat(
        F.lit("A atividade interrompida é '"), "activity", F.lit("' (processo "), "process",
        F.lit("); a próxima estação do processo é "), "next_station", F.lit("."),
    )


def _item(rows, subtype, question, reference, ids, mode, stations, moment, flag) -> DataFrame:
    return rows.select(
        "position",
        (subtype if isinstance(subtype, Column) else F.lit(subtype)).alias("subtype"),
        question.alias("question"), reference.alias("reference"),
        ids.alias("evidence_episode_ids"), F.lit(mode).alias("evidence_mode"),
        F.struct(
            stations.alias("stations"), moment.cast("string").alias("timestamp"),
            flag.cast("boolean").alias("is_anomaly"),
        ).alias("meta"),
    )



def factual_items(episodes: DataFrame, window_s: float, n: int = TIER_SIZE) -> DataFrame:
    second = second_text("start_ts")
    base = drop_calibration(episodes)
    timed = station_round_robin(
        keep_ids(base, unique_in_window(episodes, window_s).select("episode_id")),
        TIME_STATIONS, n // 2, f"{SEED}a",
    )
    half = n // 2
    combos = keep_ids(base, unique_combo(episodes))
    unused = combos.join(timed.select("episode_id"), "episode_id", "left_anti")
    described = station_round_robin(unused, DESCRIBED_STATIONS, n - half, f"{SEED}b").withColumn(
        "position", F.col("position") + half
    )
    null = F.lit(None)
    one = F.array("episode_id")
    return _item(
        timed, "estacao_horario", time_question(F.col("station"), second), fact(), one, "all",
        F.array("station"), second, null,
    ).unionByName(_item(
        described, "descricao_semantica", described_question(), fact(), one, "all",
        F.array("station"), null, null,
    ))


def pair_items(episodes: DataFrame, window_s: float, n: int = TIER_SIZE) -> DataFrame:
    chosen = quota_pairs(cross_station_pairs(episodes, window_s), n)
    fields = ["episode_id", "station", "start_ts", "duration_s", "current_task", "current_sub_task"]
    side = lambda p: episodes.select(*[F.col(f).alias(f"{p}_{f}") for f in fields])
    rows = chosen.select("position", "a_id", "b_id").join(
        side("a"), F.col("a_id") == F.col("a_episode_id")
    ).join(side("b"), F.col("b_id") == F.col("b_episode_id"))
    second = second_text("a_start_ts")
    return _item(
        rows, "duas_estacoes",
        pair_question(F.col("a_station"), F.col("b_station"), second),
        F.concat(fact("a_"), F.lit(" "), fact("b_")),
        F.array("a_id", "b_id"), "all", F.array("a_station", "b_station"), second, F.lit(None),
    )


def causal_items(episodes: DataFrame, n: int = TIER_SIZE) -> DataFrame:
    second = second_text("start_ts")
    motor = F.replace("current_sub_task", F.lit("calibrating "), F.lit(""))
    order = [F.col("is_anomaly").desc(), hash_order(SEED, F.col("episode_id"))]
    cases = anomaly_cases(episodes).withColumn(
        "position", F.row_number().over(Window.orderBy(*order))
    )
    first = N_POSITIVE + N_NEGATIVE
    impact = impact_picks(episodes, SEED).withColumn(
        "_o", hash_order(SEED, F.concat("station", F.lit("|"), "current_task"))
    ).orderBy("_o").limit(n - first)
    impact = impact.withColumn(
        "position", first + F.row_number().over(Window.orderBy("_o"))
    )
    return _item(
        cases, F.when(F.col("is_anomaly"), "anomalia_sim").otherwise("anomalia_nao"),
        anomaly_question(motor, second), anomaly_reference(motor), F.array("episode_id"), "all",
        F.array("station"), second, F.col("is_anomaly"),
    ).unionByName(_item(
        impact, IMPACT, impact_question(), impact_reference(),
        F.lit(None).cast("array<string>"), "any", F.array("station"), F.lit(None), F.lit(None),
    ))


def golden_evidence(golden: DataFrame, episodes: DataFrame) -> DataFrame:
    """(id, episode_id) rows. Any episode of an impact item's group is evidence; such a group may
    be a large part of the table, so it stays a join result and is never collected into a list."""
    listed = golden.select("id", F.explode("evidence_episode_ids").alias("episode_id"))
    impact = golden.where(F.col("subtype") == IMPACT).select(
        "id", F.element_at("meta.stations", 1).alias("station")
    )
    groups = impact_groups(episodes, SEED).select("station", "episode_id")
    return listed.unionByName(impact.join(groups, "station").select("id", "episode_id"))


def golden_set(episodes: DataFrame, window_s: float = WINDOW_S, n: int = TIER_SIZE) -> DataFrame:
    """Three tiers of n questions with ids like fac-01; windows here run over the chosen items only."""
    tiers = (
        ("factual", factual_items(episodes, window_s, n)),
        ("cross_station", pair_items(episodes, window_s, n)),
        ("causal", causal_items(episodes, n)),
    )
    out = None
    for tier, items in tiers:
        w = Window.orderBy("position")
        rows = items.withColumn("_no", F.row_number().over(w)).select(
            F.concat(F.lit(tier[:3] + "-"), F.lpad(F.col("_no").cast("string"), 2, "0")).alias("id"),
            F.lit(tier).alias("tier"), "subtype", "question", "reference",
            "evidence_episode_ids", "evidence_mode", "meta",
        )
        out = rows if out is None else out.unionByName(rows)
    return out
