"""Bootstrap intervals, rank correlation, agreement, sampling for labels."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import (
    DRAW_PRIME, DRAW_STRIDES, POISSON_EXACT, hash_order, key_numbers, poisson_count, poisson_steps,
)
from millrace.operators.ordered import (
    evenly_spaced, group_sizes, hash_row_numbers, row_numbers, running_total,
)
from millrace.session import materialise, shuffle_partitions

REPLICATES = 10_000
SEED = 42
# Replicate statistics are rounded before percentiles, so that the order of a sum does not show.
DIGITS = 9
LOW, HIGH = 0.025, 0.975
MIN_TOLERANCE = 0.05
# Values of a mean are counted in units of this size.
UNIT = 1e-9
WEIGHT = "_w"


def units(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value.cast("double") / UNIT).cast("bigint")


def folded(rows: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per group and distinct values, with their number `_n`: all that a replicate has to know."""
    return rows.groupBy(*by, *values).agg(F.count(F.lit(1)).alias("_n"))


def replicated(
    counts: DataFrame, by: Sequence[str], values: Sequence[str], replicates: int = REPLICATES, seed: int = SEED
) -> DataFrame:
    """Poisson bootstrap on counts: each replicate draws a weight `_w` for each distinct value.

    n rows of a value that weigh Poisson(1) each weigh Poisson(n) together, so rows are neither drawn nor
    joined. The work is replicates x distinct values, whatever the number of rows.

    A draw mixes three numbers from the digest of (seed, group, value) with two permutations of the
    replicate's number, by products and fifth powers modulo a prime: whole numbers that any engine repeats, in
    generated code, and no shift of one replicate is another.
    """
    few = _keyed(counts, by, values, seed).withColumn("rep", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(replicates).cast("bigint"))))
    p = DRAW_PRIME
    drawn = _fifth(few.withColumn("_r", (F.col("rep") * DRAW_STRIDES[0]) % p), "_r", "_r")
    drawn = _fifth(drawn.withColumn("_x", (F.col("_a") * F.col("_r") + F.col("_b")) % p), "_x", "_x")
    drawn = _fifth(drawn.withColumn("_x", (F.col("_x") + F.col("_c") + F.col("rep") * DRAW_STRIDES[1]) % p), "_x", "_x")
    drawn = _fifth(drawn.withColumn("_y", (F.col("_x") + F.col("_r") + 1) % p), "_y", "_y")
    uniform = lambda c: (F.col(c) + 0.5) / float(p)
    weight = poisson_count(F.col("_n"), F.col("_u"), F.col("_v"))
    # A generator: a filter on its column isn't pushed below the steps and multiplied with them.
    weighed = drawn.withColumn("_u", uniform("_x")).withColumn("_v", uniform("_y")).select(
        *by, *values, "rep", F.explode(F.array(weight)).alias(WEIGHT)
    )
    return weighed.where(f"{WEIGHT} > 0")


def _keyed(counts: DataFrame, by: Sequence[str], values: Sequence[str], seed: int) -> DataFrame:
    """Three numbers (_a, _b, _c) per distinct value, from which its draws come; spread over all tasks."""
    kind = dict(counts.dtypes)
    text = [F.col(v).cast("int" if kind[v] == "boolean" else kind[v]).cast("string") for v in (*by, *values)]
    a, b, c = key_numbers(F.concat_ws("|", F.lit(str(seed)), *text))
    few = counts.withColumns({"_a": a, "_b": b, "_c": c})
    return few.repartition(shuffle_partitions(counts.sparkSession), *by, *values)


def _fifth(df: DataFrame, column: str, name: str) -> DataFrame:
    """column ** 5 modulo the prime, in steps that stay within 64 bits."""
    square = lambda c: (F.col(c) * F.col(c)) % DRAW_PRIME
    return (
        df.withColumn("_2", square(column)).withColumn("_4", square("_2"))
        .withColumn(name, (F.col("_4") * F.col(column)) % DRAW_PRIME).drop("_2", "_4")
    )


def _interval(stats: DataFrame, by: Sequence[str], value: str, *more: Column) -> DataFrame:
    return stats.groupBy(*by).agg(
        F.expr(f"percentile({value}, {LOW})").alias("ci_low"),
        F.expr(f"percentile({value}, {HIGH})").alias("ci_high"), *more,
    )


# Distinct values that a task weighs at once.
VALUES_PER_STEP = 64


def _fifths(x: np.ndarray) -> np.ndarray:
    square = x * x % DRAW_PRIME
    return square * square % DRAW_PRIME * x % DRAW_PRIME


def _counts(n: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Poisson counts of the means n, one row each."""
    out = np.empty(u.shape, np.int64)
    for c in np.unique(n[n <= POISSON_EXACT]).tolist():
        out[n == c] = np.searchsorted(poisson_steps(c), u[n == c], side="right")
    large = n > POISSON_EXACT
    m = n[large, None].astype(float)
    z = np.sqrt(-2.0 * np.log(u[large])) * np.cos(2.0 * math.pi * v[large])
    out[large] = np.maximum(0, np.floor(m + np.sqrt(m) * z + (z * z - 1.0) / 6.0 + 0.5))
    return out


def _replicate_sums(by: Sequence[str], replicates: int):
    """Per group of a batch and replicate the sum of weights and of weighted values: the draws of
    `replicated`, summed where they are made."""
    names = [*by, "rep", "_sum_w", "_sum_wu"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep = np.arange(1, replicates + 1, dtype=np.int64)
        r = _fifths(rep * DRAW_STRIDES[0] % DRAW_PRIME)
        step = rep * DRAW_STRIDES[1]
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.select(list(by)).to_pandas().groupby(list(by), dropna=False).ngroup().to_numpy()
            a, b, c, n, value = (batch.column(k).to_numpy() for k in ("_a", "_b", "_c", "_n", "_units"))
            for g in np.unique(group):
                rows = np.flatnonzero(group == g)
                weights, weighted = np.zeros(replicates, np.int64), np.zeros(replicates, np.int64)
                for at in range(0, len(rows), VALUES_PER_STEP):
                    k = rows[at : at + VALUES_PER_STEP]
                    x = _fifths((a[k, None] * r + b[k, None]) % DRAW_PRIME)
                    x = _fifths((x + c[k, None] + step) % DRAW_PRIME)
                    y = _fifths((x + r + 1) % DRAW_PRIME)
                    w = _counts(n[k], (x + 0.5) / float(DRAW_PRIME), (y + 0.5) / float(DRAW_PRIME))
                    weights += w.sum(0)
                    weighted += (w * value[k, None]).sum(0)
                first = pa.array(np.full(replicates, rows[0]))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(first) for c in by), pa.array(rep), pa.array(weights), pa.array(weighted)], names
                )

    return run


def _means(rows: DataFrame, by: Sequence[str], value: Column, replicates: int, seed: int) -> DataFrame:
    """(by, rep, _m): the mean of each replicate; sums are whole numbers, so their order doesn't show."""
    counts = folded(rows.withColumn("_units", units(value)), by, ["_units"])
    kept = counts.select(*by)
    schema = T.StructType([*kept.schema.fields, *(T.StructField(c, T.LongType()) for c in ("rep", "_sum_w", "_sum_wu"))])
    sums = _keyed(counts, by, ["_units"], seed).mapInArrow(_replicate_sums(by, replicates), schema)
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).cast("double")
    return sums.groupBy(*by, "rep").agg(total("_sum_w").alias("_w"), total("_sum_wu").alias("_wu")).where("_w > 0").select(
        *by, "rep", F.round(F.col("_wu") / F.col("_w") * UNIT, DIGITS).alias("_m")
    )


def bootstrap_ci(
    rows: DataFrame, by: Sequence[str], value: str = "value", replicates: int = REPLICATES, seed: int = SEED,
) -> DataFrame:
    """Mean, n and 95 % percentile interval of the mean per group; null values are dropped."""
    rows = materialise(rows.where(f"{value} is not null and not isnan({value})").select(*by, value), "values")  # read twice
    base = rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return base.join(_interval(_means(rows, by, F.col(value), replicates, seed), by, "_m"), list(by))


def paired_bootstrap(
    pairs: DataFrame, by: Sequence[str], replicates: int = REPLICATES, seed: int = SEED,
) -> DataFrame:
    """Mean of a-b with interval and p = min(1, 2·min(share <= 0, share >= 0))."""
    rows = materialise(pairs.select(*by, (F.col("a") - F.col("b")).alias("_d")), "differences")  # read twice
    share = lambda c: F.avg(c.cast("double"))
    tails = _interval(
        _means(rows, by, F.col("_d"), replicates, seed), by, "_m",
        F.least(F.lit(1.0), 2.0 * F.least(share(F.col("_m") <= 0), share(F.col("_m") >= 0))).alias("p_approx"),
    )
    base = rows.groupBy(*by).agg(F.avg("_d").alias("diff"), F.count(F.lit(1)).alias("n"))
    return base.join(tails, list(by))


def statistic_bootstrap(
    rows: DataFrame, by: Sequence[str], values: Sequence[str],
    statistic: Callable[[DataFrame, Sequence[str]], DataFrame],
    replicates: int = REPLICATES, seed: int = SEED, names: Sequence[str] = (),
) -> DataFrame:
    """Interval of any grouped statistic of `values`; undefined replicates are left out, and with fewer
    than half of them defined the interval is null.

    `statistic(rows, by)` reads weighted rows (column `_w`) and returns one row per group with a column
    `stat`, or several rows told apart by the columns `names`, which then share one set of draws.
    """
    out = [*by, *names]
    counts = folded(rows, by, values)
    base = statistic(counts.withColumnRenamed("_n", WEIGHT), by).withColumnRenamed("stat", "estimate")
    per_rep = statistic(replicated(counts, by, values, replicates, seed), [*by, "rep"])
    valid = per_rep.where("stat is not null").withColumn("stat", F.round("stat", DIGITS))
    enough = F.count("stat") >= replicates * 0.5
    interval = valid.groupBy(*out).agg(
        F.when(enough, F.expr(f"percentile(stat, {LOW})")).alias("ci_low"),
        F.when(enough, F.expr(f"percentile(stat, {HIGH})")).alias("ci_high"),
        F.count("stat").alias("n_valid"),
    )
    return base.join(interval, out, "left")


def average_ranks(counted: DataFrame, by: Sequence[str], value: str, count: str) -> DataFrame:
    """(by, value, rank) for distinct values with counts: ties share the mean of their places."""
    total = running_total(counted, by, [value], count, "_upto")
    return total.withColumn(
        "rank", F.col("_upto") - (F.col(count) - 1) / 2.0
    ).select(*by, value, "rank")


def spearman(rows: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation per group; null with fewer than three rows or a constant side.

    Rows are folded to distinct (x, y) pairs with counts first (or weights, if they have some); ranks
    are half integers, so the sums are exact in any order.
    """
    weight = F.sum(WEIGHT) if WEIGHT in rows.columns else F.count(F.lit(1))
    pairs = rows.groupBy(*by, x, y).agg(weight.alias("_c"))
    def ranks(col: str, name: str) -> DataFrame:
        counted = pairs.groupBy(*by, col).agg(F.sum("_c").alias("_c"))
        return average_ranks(counted, by, col, "_c").withColumnRenamed("rank", name)

    joined = pairs.join(ranks(x, "_rx"), [*by, x]).join(ranks(y, "_ry"), [*by, y])
    sums = joined.groupBy(*by).agg(
        F.sum("_c").alias("n"),
        F.sum(F.col("_c") * F.col("_rx")).alias("_sx"),
        F.sum(F.col("_c") * F.col("_ry")).alias("_sy"),
        F.sum(F.col("_c") * F.col("_rx") * F.col("_rx")).alias("_sxx"),
        F.sum(F.col("_c") * F.col("_ry") * F.col("_ry")).alias("_syy"),
        F.sum(F.col("_c") * F.col("_rx") * F.col("_ry")).alias("_sxy"),
    )
    vx = F.col("n") * F.col("_sxx") - F.col("_sx") * F.col("_sx")
    vy = F.col("n") * F.col("_syy") - F.col("_sy") * F.col("_sy")
    cov = F.col("n") * F.col("_sxy") - F.col("_sx") * F.col("_sy")
    return sums.select(
        *by, "n",
        F.when((F.col("n") >= 3) & (vx > 0) & (vy > 0), cov / F.sqrt(vx * vy)).alias("stat"),
    )


def _shares(yes: Column, judged: Column, weight: Column) -> dict[str, Column]:
    of = lambda c: F.sum(F.when(c, weight).otherwise(0))
    return {"tp": of(yes & judged), "fn": of(yes & ~judged), "fp": of(~yes & judged), "tn": of(~yes & ~judged)}


def agreement(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """2×2 counts (sums of `_w`, if there is one), accuracy, balanced accuracy and kappa of boolean
    `y_true`, `y_pred`."""
    weight = F.col(WEIGHT) if WEIGHT in rows.columns else F.lit(1).cast("bigint")
    m = rows.groupBy(*by).agg(
        *[c.alias(k) for k, c in _shares(F.col("y_true"), F.col("y_pred"), weight).items()]
    )
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    n = tp + fn + fp + tn
    accuracy = (tp + tn) / n
    chance = ((tp + fn) * (tp + fp) + (fp + tn) * (fn + tn)) / (n * n)
    return m.select(
        *by, "tp", "fn", "fp", "tn",
        accuracy.alias("accuracy"),
        F.when((tp + fn > 0) & (fp + tn > 0), 0.5 * (tp / (tp + fn) + tn / (fp + tn)))
        .alias("balanced_accuracy"),
        F.when(chance < 1.0, (accuracy - chance) / (1 - chance)).alias("kappa"),
    )


def agreement_stats(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Accuracy, balanced accuracy and kappa as rows (by, statistic, stat)."""
    return agreement(rows, by).unpivot(
        list(by), ["accuracy", "balanced_accuracy", "kappa"], "statistic", "stat"
    )


def cuts(rows: DataFrame) -> DataFrame:
    """Both binary readings of (human 0/1/2, judge score): fully and mostly supported."""
    full = rows.select(
        "*", F.lit("A").alias("cut"), (F.col("human") == 2).alias("y_true"),
        (F.col("judge") >= 0.999).alias("y_pred"),
    )
    most = rows.select(
        "*", F.lit("B").alias("cut"), (F.col("human") >= 1).alias("y_true"),
        (F.col("judge") >= 0.5).alias("y_pred"),
    )
    return full.unionByName(most)


def judge_mean_by_label(labelled: DataFrame) -> DataFrame:
    """n and mean judge score per label; refusals are a group of their own."""
    return labelled.where(F.col("label_kind").isin("label", "refusal")).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.avg("judge").alias("judge_mean")
    )


def judge_noise(measures: DataFrame, by: Sequence[str]) -> DataFrame:
    """Spread of repeated scores per sample, summarised: identical, mean and largest spread."""
    spread = measures.where("value is not null").groupBy(*by, "sample").agg(
        F.count(F.lit(1)).alias("_n"), (F.max("value") - F.min("value")).alias("_a")
    ).where("_n > 1")
    return spread.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_valid"), F.count_if(F.col("_a") == 0).alias("identical"),
        F.avg("_a").alias("amplitude_mean"), F.max("_a").alias("amplitude_max"),
    )


NEUTRAL, CORRUPTIONS, REFERENCE = "neutra", ("numero", "estacao", "contexto"), "referencia"


def tolerance(rows: DataFrame) -> DataFrame:
    """One row: max(0.05, 90th percentile of the absolute change under the neutral condition).

    Changes are folded to distinct values with counts before the exact percentile.
    """
    change = F.round(F.abs(F.col("perturbed") - F.col("original")), DIGITS)
    folded = rows.where(F.col("cond") == NEUTRAL).groupBy(change.alias("_d")).agg(
        F.count(F.lit(1)).alias("_n")
    ).where("_d is not null")
    p90 = F.expr("percentile(_d, 0.9, _n)")
    return folded.agg(
        F.greatest(F.lit(MIN_TOLERANCE), F.coalesce(p90, F.lit(MIN_TOLERANCE))).alias("tolerance")
    )


def with_changes(rows: DataFrame) -> DataFrame:
    """Scored pairs with `delta`, `fell`, `same`, `rose` against the tolerance (a one-row join)."""
    pairs = rows.where(
        "original is not null and perturbed is not null and cond <> 'referencia'"
    ).withColumn("delta", F.round(F.col("perturbed") - F.col("original"), DIGITS))
    t = F.col("tolerance")
    return (
        pairs.join(F.broadcast(tolerance(rows)))
        .withColumn("fell", F.col("delta") < -t)
        .withColumn("same", F.abs("delta") <= t)
        .withColumn("rose", F.col("delta") > t)
    )


def perturb_report(
    rows: DataFrame, replicates: int = REPLICATES, seed: int = SEED
) -> DataFrame:
    """Per condition: means, change with interval, fell/same/rose, detection rate with interval."""
    changed = materialise(with_changes(rows), "changes")
    base = changed.groupBy("cond").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("tolerance").alias("tolerance"),
        F.avg("original").alias("mean_original"),
        F.avg("perturbed").alias("mean_perturbed"),
        F.count_if("fell").alias("fell"), F.count_if("same").alias("same"),
        F.count_if("rose").alias("rose"),
    )
    both = changed.select(
        "cond", "key",
        F.explode(F.array(
            F.struct(F.lit("delta").alias("measure"), F.col("delta").alias("value")),
            F.struct(F.lit("detection").alias("measure"), F.col("fell").cast("double").alias("value")),
        )).alias("_v"),
    ).select("cond", "key", "_v.*").where(
        f"not (cond = '{NEUTRAL}' and measure = 'detection')"
    )
    ci = bootstrap_ci(both, ["cond", "measure"], "value", replicates, seed)
    side = lambda m: ci.where(F.col("measure") == m).select(
        "cond", *[F.col(c).alias(f"{m}_{c}") for c in ("mean", "ci_low", "ci_high")]
    )
    return base.join(side("delta"), "cond").join(side("detection"), "cond", "left")


def positive_control_summary(rows: DataFrame) -> DataFrame:
    v = F.col("perturbed")
    return rows.where((F.col("cond") == REFERENCE) & v.isNotNull()).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"),
        F.avg((v >= 0.8).cast("double")).alias("share_ge_08"),
        F.min(v).alias("min"), F.max(v).alias("max"),
    )


def every_nth(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Rows 1, 1+step, … in key order, at most n, with step = max(1, count // n)."""
    numbered = row_numbers(rows, [], [key], "_rn")
    count = numbered.agg(
        F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / n)).alias("_step")
    )
    return (
        numbered.join(F.broadcast(count)).where(f"(_rn - 1) % _step = 0 and (_rn - 1) / _step < {n}")
        .drop("_rn", "_step")
    )


def round_robin_quota(cells: DataFrame, by: Sequence[str], n_per_cell: int) -> DataFrame:
    """(by, quota): one slot per cell and round, in cell order, until n_per_cell × cells are given
    or every cell is used up. `cells` has one row per cell with its size `n`.

    A cell offers at most as many slots as there are to give, whatever its size.
    """
    target = cells.agg((F.count(F.lit(1)) * n_per_cell).alias("_target"))
    slots = cells.join(F.broadcast(target)).withColumn(
        "_slot", F.explode(F.expr("sequence(1L, least(n, _target))"))
    )
    # Slot r of a cell is given before slot r+1 of any other, so the position of a slot is the
    # number of slots of lower rounds plus its place in its own round.
    order = Window.orderBy("_slot", *by)
    given = (
        slots.withColumn("_pos", F.row_number().over(order)).where("_pos <= _target")
        .groupBy(*by).agg(F.count(F.lit(1)).alias("quota"))
    )
    return cells.join(given, list(by), "left").withColumn("quota", F.coalesce("quota", F.lit(0)))


def cell_row_numbers(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Ordinal inside a cell and the size of the cell."""
    numbered = row_numbers(rows, by, order, "ordinal")
    return numbered.join(group_sizes(rows, by, "cell_size"), list(by))


def blind_shuffle(rows: DataFrame, key: str, seed: int = SEED) -> DataFrame:
    """Seeded order with sample names A01, A02, …"""
    digest = rows.withColumn("_digest", hash_order(seed, F.col(key)))
    numbered = hash_row_numbers(digest, [], "_digest", key, "_no").drop("_digest")
    no = F.col("_no").cast("string")
    return numbered.withColumn(
        "sample", F.concat(F.lit("A"), F.when(F.length(no) < 2, F.lpad(no, 2, "0")).otherwise(no))
    ).drop("_no")


def label_sample(pool: DataFrame, n_per_cell: int, seed: int = SEED) -> DataFrame:
    """Blind sample of scored answers: quota per (run, system), evenly spaced over the judge score
    inside a cell, shuffled. `pool` has run, system, id, faithfulness and no refusals."""
    by = ["run", "system"]
    pool = materialise(pool, "label-pool")  # read for the quotas, the cut points and the rows
    quotas = round_robin_quota(group_sizes(pool, by, "n"), by, n_per_cell).select(*by, "quota")
    keyed = pool.join(F.broadcast(quotas), by)
    picked = evenly_spaced(keyed, by, ["faithfulness", "id"], "quota").drop("quota")
    key = F.concat_ws("|", "run", "system", "id")
    return blind_shuffle(picked.withColumn("_key", key), "_key", seed).drop("_key")


def evenly_spaced_subset(rows: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return evenly_spaced(rows.withColumn("_q", F.lit(n)), [], order, "_q").drop("_q")


def labelling_sheet(sample: DataFrame, answers: DataFrame) -> DataFrame:
    """What a person labels: no run, system or score, only the sample's name joins it with the key."""
    lines = F.transform("retrieved_contexts", lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c))
    return sample.select("sample", "run", "system", "id").join(answers, ["run", "system", "id"]).select(
        F.col("sample").alias("amostra"), F.col("question").alias("pergunta"), F.array_join(lines, "\n").alias("contexto_recuperado"),
        F.col("answer").alias("resposta"), F.lit("").alias("rotulo"), F.lit("").alias("comentario"))


def labelling_key(sample: DataFrame, answers: DataFrame) -> DataFrame:
    """Which answer a sample is, with the judge's score."""
    return sample.select("sample", "run", "system", "id", "faithfulness").join(
        answers.select("run", "system", "id", "tier"), ["run", "system", "id"]
    ).select(F.col("sample").alias("amostra"), "run", "system", "id", "tier", F.col("faithfulness").alias("faithfulness_juiz"))


def sheet_subset(sheet: DataFrame, key: DataFrame, n: int) -> DataFrame:
    """At most n rows of an unlabelled sheet, evenly spaced over the judge's scores."""
    scored = key.select("amostra", F.col("faithfulness_juiz").alias("_score"))
    order = scored.withColumn("_no", F.substring("amostra", 2, 20).cast("long"))
    return sheet.join(evenly_spaced_subset(order, ["_score", "_no"], n).select("amostra"), "amostra", "left_semi")


def claim_scores(verdicts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per answer: claims, declining sentences, verdicts that couldn't be read, and the share of supported claims.

    verdicts: one row per claim (by, n_declined, claim_no, supported), claim_no null for an answer without claims and
    supported null for an unreadable verdict. Answers without a readable verdict have no score.
    """
    claim = F.col("claim_no").isNotNull()
    return verdicts.groupBy(*by).agg(
        F.count_if(claim).alias("n_claims"), F.max("n_declined").cast("long").alias("n_declined"),
        F.count_if(claim & F.col("supported").isNull()).alias("n_unparsed"),
        F.avg(F.when(claim, F.col("supported").cast("double"))).alias("share_supported"),
    )
