import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.functions.columns import num1
from millrace.operators import metrics as mt
from millrace.operators import perturb as pt
from millrace.operators import rules as ru
from millrace.operators import stats as st
from millrace.operators.ordered import evenly_spaced, row_numbers, running_total
from millrace.plans import fixtures as fx

SMALL = "/root/testdata/sf0.001"


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_rounding_is_half_up_on_decimals(spark):
    row = one(spark, a=num1(F.lit(0.25)), b=num1(F.lit(0.35)), c=num1(F.lit(2.0005)), d=num1(F.lit(13.0)))
    assert tuple(row) == ("0.3", "0.4", "2.0", "13.0")


RULE_CASES = [
    ("VGR_1", "picking up and transporting the workpiece from the sink_2 to the warehouse", "HBW_1"),
    ("VGR_1", "Picking up and transporting the workpiece from the sink_1 to the oven", "OV_1"),
    ("OV_1", "unloading the oven", "OV_1"), ("MM_1", "unload", "MM_1"), ("HBW_1", "unloading slot", "VGR_1"),
    ("EC_1", "detecting the workpiece color", "HBW_1 via VGR_1"), ("WT_1", "nothing known", None), ("MM_1", "", None),
]


def test_rules_first_match_wins(spark):
    df = spark.createDataFrame([(s, t) for s, t, _ in RULE_CASES], "station string, current_task string")
    got = {(r.station, r.current_task): r.next_station for r in ru.with_context(df).collect()}
    assert got == {(s, t): n for s, t, n in RULE_CASES}


@pytest.mark.parametrize("answer,reference,question,want", [
    ("dura 3.7s", "foram 3.7s", "", 1.0), ("dura 13.7s", "foram 3.7s", "", 0.0), ("dura 1,5", "foram 1.5", "", 1.0),
    ("MM_1 por 2.0", "MM_1 por 2.0", "a MM_1 em 2.0?", None), ("só MM_1", "MM_1 e SM_1", "", 0.5), ("x", "nada", "", None),
    ("mill workpiece e SM_1", "A atividade interrompida é 'Mill workpiece' (processo P); próxima SM_1.", "", 1.0),
    ("3.77", "foram 3.7s", "", 0.0),
])
def test_key_fact_recall(spark, answer, reference, question, want):
    kf = tx.key_fact_recall(F.lit(answer), F.lit(reference), F.lit(question))
    assert one(spark, v=kf).v == want


@pytest.mark.parametrize("answer,kf,kind", [
    ("Tudo certo.", None, "resposta"), ("NÃO HÁ informação suficiente.", None, "recusa_total"),
    ("Não há informação suficiente.", 0.5, "ressalva_parcial"), ("x" * 300 + " não foi possível dizer", 0.0, "ressalva_parcial"),
    ("Nenhum episódio trata disso", 0.0, "recusa_total"), ("não havia dados", 0.0, "resposta"),
])
def test_classify(spark, answer, kf, kind):
    assert one(spark, k=tx.classify_answer(F.lit(answer), F.lit(kf).cast("double"))).k == kind


def test_verdict_and_numbers(spark):
    row = one(
        spark, a=tx.anomaly_verdict(F.lit("Não foi anormalmente longa")), b=tx.anomaly_verdict(F.lit("Duração ANÔMALA")),
        c=tx.anomaly_verdict(F.lit("sem opinião")),
        n=tx.ungrounded_numbers(F.lit("1,5 e 2.25 e 2.25 e 9.0"), F.lit("foram 1.50"), F.array(F.lit("9,0"), F.lit("x"))),
    )
    assert tuple(row) == ("nao", "sim", None, 1)


def test_retrieval_metrics_edges(spark):
    m = lambda got, ev, mode: mt.retrieval_metrics(
        F.array(*map(F.lit, got)).cast("array<string>"), F.array(*map(F.lit, ev)), F.lit(mode))
    row = one(spark, a=m(["x", "a", "a"], ["a", "b"], "all"), b=m(["x", "b"], ["a", "b"], "any"), c=m([], ["a"], "all"))
    assert tuple(map(tuple, row)) == ((1.0, 0.5, 0.5), (1.0, 0.5, 1.0), (0.0, 0.0, 0.0))


def test_claims(spark):
    text = "## Título\n1. **Diagnóstico**: A estação parou por 3.2s. Não há registro da causa.\r\n- curta\n2) Outra frase com cinco palavras!"
    df = spark.createDataFrame([("q", text)], "id string, answer string")
    rows = pt.claims(df, ["id"]).orderBy("claim_no").collect()
    assert [r.claim for r in rows] == ["A estação parou por 3.2s.", "Outra frase com cinco palavras!"]
    assert rows[0].n_declined == 1
    declined = spark.createDataFrame([("q", "Não há informação suficiente nos episódios."), ("r", " ".join(f"Esta é a frase número {i}." for i in range(40)))], "id string, answer string")
    got = pt.claims(declined, ["id"]).orderBy("id", "claim_no").collect()
    assert (got[0].claim, got[0].n_declined) == (None, 1)
    assert [r.claim_no for r in got[1:]] == list(range(1, 41))


def test_swaps(spark):
    ctx = F.array(F.lit("MM_1 durou 3.2s e 10.5s"), F.lit("x"))
    row = one(
        spark,
        a=pt.swap_numbers(F.lit("foram 3,2 e 10.5 e 99.9"), F.lit("?"), ctx),
        b=pt.swap_numbers(F.lit("foram 3.2"), F.lit("vs 10.5"), F.array(F.lit("3.2"))),
        c=pt.swap_numbers(F.lit("sem número 7.7"), F.lit("?"), ctx),
        d=pt.swap_station(F.lit("A MM_1 parou."), F.lit("?"), ctx, F.array(*map(F.lit, ["EC_1", "MM_1", "OV_1"]))),
        e=pt.swap_station(F.lit("A SM_1 parou."), F.lit("?"), ctx, F.array(F.lit("EC_1"))),
        f=pt.neutral(F.lit("um\n\n \n dois\n\ntrês ")), g=pt.neutral(F.lit("um")),
    )
    # 3.2 + 7.3 = 10.5 is in the context, so the next shift applies; the second number moves by shift + 1
    assert row.a == "foram 15,1 e 18.8 e 99.9"
    assert row.b == "foram 15.1" and row.c is None
    assert row.d == "A OV_1 parou." and row.e is None
    assert row.f == "três\n\n dois\n\num" and row.g is None


def table(spark, values, schema="v double"):
    return spark.createDataFrame(values, schema)


def test_spearman_ties_and_constant(spark):
    rows = [("a", 0, 0.1), ("a", 1, 0.1), ("a", 1, 0.5), ("a", 2, 0.4), ("b", 1, 0.1), ("b", 1, 0.2), ("b", 1, 0.3), ("c", 1, 0.1), ("c", 2, 0.2)]
    got = {r.g: r.stat for r in st.spearman(table(spark, rows, "g string, x int, y double"), ["g"], "x", "y").collect()}
    want = np.corrcoef([0, 1.5, 1.5, 3], [0.5, 0.5, 3, 2])[0, 1]
    assert got["a"] == pytest.approx(want) and got["b"] is None and got["c"] is None


def test_agreement_edges(spark):
    rows = [("one", True, True), ("one", True, True), ("mix", True, True), ("mix", True, False), ("mix", False, False), ("mix", False, False)]
    got = {r.g: r for r in st.agreement(table(spark, rows, "g string, y_true boolean, y_pred boolean"), ["g"]).collect()}
    assert got["one"].kappa is None and got["one"].balanced_accuracy is None and got["one"].accuracy == 1.0
    assert got["mix"].kappa == pytest.approx(0.5) and got["mix"].balanced_accuracy == 0.75


def test_quota_with_exhausted_cell(spark):
    cells = table(spark, [("a", 1), ("b", 100), ("c", 3)], "cell string, n long")
    got = {r.cell: r.quota for r in st.round_robin_quota(cells, ["cell"], 4).collect()}
    assert got == {"a": 1, "b": 8, "c": 3}


def test_evenly_spaced_matches_linspace(spark):
    for n, q in ((10, 4), (7, 7), (5, 9), (23, 1), (16, 6)):
        rows = spark.range(n).select(F.col("id"), F.lit(q).alias("q"))
        got = sorted(r.id for r in evenly_spaced(rows, [], ["id"], "q").collect())
        assert got == sorted({int(round(i)) for i in np.linspace(0, n - 1, min(n, q))})


def test_every_nth(spark):
    rows = spark.range(25).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("id"))
    got = sorted(r.id for r in st.every_nth(rows, "id", 4).collect())
    ids = [f"{i:03d}" for i in range(25)]
    assert got == ids[::6][:4]


def test_running_total_with_one_hot_key(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") < 2900, "hot").otherwise("cold").alias("k"), "id", (F.col("id") % 3).alias("v"))
    out = running_total(rows, ["k"], ["id"], "v", "total").orderBy("id").collect()
    total = np.cumsum([i % 3 for i in range(2900)])
    assert [r.total for r in out[:2900]] == total.tolist()
    assert row_numbers(rows, [], ["id"], "n").where("n <> id + 1").count() == 0


def test_weights_are_poisson_and_replicates_share_nothing(spark):
    """Means and variances of the weights, and no two replicates more alike than chance."""
    counts = spark.range(300).select(F.lit("g").alias("g"), F.col("id").alias("v"), (F.col("id") % 15 + 1).alias("_n"))
    rows = st.replicated(counts, ["g"], ["v"], 400).collect()
    weights = np.zeros((400, 300))
    for r in rows:
        weights[r.rep - 1, r.v] = r._w
    mean = np.arange(300) % 15 + 1
    assert np.allclose(weights.mean(0), mean, atol=5 * np.sqrt(mean.max() / 400))
    assert abs((weights.var(0) / mean).mean() - 1) < 0.05
    z = (weights - mean) / np.sqrt(mean)
    like = z @ z.T / 300
    np.fill_diagonal(like, 0)
    assert np.abs(like).max() < 6 / np.sqrt(300)
    shifted = [np.corrcoef(z[0, :-k], z[r, k:])[0, 1] for k in (1, 2, 5) for r in range(1, 400, 7)]
    assert np.abs(shifted).max() < 6 / np.sqrt(290)


def test_bootstrap_interval(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(5, 2, 300)
    rows = table(spark, [("g", float(v)) for v in x] + [("k", 1.0)] * 50 + [("k", None), ("k", float("nan"))], "g string, value double")
    got = {r.g: r for r in st.bootstrap_ci(rows, ["g"], "value", 2000).collect()}
    half = 1.96 * x.std() / math.sqrt(300)
    assert got["g"].ci_low == pytest.approx(x.mean() - half, abs=0.08)
    assert got["g"].ci_high == pytest.approx(x.mean() + half, abs=0.08)
    assert got["k"].ci_low == got["k"].ci_high == 1.0 and got["k"].n == 50


def test_both_ways_to_sum_replicates_agree(spark):
    rows = table(spark, [("a", i % 5 / 4) for i in range(90)] + [("b", i % 3 - 1.0) for i in range(40)], "g string, value double")
    counts = st.folded(rows.withColumn("u", st.units("value")), ["g"], ["u"])
    exploded = st.replicated(counts, ["g"], ["u"], 50).groupBy("g", "rep").agg(
        F.round(F.sum(F.col("_w") * F.col("u")) / F.sum("_w") * st.UNIT, 9).alias("m"))
    summed = st._means(rows, ["g"], F.col("value"), 50, st.SEED)
    assert sorted(map(tuple, exploded.collect())) == sorted(map(tuple, summed.collect()))


def test_impact_evidence_counts(spark):
    """Questions whose evidence is a table of its own: one found episode is a full hit."""
    answers = spark.createDataFrame(
        [("r", "cau-08", "rag_filtrado", ["e9", "e1"], "x"), ("r", "cau-08", "rag_vetorial", ["e7"], "x"), ("r", "cau-08", "baseline", [], "x")],
        "run string, id string, system string, retrieved_ids array<string>, answer string",
    ).select("*", *[F.lit(v).alias(n) for n, v in (("tier", "causal"), ("subtype", "impacto_bpm"), ("question", "q"), ("reference", "r"), ("latency_s", 1.0))],
             F.array(F.lit("c")).alias("retrieved_contexts"), F.expr("named_struct('prompt_tokens', 1L, 'total_tokens', 2L)").alias("usage"))
    golden = spark.createDataFrame([("cau-08", None, "any")], "id string, evidence_episode_ids array<string>, evidence_mode string")
    evidence = spark.createDataFrame([("cau-08", f"e{i}") for i in (1, 2, 3)], "id string, episode_id string")
    scores = spark.createDataFrame([], "judge string, run string, id string, system string, tier string, " + ", ".join(f"{m} double" for m in mt.JUDGE_METRICS))
    got = {r.system: (r.hit_at_k, r.mrr, r.recall_at_k) for r in mt.report_rows(answers, golden, scores, evidence).collect()}
    assert got == {"rag_filtrado": (1.0, 0.5, 1.0), "rag_vetorial": (0.0, 0.0, 0.0), "baseline": (None, None, None)}
    matrix = {r.system: r.with_evidence for r in mt.refusal_matrix(answers, golden, evidence).collect()}
    assert matrix == {"rag_filtrado": 1, "rag_vetorial": 0}


def test_configurations_without_hits_stay(spark):
    hits = spark.createDataFrame([], "config string, question_id string, rank int, event_id string")
    questions = spark.createDataFrame([("q1", "t", "all")], "question_id string, tier string, evidence_mode string")
    evidence = spark.createDataFrame([("q1", "e")], "question_id string, event_id string")
    got = sorted(tuple(r) for r in mt.metrics_from_hits(hits, questions, evidence, ["a", "b"]).collect())
    assert got == [("a", "q1", "t", 0.0, 0.0, 0.0), ("b", "q1", "t", 0.0, 0.0, 0.0)]


def foreign_by_hand(rows):
    import re

    station = lambda t: set(re.findall(r"\b[A-Z]{2,3}_\d\b", t))
    data = [(r.run, r.id, r.system, set(r.retrieved_ids), station(r.answer), station(" ".join(r.retrieved_contexts)),
             len(r.answer), len(r.retrieved_contexts)) for r in rows]
    want = {}
    for run, qid, system, ids, ans, _, length, _ in data:
        pool = sorted((o[1], o[2]) for o in data if o[0] == run and o[1] != qid and o[7]
                      and not ids & o[3] and not ans & o[5])
        if pool:
            want[(run, qid, system)] = pool[length % len(pool)]
    return want


def test_foreign_context_against_brute_force(spark):
    rows = fx.generations(spark, SMALL).where("system <> 'baseline'")
    got = {(r.run, r.id, r.system): (r.foreign_id, r.foreign_system) for r in pt.foreign_context(rows, rows).collect()}
    assert got == foreign_by_hand(rows.collect())


@pytest.mark.parametrize("fan", [2, 6])
def test_foreign_context_with_an_id_that_a_third_retrieves(spark, monkeypatch, fan):
    """The counting tree holds subsets of rows' own ids only: its size doesn't grow with the answers that share one."""
    monkeypatch.setattr(pt, "FAN_BITS", fan)
    built = []
    tree = pt._count_tree
    monkeypatch.setattr(pt, "_count_tree", lambda places, *a: built.append(places) or tree(places, *a))
    rng = random.Random(fan)
    rows = [
        ("r", f"q{k // 2:04}", ("rag_a", "rag_b")[k % 2], ["hot"] * (k % 3 == 0) + rng.sample([f"e{i}" for i in range(12)], rng.randint(0, 3)),
         [f"em {rng.choice(['MM_1', 'EC_1', 'SM_1'])}"], "x" * rng.randint(0, 999) + rng.choice(["", " MM_1", " EC_1 MM_1"]))
        for k in range(600)
    ]
    df = spark.createDataFrame(rows, "run string, id string, system string, retrieved_ids array<string>, retrieved_contexts array<string>, answer string")
    got = {(r.run, r.id, r.system): (r.foreign_id, r.foreign_system) for r in pt.foreign_context(df, df).collect()}
    assert got == foreign_by_hand(df.collect())
    assert built[0].count() <= 600 * 3 * 31


def test_common_questions_and_pairs(spark):
    rows = table(spark, [("r1", "s", "1"), ("r2", "s", "1"), ("r1", "s", "2")], "run string, system string, id string")
    assert [tuple(r) for r in mt.common_questions(rows).collect()] == [("s", "1")]


@pytest.mark.parametrize("front", [5, 1000])
def test_foreign_context_is_settled_by_first_places(spark, monkeypatch, front):
    """Answers whose ids few others share need no counting tree; those with a place behind the first ones still get it."""
    monkeypatch.setattr(pt, "FRONT", front)
    if front == 1000:
        monkeypatch.setattr(pt, "_count_tree", None)
    rng = random.Random(front)
    rows = [
        ("r", f"q{k // 2:04}", ("rag_a", "rag_b")[k % 2], [f"e{(k + j) // 3}" for j in range(rng.randint(0, 3))],
         [f"em {rng.choice(['MM_1', 'EC_1', 'SM_1'])}"], "x" * rng.randint(0, 90) + rng.choice(["", " MM_1", " EC_1 MM_1"]))
        for k in range(300)
    ]
    df = spark.createDataFrame(rows, "run string, id string, system string, retrieved_ids array<string>, retrieved_contexts array<string>, answer string")
    got = {(r.run, r.id, r.system): (r.foreign_id, r.foreign_system) for r in pt.foreign_context(df, df).collect()}
    assert got == foreign_by_hand(df.collect())


def test_foreign_context_beyond_the_front_of_a_large_pool(spark, monkeypatch):
    """A pool larger than the front, where the wanted place is told without the size of the pool."""
    monkeypatch.setattr(pt, "FRONT", 60)
    monkeypatch.setattr(pt, "CROWDED", 4)
    rng = random.Random(7)
    rows = [("r", f"q{k:04}", "rag_a", [f"e{k // 2}"], [f"em {rng.choice(['MM_1', 'EC_1'])}"], "x" * rng.randint(0, 70) + rng.choice(["", " MM_1"]))
            for k in range(300)]
    df = spark.createDataFrame(rows, "run string, id string, system string, retrieved_ids array<string>, retrieved_contexts array<string>, answer string")
    got = {(r.run, r.id, r.system): (r.foreign_id, r.foreign_system) for r in pt.foreign_context(df, df).collect()}
    assert got == foreign_by_hand(df.collect())


def plan_of(df, capsys):
    capsys.readouterr()
    df.explain(True)
    return capsys.readouterr().out.split("== Analyzed Logical Plan ==")[1].split("== Optimized Logical Plan ==")[0]


def test_contexts_are_read_once_for_a_swap(spark, capsys):
    df = spark.createDataFrame([("a 3.2", "q", ["3.2"])], "a string, q string, c array<string>")
    plan = plan_of(df.select(pt.swap_numbers(F.col("a"), F.col("q"), F.col("c")).alias("x")), capsys)
    assert plan.count("array_join(c") == 1


def test_no_number_and_no_context_are_left_alone(spark):
    df = spark.createDataFrame([("a 3.2", "q", None), ("a 3.2", "q", []), (None, "q", ["3.2"]), ("a 3.2", None, ["3.2"])], "a string, q string, c array<string>")
    got = [r.x for r in df.select(pt.swap_numbers(F.col("a"), F.col("q"), F.col("c")).alias("x")).collect()]
    assert got == [None, None, None, "a 10.5"]


def written(monkeypatch):
    labels, write = [], st.materialise
    monkeypatch.setattr(st, "materialise", lambda df, label: labels.append(label) or write(df, label))
    return labels


def test_pairs_are_made_once_for_means_and_replicates(spark, monkeypatch):
    labels = written(monkeypatch)
    df = spark.createDataFrame([("r", 1.0, 0.5), ("r", 0.5, 0.5)], "run string, a double, b double")
    assert st.paired_bootstrap(df, ["run"], 20).first()["diff"] == 0.25
    assert st.bootstrap_ci(df, ["run"], "a", 20).first()["mean"] == 0.75
    assert labels == ["differences", "values"]


def test_label_pool_is_made_once(spark, monkeypatch):
    labels = written(monkeypatch)
    df = spark.createDataFrame([("r", "s", f"{k}", k / 10) for k in range(10)], "run string, system string, id string, faithfulness double")
    assert st.label_sample(df, 3).count() == 3
    assert labels[0] == "label-pool"
