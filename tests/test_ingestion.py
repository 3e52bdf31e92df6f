from millrace.plans import fixtures as fx
from millrace.sources import results as rs
from millrace.sources import silver as sv

GOOD = ('{"id": "a", "station": "MM_1", "timestamp": "2023-04-11 09:57:48.72", "current_state": "ready", '
        '"current_task": "", "current_task_duration": 0.5, "current_sub_task": null, "i1": 1, "deep": {"x": 1}}')


def lines(spark, *values, split="train"):
    return spark.createDataFrame([(v, split) for v in values], "value string, split string")


def test_parse_good_line(spark):
    row = sv.parse(lines(spark, "  " + GOOD + "\r")).first()
    assert (row.id, row.station, row.current_task, row.current_sub_task) == ("a", "MM_1", "", None)
    assert row.current_task_duration == 0.5
    assert row.sensors == {"i1": "1", "deep": '{"x":1}'}
    assert str(row.event_timestamp) == "2023-04-11 09:57:48.720000"


def test_long_values_stay_whole(spark):
    """Ids that agree in their first 36 characters are different rows."""
    texts = [GOOD.replace('"a"', '"' + "x" * 50 + tail + '"').replace('"MM_1"', '"' + "S" * 30 + '"') for tail in "12"]
    rows = sv.parse(lines(spark, *texts))
    assert {(len(r.id), len(r.station)) for r in rows.collect()} == {(51, 30)}
    assert sv.dedup(rows).count() == 2


def test_reject_reasons(spark):
    df = lines(
        spark, "", "   ", GOOD[:40], "[1]", "3", '{"station": "MM_1"}', '{"id": null, "timestamp": "2024-01-01"}',
        '{"id": "z", "timestamp": "soon"}', '{"id": "z"}', GOOD,
    )
    got = sorted(r.reason for r in sv.rejected(sv.classified(df)).collect())
    assert got == ["bad_timestamp", "bad_timestamp", "blank", "blank", "malformed", "no_id", "no_id",
                   "not_object", "not_object"]


def test_first_row_wins_in_split_order(spark):
    late = GOOD.replace("09:57", "10:57")
    df = lines(spark, late, split="test").union(lines(spark, GOOD, late))
    row = sv.dedup(sv.parse(df)).collect()
    assert len(row) == 1 and row[0].split == "train" and row[0].event_timestamp.hour == 9
    counts = {r.split: (r.attempted, r.kept, r.duplicates) for r in sv.ingest_counts(sv.parse(df)).collect()}
    assert counts == {"train": (2, 1, 1), "test": (1, 0, 1), None: (3, 1, 2)}


def test_append_is_resumable(spark, tmp_path):
    schema = "id string, system string, answer string"
    rows = spark.createDataFrame([("1", "a", "x"), ("2", "a", "y")], schema)
    path = str(tmp_path / "log")
    rs.append_new(rows.limit(1), path, ["id", "system"], schema)
    rs.append_new(rows, path, ["id", "system"], schema)
    rs.append_new(rows, path, ["id", "system"], schema)
    assert rs.read_log(spark, path, schema).count() == 2


def test_sheet_with_mark_and_quotes(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    path.write_text('﻿"amostra";"rotulo"\n"A;1";" r "\n"A""2";"2"\n"A3";""\n"A4";"9"\n', encoding="utf-8")
    rows = rs.with_label(rs.read_sheet(spark, str(path))).collect()
    assert [(r.amostra, r.label, r.label_kind) for r in rows] == [
        ("A;1", "R", "refusal"), ('A"2', "2", "label"), ("A3", "", "blank"), ("A4", "9", "invalid"),
    ]


def test_judge_scores_fold_names_and_nan(spark):
    raw = spark.createDataFrame(
        [("phi4", "q1", "s", "t", float("nan"), 0.5, "ignored")],
        "judge string, id string, system string, tier string, faithfulness double, "
        "`factual_correctness(mode=f1)` double, other string",
    )
    row = rs.judge_scores(raw, "phi4").first()
    assert row.faithfulness is None and row.factual_correctness == 0.5 and row.context_recall is None


def test_run_names(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(
        rs.run_slug(F.lit("Qwen2.5:7b")).alias("slug"),
        rs.model_family(F.lit("org/qwen3.5:9b")).alias("family"),
        rs.model_family(F.lit("7b")).alias("no_letters"),
        rs.run_label(F.lit("m"), F.lit("brando"), F.lit("bm25")).alias("label"),
        rs.run_folder(F.lit("m"), F.lit("estrito"), F.lit("off"), "m").alias("root"),
        rs.run_folder(F.lit("M x"), F.lit("brando"), F.lit("bm25"), "m").alias("folder"),
    ).first()
    assert tuple(row) == ("qwen2.5-7b", "qwen", "7b", "m[brando]+bm25", ".", "m-x__brando__bm25")


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(fx, "ROWS_PER_TASK", 50)
    assert fx.spread(spark.range(1000)).rdd.getNumPartitions() == 20


def test_generations_are_written_by_run_folder(spark, tmp_path):
    rows = spark.createDataFrame([("a:7b", "1"), ("b:9b", "2"), ("b:9b", "3")], "model string, id string")
    rs.write_generations(rows, str(tmp_path / "g"), ("a:7b", "b:9b"))
    assert sorted(p.name for p in (tmp_path / "g").iterdir() if p.is_dir()) == ["folder=a-7b", "folder=b-9b"]
    assert sorted((r.model, r.id) for r in rs.read_generations(spark, str(tmp_path / "g")).collect()) == [("a:7b", "1"), ("b:9b", "2"), ("b:9b", "3")]
