import math
from collections import Counter
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import ann, knn
from millrace.operators import lexical as lx
from millrace.operators import questions as qs
from millrace.operators import retrieve as rt
from millrace.plans import fixtures as fx

SMALL = "/root/testdata/sf0.001"


def parsed(spark, *texts):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "question_id string, question string")
    return {int(r.question_id): r for r in qs.parse_questions(df).collect()}


def test_question_parsing(spark):
    got = parsed(
        spark, "VGR_1 às 2023-04-11 10:09:48.7 e VGR_1, MM_1", "em 2023-04-11 10:09", "2023-04-11 10:09:481",
        "OV_1 em 2023-13-11 10:09:48", "aVGR_1 e VGR_12", "2023-04-11 10:09:48.1234567 SM_1", "éMM_1 xMM_1y",
    )
    assert got[0].stations == ["VGR_1", "MM_1"]
    assert (str(got[0].window_lo), str(got[0].window_hi)) == (
        "2023-04-11 10:09:43.700000", "2023-04-11 10:09:53.700000")
    for i in (1, 2):
        assert (str(got[i].window_lo), str(got[i].window_hi)) == (
            "2023-04-11 10:09:00", "2023-04-11 10:09:59.999999")
    assert got[3].stations == ["OV_1"] and got[3].ts is None and got[3].window_lo is None
    assert got[4].stations == [] and got[6].stations == []
    assert str(got[5].ts) == "2023-04-11 10:09:48.123456"


def ranked(spark, offsets, station="A", task="t"):
    rows = [
        ("q", i + 1, f"e{i}", 1.0 - i / 100, station,
         None if s is None else datetime(2024, 1, 1, 0, 0, s), task)
        for i, s in enumerate(offsets)
    ]
    return spark.createDataFrame(
        rows, "question_id string, rank int, event_id string, score double, station string, "
        "start_ts timestamp, current_task string"
    )


@pytest.mark.parametrize("offsets,kept", [
    ([0, 8, 16], ["e0", "e2"]), ([8, 0, 16], ["e0"]), ([0, None, None], ["e0", "e1", "e2"]),
    ([0, 10, 21], ["e0", "e2"]), ([0, 11, 22, 33, 44, 55], ["e0", "e1", "e2", "e3", "e4"]),
])
def test_time_dedup(spark, offsets, kept):
    out = rt.time_dedup(ranked(spark, offsets)).orderBy("rank").collect()
    assert [r.event_id for r in out] == kept
    assert [r.rank for r in out] == list(range(1, len(kept) + 1))


def test_other_task_is_no_repeat(spark):
    rows = ranked(spark, [0, 1]).withColumn(
        "current_task", F.when(F.col("rank") == 2, "other").otherwise(F.col("current_task"))
    )
    assert rt.time_dedup(rows).count() == 2


@pytest.fixture(scope="module")
def world(spark):
    index = fx.index_table(spark, SMALL).cache()
    questions = fx.questions(spark, SMALL).cache()
    return index, questions


def brute_force(index, questions, k):
    ids = np.array([r.event_id for r in index], dtype=object)
    v = np.array([r.embedding for r in index], dtype=float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for q in questions:
        x = np.array(q.embedding, dtype=float)
        s = np.round(v @ (x / np.linalg.norm(x)), 9)
        out[q.question_id] = [ids[i] for i in np.lexsort((ids, -s))[:k]]
    return out


def _top(hits):
    got = {}
    for r in hits.orderBy("question_id", "rank").collect():
        got.setdefault(r.question_id, []).append(r.event_id)
    return got


def test_knn_is_exact(world):
    index, questions = world
    want = brute_force(index.collect(), questions.collect(), 20)
    assert _top(rt.pool(rt.nearest(index, rt.vector_probes(questions)))) == want


def test_knn_in_small_tiles_and_groups_is_the_same(world, monkeypatch):
    index, questions = world
    want = brute_force(index.collect(), questions.collect(), 20)
    monkeypatch.setattr(knn, "TILE_BYTES", 64 * 8 * 30)
    monkeypatch.setattr(knn, "GROUP_BYTES", 64 * 8 * 45)
    monkeypatch.setattr(knn, "LEAD", 2)
    assert _top(rt.pool(rt.nearest(index, rt.vector_probes(questions)))) == want


def test_ties_go_to_the_smaller_id(spark):
    vectors = spark.createDataFrame(
        [(f"e{i:03}", "A", None, [1.0, float(i % 2)]) for i in range(300)] + [("z", "A", None, None)],
        "event_id string, station string, start_ts timestamp, embedding array<double>").repartition(7)
    probes = spark.createDataFrame([("p", "A", 3, [1.0, 0.0]), ("o", None, 4, [2.0, 2.0])], "probe_id string, key string, lim int, embedding array<double>")
    hits = knn.tile_hits(knn.laid_out(vectors), probes).join(probes, "probe_id")
    got = {(r.probe_id, r.probe_rank): r.event_id for r in knn.best(hits, F.col("lim")).collect()}
    assert got == {("p", 1): "e000", ("p", 2): "e002", ("p", 3): "e004", ("o", 1): "e001", ("o", 2): "e003", ("o", 3): "e005", ("o", 4): "e007"}
    assert knn.tile_hits(knn.laid_out(vectors), probes.limit(0)).count() == 0


def test_rows_in_any_order_make_few_chunks():
    keys = [str(i % 5) for i in range(500)]
    batch = pa.RecordBatch.from_pydict({
        "event_id": pa.array([f"e{i:03}" for i in range(500)]), "key": pa.array(keys),
        "unit": pa.array([[float(i), 1.0] for i in range(500)], pa.list_(pa.float64()))})
    got = list(knn.chunks(iter([batch])))
    assert [c["key"][0].as_py() for c in got] == list("01234")
    ids = got[2]["ids"][0].as_py()
    x = np.frombuffer(got[2]["data"][0].as_py()).reshape(-1, 2)
    assert ids == [f"e{i:03}" for i in range(2, 500, 5)] and x[:, 0].tolist() == list(range(2, 500, 5))


def test_rows_of_a_repeated_probe_count_each_time(spark):
    index = spark.createDataFrame(
        [(f"e{i}", "A", None, [1.0, float(i)]) for i in range(9)], "event_id string, station string, start_ts timestamp, embedding array<double>")
    probe = ("p", "q", None, None, None, 8, [1.0, 0.0])
    probes = spark.createDataFrame([probe, probe], "probe_id string, question_id string, station string, lo_us long, hi_us long, lim int, embedding array<double>")
    got = sorted((r.probe_rank, r.event_id) for r in rt.nearest(index, probes).collect())
    assert got == [(n + 1, f"e{n // 4}") for n in range(8)]  # two probes, each joined with two


def test_vectors_of_probes_are_not_broadcast(world):
    index, questions = world
    found = knn.tile_hits(knn.laid_out(index), rt.vector_probes(questions).select("probe_id", F.col("station").alias("key"), "lim", "embedding"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "q_data" in plan and "broadcast" not in plan and found.count() > 0


def test_floors_of_shares_leave_the_best(spark, monkeypatch):
    monkeypatch.setattr(knn, "GROUP_BYTES", 8 * 8 * 20)
    monkeypatch.setattr(knn, "FEW_PARTS", 2)
    monkeypatch.setattr(knn, "PRODUCT", (7, 16))
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(300, 8)), 1)
    index = spark.createDataFrame(
        [(f"e{i:03}", "AB"[i % 2], None, v) for i, v in enumerate(x.tolist())], "event_id string, station string, start_ts timestamp, embedding array<double>")
    probes = spark.createDataFrame(
        [(f"p{i:02}", [None, "A", "B", "C"][i % 4], 1 + i % 5, x[i].tolist()) for i in range(40)] + [("none", None, 3, None)],
        "probe_id string, key string, lim int, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for i in range(40):
        key, scores = [None, "A", "B", "C"][i % 4], np.round(unit @ unit[i], 9)
        ids = [n for n in range(300) if key is None or "AB"[n % 2] == key]
        want |= {(f"p{i:02}", f"e{n:03}", k + 1) for k, n in enumerate(sorted(ids, key=lambda n: (-scores[n], n))[:1 + i % 5])}
    got = {(r.probe_id, r.event_id, r.probe_rank) for r in knn.tile_best(knn.laid_out(index), probes).collect()}
    assert got == want


@pytest.fixture(scope="module")
def stored(spark, world, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("vectors"))
    knn.store(world[0], path)
    return knn.open_store(spark, path)


def test_stored_layout_gives_the_same_hits(world, stored):
    index, questions = world
    probes = rt.station_probes(qs.parse_questions(questions, fx.WINDOW_S))
    rows = lambda hits: sorted(map(tuple, hits.collect()))
    for fallback in (True, False):
        assert rows(rt.nearest(stored, probes, fallback=fallback)) == rows(rt.nearest(index, probes, fallback=fallback))


def test_windows_prune_folders_and_score_only_their_rows(spark, world, stored):
    index, questions = world
    probes = rt.station_probes(qs.parse_questions(questions, fx.WINDOW_S))
    pairs = knn.window_pairs(stored, probes)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    asked = [r.asDict() for r in probes.where("lo_us is not null").collect()]
    rows = stored.select("station", "start_us").collect()
    inside = sum(p["station"] == r.station and p["lo_us"] <= r.start_us <= p["hi_us"] for p in asked for r in rows)
    assert pairs.count() == inside
    # an index ten times as large, outside the windows: no more pairs
    far = stored.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(9)))).select(
        F.concat("event_id", F.lit("#"), "copy").alias("event_id"), "station", (F.col("day") + 9000).alias("day"),
        (F.col("slot") + 9000 * 144).alias("slot"), (F.col("start_us") + 9000 * knn.DAY_US).alias("start_us"), "unit")
    assert knn.window_pairs(stored.select(*far.columns).unionByName(far), probes).count() == inside


def test_filtered_hits_obey_filter_or_fall_back(world):
    index, questions = world
    p = qs.parse_questions(questions, fx.WINDOW_S)
    hits = rt.filtered_candidates(p, index).join(p, "question_id").join(
        index.select("event_id", F.col("station").alias("st"), "start_ts"), "event_id"
    ).where("size(stations) > 0")
    assert hits.where("not array_contains(stations, st)").count() == 0
    inside = "start_ts between window_lo and window_hi"
    mixed = hits.where("window_lo is not null").groupBy("question_id", "st").agg(
        F.expr(f"count_if({inside})").alias("a"), F.expr(f"count_if(not ({inside}))").alias("b")
    ).where("a > 0 and b > 0")
    assert mixed.count() == 0


def test_three_stations_share_the_fetch(spark, world):
    index, questions = world
    q = questions.limit(1).withColumn("question", F.lit("MM_1, EC_1 e SM_1 pararam?"))
    probes = rt.station_probes(qs.parse_questions(q)).collect()
    assert sorted((r.station, r.lim) for r in probes) == [("EC_1", 8), ("MM_1", 8), ("SM_1", 8)]


def test_all_lists_probed_is_exact(world):
    index, questions = world
    centroids = rt.mean_centroids(index, "label")
    hits = rt.pool(rt.ann_search(questions, index, centroids, 10, 5))
    assert _top(hits) == brute_force(index.collect(), questions.collect(), 20)


def test_trained_lists_recall_and_read_only_probed_folders(spark, world, tmp_path):
    index, questions = world
    vectors = knn.laid_out(index)
    built = ann.build(vectors, str(tmp_path / "lists"), top=8, sub=8, rounds=4)
    assert built.rows.count() == vectors.count() and built.rows.select("list_id").distinct().count() > 15
    again = ann.ListIndex(spark, str(tmp_path / "lists"))
    exact = _top(rt.pool(rt.nearest(index, rt.vector_probes(questions))))
    near = _top(rt.trained_search(questions, again, 40, 5).withColumn("rank", F.col("probe_rank")))
    recall = sum(len(set(near.get(q, [])) & set(ids)) for q, ids in exact.items()) / sum(map(len, exact.values()))
    assert recall >= 0.9
    every = _top(rt.trained_search(questions, again, 64, 5).withColumn("rank", F.col("probe_rank")))
    assert every == exact
    keys = spark.createDataFrame([(2,)], "top int")
    plan = knn.only(again.rows, keys.where("top >= 0"), ["top"])._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_unknown_mode_fails(world):
    index, questions = world
    with pytest.raises(Exception, match="unknown mode"):
        rt.route_by_mode(questions.withColumn("mode", F.lit("x")), index).collect()


def test_tokens_match_unicode_library(spark):
    texts = ["Estação HBW_1 às 10h", "ﬁm ½ ① ™ K ﬀ", "İstanbul ǆ ĳ ½x", "straße naïve CAFÉ", "", None, "日本 ㎏ ５ a̐b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select(tx.tokenize(F.col("t")).alias("a"), tx.tokenize_exact("t").alias("b")).collect():
        assert r.a == r.b
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    same = docs.select(tx.tokenize(F.col("text")).alias("a"), tx.tokenize_exact("text").alias("b"))
    assert same.where("a <> b").count() == 0


def test_bm25_edges(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, ""), (3, "b c")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a a z"), (2, "z")], "item_id long, text string")
    out = lx.bm25_topk(queries, docs, 5).collect()
    n, avg, tf, dl = 3, 5 / 3, 2, 3
    want = np.log(1 + (n - 1 + 0.5) / 1.5) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    assert [(r.item_id, r.doc_id) for r in out] == [(1, 1)]
    assert out[0].bm25 == pytest.approx(want, abs=1e-8)


def exhaustive(docs, queries, k):
    """Scores of all pairs, from token lists."""
    n, avg = len(docs), sum(len(t) for t in docs.values()) / max(1, len(docs))
    df = Counter(t for tokens in docs.values() for t in set(tokens))
    out = []
    for q, terms in queries.items():
        scores = []
        for d, tokens in docs.items():
            tf = Counter(tokens)
            parts = [(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)), tf[t]) for t in sorted(set(terms)) if tf[t]]
            s = sum(w * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(tokens) / avg)) for w, f in parts)
            if s > 0:
                scores.append((-round(s, 9), d))
        out += [(q, d, i + 1, round(-s, 6)) for i, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("block,shard", [(256, 65_536), (4, 30)])
def test_bounded_search_equals_exhaustive_scores(spark, monkeypatch, tmp_path, block, shard):
    monkeypatch.setattr(lx, "BLOCK", block)
    monkeypatch.setattr(lx, "SHARD", shard)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").unionByName(
        spark.createDataFrame([(9001, "zzz nowhere"), (9002, None), (9003, "the the a")], "item_id long, text string"))
    tokens = lambda df, key: {r[0]: r[1] for r in df.select(key, tx.tokenize(F.col("text"))).collect()}
    index = lx.build(docs, str(tmp_path / "texts"))
    want = exhaustive(tokens(docs, "doc_id"), tokens(items, "item_id"), 10)
    got = lx.bm25_topk(items, lx.TextIndex(spark, str(tmp_path / "texts")), 10).collect()
    assert sorted((r.item_id, r.doc_id, r.rank, round(r.bm25, 6)) for r in got) == want
    stats = {r.term: r.df for r in index.corpus_stats().collect()}
    assert stats == {r.term: r.df for r in lx.corpus_stats(docs).collect()}


def test_blocks_below_the_floor_are_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lx, "BLOCK", 8)
    common = [(i, "common words here " * (1 + i % 5) + f"own{i}") for i in range(400)]
    rare = [(1000 + i, "rare find of common words") for i in range(5)]
    index = lx.build(spark.createDataFrame(common + rare, "doc_id long, text string"), str(tmp_path / "texts"))
    queries = spark.createDataFrame([(1, "rare find common words")], "item_id long, text string")
    asked = lx.term_queries(queries, "item_id", "text").join(index.terms, "term")
    floors = index.floors(asked, 5, "item_id")
    read = index.blocks_to_read(asked, floors, "item_id")
    assert {r.term for r in read.collect()} <= {"rare", "find"}
    assert index.in_reach(asked, floors, "item_id").count() == 5
    assert [r.doc_id for r in index.search(queries, 5, "item_id", "text").orderBy("rank").collect()] == [1000 + i for i in range(5)]


def test_common_words_are_scored_in_one_scan(spark, tmp_path, monkeypatch):
    for name, value in {"QUERIES": 2, "TEXTS": 7, "TERMS": 20, "ROWS": 3}.items():
        monkeypatch.setattr(lx, name, value)
    monkeypatch.setattr(lx.TextIndex, "in_reach", lambda *_: pytest.fail("postings of common words were read"))
    rng = np.random.default_rng(2)
    words = lambda n: " ".join(rng.choice(list("abcdefg"), n))
    docs = {i: words(int(rng.integers(0, 12))) for i in range(90)}
    queries = {i: words(4) for i in range(9)} | {9: "nowhere"}
    index = lx.build(spark.createDataFrame([*docs.items(), (None, "a b c")], "doc_id long, text string"), str(tmp_path / "texts"))
    # the text without an id counts in the corpus and is no result
    want = exhaustive({i: t.split() for i, t in docs.items()} | {-1: list("abc")}, {i: t.split() for i, t in queries.items()}, 95)
    want = sorted((q, d, s) for q, d, _, s in want if d != -1)
    got = lx.bm25_topk(spark.createDataFrame([*queries.items()], "item_id long, text string"), index, 95)
    assert sorted((r.item_id, r.doc_id, round(r.bm25, 6)) for r in got.collect()) == want
    few = lx.bm25_topk(spark.createDataFrame([*queries.items()], "item_id long, text string"), index, 3).collect()
    kept = {}
    for q, d, s in sorted(want, key=lambda r: (r[0], -r[2], r[1])):
        kept.setdefault(q, []).append(d)
    assert {(r.item_id, r.rank): r.doc_id for r in few} == {(q, n + 1): d for q, ids in kept.items() for n, d in enumerate(ids[:3])}


def test_frequent_terms_lie_in_many_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lx, "SHARD", 50)
    monkeypatch.setattr(lx, "BLOCK", 10)
    index = lx.build(spark.createDataFrame([(i, "all") for i in range(400)], "doc_id long, text string"), str(tmp_path / "texts"))
    rows = index.blocks.groupBy("shard").agg(F.sum(F.size("postings")).alias("n"), F.max(F.size("postings")).alias("most")).collect()
    assert len(rows) == 8 and sum(r.n for r in rows) == 400 and max(r.n for r in rows) < 100 and max(r.most for r in rows) <= 10


def test_fusion_ties_follow_dense_order(spark):
    rows = [("q", "a", 1, 1.0), ("q", "b", 2, 2.0), ("one", "a", 1, 0.0)]
    df = spark.createDataFrame(rows, "question_id string, event_id string, rank int, bm25 double")
    got = {(r.question_id, r.event_id): r.rank for r in lx.fuse(df).collect()}
    assert got == {("q", "a"): 1, ("q", "b"): 2, ("one", "a"): 1}


def test_questions_read_the_stored_index_rows(spark):
    """The log is read once for the index rows, not by every reader of questions."""
    files = fx.questions(spark, SMALL).inputFiles()
    assert files and not any("events.parquet" in f for f in files)


def test_a_vector_length_is_computed_once(spark):
    assert str(knn.unit(F.col("v"))).count("aggregate") == 1
    rows = [([3.0, 4.0],), ([0.0, 0.0],), (None,), ([],), ([1.0, None],)]
    got = [r.u for r in spark.createDataFrame(rows, "v array<float>").select(knn.unit(F.col("v")).alias("u")).collect()]
    assert got == [[0.6, 0.8], [0.0, 0.0], None, [], [None, None]]


def test_few_pairs_of_a_cell_are_scored_in_double(monkeypatch):
    scored = []
    products = knn._scores
    monkeypatch.setattr(knn, "_scores", lambda q, x, n, m: scored.append(len(n)) or products(q, x, n, m))
    rng = np.random.default_rng(4)
    length = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    x, q, lims = length(rng.standard_normal((20_000, 16))), length(rng.standard_normal((50, 16))), rng.integers(1, 20, 50)
    x[5_000:9_000:7] = x[3]  # rows that tie
    q[7] = x[3]
    for floor in (np.full(50, -np.inf), np.full(50, 0.4)):
        i, j, s = knn._best_of(q, x, lims, floor)
        every = np.round(q @ x.T, knn.SCORE_DIGITS)
        for probe in range(50):
            want = [r for r in np.lexsort((np.arange(len(x)), -every[probe])) if every[probe, r] >= floor[probe]][:lims[probe]]
            assert j[i == probe].tolist() == want
            assert np.allclose(s[i == probe], every[probe, want], atol=1e-8)
    assert sum(scored) < 2 * 50 * 2 * 20 + 4_000


ASKED = ("O que ocorreu?", "O que a estação MM_1 fez?", "O que as estações MM_1 e SM_1 faziam?", "Em 2024-01-01 00:00:30 MM_1", None)


def ablation(spark, texts):
    rng = np.random.default_rng(6)
    vector = lambda: [float(v) for v in rng.standard_normal(4)]
    index = spark.createDataFrame(
        [(f"e{n:03d}", ("MM_1", "SM_1", "OV_1")[n % 3], datetime(2024, 1, 1, 0, n // 20, n % 20 * 3), "not ready", f"task {n % 4}", "sub", 1.0, n % 5 == 0,
          f"{('MM_1', 'SM_1', 'OV_1')[n % 3]} fez {n % 7}", vector()) for n in range(120)],
        "event_id string, station string, start_ts timestamp, current_state string, current_task string, current_sub_task string, duration_s double, "
        "is_anomaly boolean, log_text string, embedding array<float>").withColumn("end_ts", F.col("start_ts"))
    questions = spark.createDataFrame([(i, t, vector()) for i, t in texts], "question_id string, question string, embedding array<float>")
    return questions, index


def test_ablation_asks_once_what_both_searches_ask(spark, monkeypatch):
    """Hits equal those of the four separate calls; a question without a station is one probe, also if its id repeats."""
    texts = [(f"q{n}", t) for n, t in enumerate(ASKED)] + [("twice", ASKED[0]), ("twice", "O que fez?"), ("mixed", ASKED[0]), ("mixed", ASKED[1])]
    questions, index = ablation(spark, texts)
    asked = []
    nearest = rt.nearest
    monkeypatch.setattr(rt, "nearest", lambda rows, probes, *a, **k: asked.append(probes.count()) or nearest(rows, probes, *a, **k))
    hits = rt.ablation_hits(questions, index, 3, 30, 5).collect()
    assert asked == [3 + 3 * 2 + 1 + 1 + 4]  # q0 and both of "twice" once; q1 to q3, one of them with two stations; q4; "mixed"
    got = sorted((r.config, r.question_id, r["rank"], r.event_id) for r in hits)
    want = []
    for config, filtered, rerank in rt.CONFIGS:
        if filtered:
            part = rt.retrieve_filtered(questions, index, 3, rerank, 30, 5)
        else:
            part = rt.retrieve_vector(questions, index, 3, rerank, 5)
        want += [(config, r.question_id, r["rank"], r.event_id) for r in part.collect()]
    assert got == sorted(want)


def test_many_cells_have_partitions_of_their_own(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(f"e{n:03d}", "A", [float(v) for v in rng.standard_normal(4)]) for n in range(200)], "event_id string, station string, embedding array<double>")
    probes = spark.createDataFrame([(f"p{n}", None, 3, [float(v) for v in rng.standard_normal(4)]) for n in range(60)], "probe_id string, key string, lim int, embedding array<double>")
    vectors = rows.withColumn("unit", knn.unit(F.col("embedding")))
    want = sorted(map(tuple, knn.tile_best(vectors, probes).collect()))
    monkeypatch.setattr(knn, "LEAST", 20)
    monkeypatch.setattr(knn, "GROUP_BYTES", 8 * 4 * 30)  # 200 * 60 / 20**2 full cells, times 4
    hits = knn.tile_hits(vectors, probes)
    assert hits.rdd.getNumPartitions() > 8
    assert sorted(map(tuple, knn.tile_best(vectors, probes).collect())) == want


def test_lists_of_hits_are_gathered_where_they_arrive(spark):
    """Hits are moved once, before they are gathered; no lists of single hits are sorted and moved."""
    plan = rt.time_dedup(ranked(spark, [0, 8, 16]))._jdf.queryExecution().executedPlan().toString()
    gathered, moved = plan.index("collect_list"), plan.index("Exchange")
    assert plan.count("Exchange") == 1 and plan.rindex("collect_list") < moved and gathered < moved
