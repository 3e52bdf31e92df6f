import math

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import topk


def brute(rows, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in sorted({(i, tuple(v)) for i, v in ok if i % 50 == 0}):
        scores = [(-min(max(sum(a * b for a, b in zip(v, w)), -(2**63)), 2**63 - 1), i) for i, w in ok if i != q and len(w) == len(v)]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def check(spark, rows, schema="vec_id long, embedding array<float>"):
    got = topk.top_k(spark.createDataFrame(rows, schema), F.col("vec_id") % 50 == 0, 5)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == brute([(r[0], r[1]) for r in rows])


def vectors(n, seed, scale=0.2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16)) * scale * rng.uniform(0.1, 3, n)[:, None] * np.linspace(2, 0.1, 16)
    return [(i, [float(np.float32(a)) for a in v]) for i, v in enumerate(x)]


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CHUNK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rows = vectors(700, 1)
    rows += [(1000 + i, rows[i % 3][1]) for i in range(60)]  # ties
    rows += [(2000, None), (2050, [None] * 16), (2100, [float("nan")] * 16), (2150, [0.0] * 16), (2200, [1.0, 2.0]), (2201, [1.0, -2.0]), (None, [1.0] * 16), (2250, [])]
    check(spark, rows)


def test_small_and_large_numbers(spark):
    check(spark, [(0, [3e30, 1.0]), (1, [3e30, 2.0]), (2, [-3e30, 1.0]), (50, [1e-9, -1e-9]), (51, [0.0, 0.0]), (3, [2e12, 1.0]), (4, [1e6, 7.0])])
    check(spark, [(0, [1.0]), (50, [2.0])])


def test_no_rows_and_clashing_columns(spark):
    schema = "vec_id long, embedding array<float>, x int, size string"
    check(spark, [(i, [float(i), 1.0], 1, "") for i in range(60)], schema)
    assert topk.top_k(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).count() == 0


def test_pruning_skips_pairs():
    """With falling spectrum and lengths few pairs are scored exactly."""
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(4000, 32)) * np.linspace(300, 5, 32) * rng.uniform(0.05, 1, 4000)[:, None])
    q = x[::200]
    scored = []
    exact = topk._exact
    try:
        topk._exact = lambda a, b, big: scored.append(len(a)) or exact(a, b, big)
        rotation = np.linalg.eigh(x.T @ x)[1][:, ::-1]
        i, ids, score = topk.search_chunk(q, np.arange(0, 4000, 200), np.full(20, -np.inf), x, np.arange(4000), rotation, 5)
    finally:
        topk._exact = exact
    assert len(i) == 100 and sum(scored) < 0.4 * 20 * 4000
