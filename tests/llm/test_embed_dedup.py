import numpy as np

from millrace.llm import embed_dedup
from millrace.llm.components import local_roots


def brute(rows, threshold=0.9):
    ok = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {i: (0, i, True) for i, _ in rows}
    ok.sort(key=lambda r: r[0])
    n = len(ok)
    pairs = [
        (a, b) for a in range(n) for b in range(a + 1, n) if len(ok[a][1]) == len(ok[b][1])
        and ok[a][1] @ ok[b][1] / (np.linalg.norm(ok[a][1]) * np.linalg.norm(ok[b][1])) >= threshold
    ]
    i, j = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
    root = local_roots(n, i, j)
    for k in range(n):
        out[ok[k][0]] = (int((i == k).sum() + (j == k).sum()), ok[root[k]][0], ok[root[k]][0] == ok[k][0])
    return out


def rows_of(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(150, 24))
    group = x[0] + rng.normal(size=(120, 24)) * rng.uniform(0.05, 0.5, 120)[:, None]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate([*x, *group])]
    rows += [(400 + i, rows[3][1]) for i in range(5)] + [(500, (5 * np.array(rows[3][1])).tolist())]
    rows += [(600, None), (601, []), (602, [0.0] * 24), (603, [None] + [1.0] * 23), (604, [float("nan")] * 24), (605, [float("inf")] + [1.0] * 23)]
    return rows + [(700, [1.0, 2.0]), (701, [2.0, 4.0]), (702, [3.0]), (703, [3e38] * 24), (704, [1e-40] * 24)]


def check(spark, rows):
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    want = brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got.collect()} == want


def test_matches_brute_force(spark):
    check(spark, rows_of(1))


def test_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    check(spark, rows_of(2))


def test_repeated_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>, label int, kept string, c int"
    rows = [(1, [1.0, 0.0], 0, "", 0), (1, [1.0, 0.0], 0, "", 0), (None, [1.0, 0.0], 0, "", 0), (None, None, 0, "", 0)]
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, 0, 0, True), (0, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True)]
    assert embed_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_recall_at_the_threshold():
    """Pairs right at the threshold meet in some table at least as often as planned."""
    rng = np.random.default_rng(8)
    a = rng.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1, keepdims=True)
    width, tables = embed_dedup.plan(50_000, 64, 0.9, 0.9999)
    met = np.zeros(len(a), bool)
    for t in range(tables):
        ca, cb = embed_dedup.table_codes(a, t, width), embed_dedup.table_codes(b, t, width)
        met |= (ca[:, :, None] == cb[:, None, :]).any((1, 2))
    assert met.mean() >= 0.998
