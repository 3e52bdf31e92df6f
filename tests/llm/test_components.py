import random

import numpy as np
import pyarrow as pa

from millrace.llm.components import components, local_roots, runs


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)]
    edges += [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(150)]
    edges = [e for e in edges if e[0] != e[1]]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == brute(edges)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_local_roots():
    rng = random.Random(3)
    for _ in range(50):
        n = rng.randint(1, 30)
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 30))]
        i, j = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        want = brute([*pairs, *((k, k) for k in range(n))])
        assert local_roots(n, i, j).tolist() == [want[k] for k in range(n)]


def test_runs_join_batches():
    batches = [pa.RecordBatch.from_pydict({"k": k, "v": list(range(len(k)))}) for k in ([1, 1, 2], [2], [], [2, 3], [4])]
    assert [(g.column("k")[0].as_py(), g.num_rows) for g in runs(iter(batches), ["k"])] == [(1, 2), (2, 3), (3, 1), (4, 1)]
