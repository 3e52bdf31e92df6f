import hashlib
import random
import zlib

import numpy as np
import pytest

from millrace.llm import periods, queries


def brute_runs(words, min_length=12):
    """Maximal stretches of every smallest period, by comparing all pairs of words."""
    n, best = len(words), {}
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    x = np.array([ids[w] for w in words])
    for q in range(1, n // 2 + 1):
        equal = np.concatenate([[False], x[:-q] == x[q:], [False]])
        edges = np.flatnonzero(equal[1:] != equal[:-1])
        for s, e in zip(edges[0::2].tolist(), edges[1::2].tolist()):
            if e - s >= q and (s, e + q) not in best:
                best[s, e + q] = q
    found = [(s, e - s, q) for (s, e), q in best.items() if e - s >= max(min_length, 2 * q)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_collapse(words, runs):
    gone = set()
    for s, length, q in runs:
        gone |= set(range(s + q, s + length))
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def texts(seed):
    rng = random.Random(seed)
    out = [None, "", " \t", "one", "a " * 11, "a " * 12, "a b " * 6, "a b c " * 400 + "x" + " a b c" * 300]
    for _ in range(60):
        letters = rng.choice(["ab", "abc", "abcdefghijklmnop"])
        words = [rng.choice(letters) for _ in range(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 4)):
            at, p = rng.randint(0, len(words)), rng.randint(1, 40)
            part = [rng.choice(letters) for _ in range(p)]
            words[at:at] = (part * 9)[: rng.randint(p, 9 * p)]
        out.append(rng.choice([" ", "\n", " \x0b"]).join(words))
    fib = ["a", "a b"]
    for _ in range(12):
        fib.append(fib[-1] + " " + fib[-2])
    return out + [fib[-1], "é ü " * 30]


def expected(text, min_length=12):
    words = (text or "").encode().split()
    runs = brute_runs(words, min_length)
    return runs, hashlib.sha256(brute_collapse(words, runs)).hexdigest()


@pytest.mark.parametrize("core", [16, 64, periods.CORE])
def test_matches_brute_force_with_any_tiles(spark, core):
    rows = list(enumerate(texts(5))) + [(3, "a b " * 9), (3, "a b " * 9), (None, "a b " * 9)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    got = periods.with_runs(docs, core=core).collect()
    found = sorted((repr(r["id"]), [tuple(x) for x in r["runs"]], r["collapsed_sha256"]) for r in got)
    assert found == sorted((repr(i), *expected(t)) for i, t in rows)
    assert all((r["collapsed"] is None) == (not r["runs"]) for r in got)


def test_long_periods_of_a_long_text(spark):
    rng = random.Random(1)
    part = [str(rng.random()) for _ in range(21_000)]
    words = ["x"] * 40_000 + part + part + part[:500] + ["y", "z"] * 10_000
    docs = spark.createDataFrame([(1, " ".join(words))], "id long, text string")
    got = periods.with_runs(docs).first()["runs"]
    assert [tuple(r) for r in got] == [(0, 40_000, 1), (40_000, 42_500, 21_000), (82_500, 20_000, 2)]


def test_empty_table(spark):
    assert periods.with_runs(spark.createDataFrame([], "id long, text string")).count() == 0


def test_query_matches_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for d, text in docs:
        words = (text or "").encode().split()
        n, h = len(words), zlib.crc32(str(d).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        want[d] = (
            len(runs), *best, None if not runs else 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
            hashlib.sha256(brute_collapse(words, runs)).hexdigest(),
        )
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op12_periodic_runs"](spark, folder).collect()}
    assert got == want
