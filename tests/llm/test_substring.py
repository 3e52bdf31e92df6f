import hashlib
import random

from millrace.llm import substring


def brute(rows, length):
    least, words = {}, []
    for doc_id, text in rows:
        w = (text or "").encode().split()
        words.append((doc_id, w))
        order = float("inf") if doc_id is None else doc_id
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            least[key] = min(least.get(key, float("inf")), order)
    out = []
    for doc_id, w in words:
        order = float("inf") if doc_id is None else doc_id
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if least[tuple(w[k : k + length])] < order:
                gone[k : k + length] = [True] * length
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((str(doc_id), len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]

    def say(n):
        return [rng.choice(words) for _ in range(n)]

    passages = [say(rng.randint(40, 140)) for _ in range(5)]
    base, rows = say(200), []
    for d in range(50):
        w = say(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 20)
            w += p[a : len(p) - rng.randint(0, 20)] + say(rng.randint(0, 30))
        rows.append((rng.randint(0, 10**6), " ".join(w)))
    for d in range(20):
        w = list(base)
        w[rng.randrange(200)] = "changed"
        rows.append((2 * 10**6 + d, "\n".join(w)))
    rows += [(3 * 10**6, rows[-1][1]), (3 * 10**6 + 1, "same " * 400), (3 * 10**6 + 2, "same " * 90), (3 * 10**6 + 3, "a b c " * 60), (3 * 10**6 + 4, "b c a " * 60)]
    rows += [(4 * 10**6, None), (4 * 10**6 + 1, ""), (None, rows[55][1]), (7, rows[55][1]), (7, rows[55][1]), (7, " ".join(passages[0])), (8, " ".join(passages[0]))]
    return rows


def test_matches_brute_force(spark):
    for seed, length, anchor in ((1, 50, 18), (2, 50, 12), (3, 20, 5)):
        rows = corpus(seed)
        got = substring.dedup(spark.createDataFrame(rows, "doc_id long, text string"), length, anchor)
        found = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect())
        assert found == brute(rows, length)


def test_clashing_columns_and_no_rows(spark):
    schema = "doc_id long, text string, key int, gone int, ord int"
    rows = [(1, "x " * 60, 0, 0, 0), (2, "x " * 60, 0, 0, 0)]
    got = sorted((r["doc_id"], r["n_removed"]) for r in substring.dedup(spark.createDataFrame(rows, schema)).collect())
    assert got == [(1, 0), (2, 60)]
    assert substring.dedup(spark.createDataFrame([], schema)).count() == 0
