import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from millrace.llm import queries, spelling


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)):] == b[k + (len(b) >= len(a)):]


def brute(counts, ratio=2):
    words, around = list(counts), {w: [] for w in counts}
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    for w in words:
        for m in (len(w) - 1, len(w), len(w) + 1):
            around[w] += [x for x in by_length.get(m, []) if near(w, x)]
    form = {}
    for w in words:
        best = min(around[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(around[w]), counts.get(form[w])))
    return out


def rows(df):
    return [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()]


def check(spark, counts, **kw):
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = rows(spelling.variants(words, **kw))
    assert len(got) == len(set(got)) and set(got) == brute(counts)


def dense(seed, n, letters, low, high):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randint(low, high))): rng.randint(1, 300) for _ in range(n)}


def test_dense_vocabulary_matches_brute_force(spark):
    check(spark, dense(1, 900, "abé", 1, 6))


def test_words_beyond_the_levels_match_brute_force(spark):
    rng = random.Random(2)
    counts = dense(3, 200, "ab", 1, 7)
    for k in range(12):
        w = "".join(rng.choice("ab") for _ in range(rng.randint(6, 14)))
        counts[w] = 50
        for _ in range(12):
            i, c = rng.randrange(len(w)), rng.choice("abc")
            counts[rng.choice([w[:i] + w[i + 1:], w[:i] + c + w[i:], w[:i] + c + w[i + 1:]])] = rng.randint(1, 90)
    check(spark, counts, levels=7)


def test_depths_do_not_change_the_result(spark, monkeypatch):
    counts = dense(5, 500, "abé", 1, 7)
    words = spark.createDataFrame([(w,) for w in counts], "word string")
    found = [sorted(map(tuple, spelling.frontier(words, d).collect())) for d in (1, 3, 30)]
    assert found[0] == found[1] == found[2] and len(found[0]) == len(set(found[0])) > 100


def test_very_long_words_and_chains(spark):
    w = "abcdefghij" * 2_000
    counts = {w: 9, w[:15_000] + w[15_001:]: 3, w[:77] + "z" + w[78:]: 4, w + "q": 20, "kitten": 1, "kittens": 2, "mittens": 4, "mitten": 8}
    check(spark, counts)


def test_no_words(spark):
    empty = spark.createDataFrame([], "word string, n long")
    assert spelling.variants(empty).count() == 0
    odd = spark.createDataFrame([(None, 3), ("", 4), ("alone", 5), ("given", None)], "word string, n long")
    assert rows(spelling.variants(odd)) == [("alone", None, "alone", 5, 0, None)]


def of_documents(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 3}


def test_query_matches_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert set(rows(queries.QUERIES["op13_spelling_variants"](spark, folder))) == brute(of_documents(docs))


def test_words_of_odd_documents(spark):
    docs = [(1, None), (2, ""), (None, "ÉtÉabc ABCDE abcde"), (3, "x" * 300_000), (3, "abcde 12 abcde")] * 3
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["word"]: r["n"] for r in queries.spelled_words(df).groupBy("word").agg(F.count("*").alias("n")).collect() if len(r["word"]) > 4 and r["n"] > 2}
    assert got == of_documents(docs)
