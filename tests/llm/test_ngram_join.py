import random
import re
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np

from millrace.llm import ngram_join


def grams(text, n=5):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, threshold=0.8):
    """(class_id, n_links) of each row by comparing all pairs; rows have different ids."""
    sets = {i: grams(t) for i, t in rows}
    ids, near = sorted(sets), defaultdict(set)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                near[a].add(b)
                near[b].add(a)
    out = {}
    for i in ids:
        if i not in out:
            todo, seen = [i], {i}
            while todo:
                new = near[todo.pop()] - seen
                seen |= new
                todo += new
            for j in seen:
                out[j] = (i, len(near[j]))
    return out


def corpus(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]

    def say(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    rows = [(i, " ".join(say(rng.randint(0, 120)))) for i in range(60)]
    base = say(90)
    for i in range(60, 140):  # a large group of near copies and copies
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w)))
    common = " ".join(say(30))
    rows += [(i, f"{common} " + " ".join(say(rng.randint(5, 40)))) for i in range(140, 180)]
    return rows + [(180, None), (181, ""), (182, " \n"), (183, "a b"), (184, "a  b"), (185, "a b c"), (186, "a b c d e"), (187, "a b c d e"), (188, "x y z " * 4000), (189, "x y z " * 4001)]


def test_matches_brute_force(spark):
    rows = corpus()
    got = ngram_join.join(spark.createDataFrame(rows, "id long, text string"))
    assert {r["id"]: (r["class_id"], r["n_links"]) for r in got.collect()} == brute(rows)


def test_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 8)
    monkeypatch.setattr(ngram_join, "BLOCK_WORDS", 900)
    rows = corpus(9)
    got = ngram_join.join(spark.createDataFrame(rows, "id long, text string"))
    assert {r["id"]: (r["class_id"], r["n_links"]) for r in got.collect()} == brute(rows)


def test_repeated_null_and_no_rows(spark):
    schema = "id long, text string, c int, sketch string"
    rows = [(1, "a b c d e f", 0, ""), (1, "a b c d e f", 0, ""), (None, "a b c d e f", 0, ""), (2, "other words", 0, "")]
    got = sorted(((r["id"] or 0), r["class_id"], r["n_links"]) for r in ngram_join.join(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, 1, 2), (1, 1, 2), (1, 1, 2), (2, 2, 0)]
    assert ngram_join.join(spark.createDataFrame([], schema)).count() == 0


def test_depth_reaches_the_target():
    depth = ngram_join.forest_depth()
    recall = [1 - (1 - ngram_join.THRESHOLD**d) ** ngram_join.TREES for d in (depth, depth + 1)]
    assert recall[0] >= ngram_join.TARGET_RECALL > recall[1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1, max_size=12), min_size=1, max_size=8), st.floats(0.1, 1))
def test_linked_pairs(sets, threshold):
    i, j = ngram_join.linked_pairs([np.array(sorted(s), np.uint64) for s in sets], threshold)
    want = {
        (a, b) for a in range(len(sets)) for b in range(a + 1, len(sets))
        if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9
    }
    assert {(min(p), max(p)) for p in zip(i.tolist(), j.tolist())} == want
