import hashlib
import random
import re

from millrace.llm import digest_index as di

SCHEMA = "doc_id long, text string, row int, digest string"


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(norm(text), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        first = min(ids, key=lambda i: (i is None, i or 0))
        sha = hashlib.sha256(text.encode()).hexdigest()
        for n, i in enumerate(sorted(ids, key=lambda i: (i is None, i or 0))):
            out.append((i, first, len(ids), n == 0, sha))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    texts = ["", None, " ", "\t\n", "a b", "a  b", "a\x0bb", "a b", "é" * 5, "x" * 200_000, *[f"text {k}" for k in range(20)]]
    rows = [(i, rng.choice(texts)) for i in rng.sample(range(10_000), 300)]
    rows += [(rows[0][0], rows[0][1])] * 3 + [(rows[1][0], "other")] + [(None, "text 1"), (None, "only null")]
    rng.shuffle(rows)
    return rows


def result(df):
    return sorted(((r["id"], r["keep_id"], r["group_size"], r["kept"], bytes(r["digest"]).hex()) for r in df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0, "x") for i, t in rows], SCHEMA).repartition(5)


def test_matches_brute_force_however_it_is_parted(spark):
    rows = corpus(1)
    for batches in (1, 2, 5):
        assert result(di.dedup(frame(spark, rows), di.DigestIndex.create(spark, buckets=4), batches)) == brute(rows)


def test_index_outlives_its_session_and_batches_run_again(spark):
    index = di.DigestIndex.create(spark, buckets=4)
    first = di.digested(frame(spark, [(5, "a"), (6, "b"), (7, "b ")]))
    index.append(first, 0)
    again = di.DigestIndex.open(spark, index.path)
    assert again.buckets == 4 and again.rows().count() == 3
    again.append(first, 0)
    assert again.rows().count() == 3
    second = di.digested(frame(spark, [(1, "a"), (2, "c"), (3, "c")]))
    again.append(second, 1)
    assert {(r["batch"], r["keep"]["id"]) for r in again.rows().collect()} == {(0, 5), (0, 6), (0, 7), (1, 2)}
    assert {(r["id"], r["keep_id"], r["kept"]) for r in again.lookup(second).collect()} == {(1, 5, False), (2, 2, True), (3, 2, False)}


def test_index_side_is_merged_without_an_exchange(spark):
    index = di.DigestIndex.create(spark, buckets=4)
    index.append(di.digested(frame(spark, [(i, f"t{i}") for i in range(50)])), 0)
    plan = index.unknown(di.digested(frame(spark, [(1, "x")])), 1)._jdf.queryExecution().executedPlan().toString()
    join = plan[plan.index("SortMergeJoin"):]
    assert "LeftAnti" in join
    scan = join[: join.rindex("digest_index_")].splitlines()
    right = scan[max(i for i, line in enumerate(scan) if "+- Sort" in line or ":- Sort" in line):]
    assert not any("Exchange" in line for line in right)


def test_empty_table_and_one_hot_text(spark):
    index = di.DigestIndex.create(spark, buckets=4)
    assert di.dedup(frame(spark, [(1, "a")]).limit(0), index).count() == 0
    rows = [(i, "hot" if i % 3 else f"t{i}") for i in range(3000)]
    assert result(di.dedup(frame(spark, rows), di.DigestIndex.create(spark, buckets=4))) == brute(rows)
