import random

from pyspark.sql import functions as F

from millrace.llm import line_dedup


def brute(rows):
    """Rows are (doc_id, text) with different ids. Lines go that stand in two lines in a row (not both blank) that came before."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if text is None:
            out[doc_id] = (None, 0)
            continue
        lines, gone = text.split("\n"), set()
        for i in range(len(lines) - 1):
            if lines[i].strip(" ") or lines[i + 1].strip(" "):
                gone |= {i, i + 1} if tuple(lines[i : i + 2]) in seen else set()
                seen.add(tuple(lines[i : i + 2]))
        left = [x for i, x in enumerate(lines) if i not in gone]
        out[doc_id] = ("\n".join(left), len(gone))
    return out


def corpus(seed):
    rng = random.Random(seed)
    shared = [[f"shared {k} {i}" for i in range(rng.randint(2, 25))] for k in range(4)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randint(0, 5)):
            lines += rng.choice(shared) if rng.random() < 0.5 else [f"own {d} {rng.random()}" for _ in range(rng.randint(1, 6))]
        rows.append((d, "\n".join(lines)))
    rows += [(1000, rows[3][1]), (1001, "same\n" * 50), (1002, "same\n" * 50), (1003, None), (1004, ""), (1005, "\n\n\n"), (None, rows[3][1])]
    return rows + [(1006, "\n".join(f"long {i % 997}" for i in range(6000)))]


def test_matches_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r["doc_id"]: (r["text"], r["removed_lines"]) for r in line_dedup.dedup_lines(docs, drop_emptied=False).collect()}
        assert got == brute(rows)


def test_borders_resist_shifts(spark):
    passage = [f"line {i}" for i in range(60)]
    rows = [(1, "\n".join(passage)), (2, "\n".join(["new", "lines", "first", *passage]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for divisor, least in ((1, 60), (3, 45), (8, 20)):
        got = {r["doc_id"]: r["removed_lines"] for r in line_dedup.dedup_lines(docs, divisor=divisor).collect()}
        assert got[1] == 0 and least <= got[2] <= 60


def test_lines_that_share_a_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "fast_id", lambda line: F.struct(F.length(line).cast("long").alias("a"), F.lit(0).cast("long").alias("b")))
    rows = [(1, "aa\nbb\ncc"), (2, "xx\nyy\nzz"), (3, "bb\ncc\ndd")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {1: rows[0][1], 2: rows[1][1], 3: "dd"}


def test_recall_of_repeated_runs_in_different_texts(spark):
    """Of the lines in runs of two and more that stand in an earlier, different text: all go."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("text IS NOT NULL")
    rows = [tuple(r) for r in docs.collect()]
    whole, want = {}, 0
    want = {d: n for d, (t, n) in brute(rows).items()}
    copies = set()
    for d, t in sorted(rows):
        if t in whole:
            copies.add(d)
        whole.setdefault(t, d)
    found = {r["doc_id"]: r["removed_lines"] for r in line_dedup.dedup_lines(docs, drop_emptied=False).collect()}
    elsewhere = [d for d in want if d not in copies]
    assert sum(want[d] for d in elsewhere) > 100
    assert sum(min(found[d], want[d]) for d in elsewhere) >= 0.9 * sum(want[d] for d in elsewhere)
    assert found == want


def test_repeated_rows_clashing_columns_and_empty_tables(spark):
    text = "\n".join(f"l{i}" for i in range(12))
    rows = [(1, text, 0, "k"), (1, text, 0, "k"), (2, text, 0, "k"), (2, "other", 0, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, removed_lines int, key string")
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "removed_lines_"]
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == [(1, text), (1, text), (2, "other")]
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_short_passages_in_different_texts(spark):
    """Runs of 2 to 5 lines between own lines: all go but the first, where sparse borders leave most."""
    runs = [[f"run {k} {i}" for i in range(2 + k % 4)] for k in range(40)]
    rows = [(10 * d + k, "\n".join([f"before {d} {k}", *run, f"after {d} {k}"])) for k, run in enumerate(runs) for d in (0, 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sum(map(len, runs))
    removed = [line_dedup.dedup_lines(docs, divisor=d).selectExpr("sum(removed_lines)").first()[0] for d in (3, 1)]
    assert removed[0] < want and removed[1] == want
