from collections import Counter, defaultdict

from pyspark.sql import functions as F

from millrace.llm import mixing

WEIGHTS = (5, 2, 1)


def targets(sizes, most=3):
    """The definition, step by step."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        share = {s: most * sizes[s] if s in capped else left * weight[s] / free for s in names}
        over = {s for s in names if s not in capped and share[s] > most * sizes[s]}
        if not over:
            return share
        capped |= over
        if len(capped) == len(names):
            return {s: most * sizes[s] for s in names}


def rows_of(n=900):
    out = [(i, " ".join(["w"] * (i * 37 % 90)), ["b", "a", "Z", "é", None][i * i % 5] if i % 3 else "hot") for i in range(n)]
    return out + [(n, "w " * 5000, "tiny"), (n + 1, None, "hot"), (n + 2, "", "nothing"), (5, "twice here", "a"), (5, "twice here", "a")]


def test_targets_totals_and_copies(spark, make):
    rows = rows_of()
    got = mixing.mixed(mixing.sizes_of(make(rows)), WEIGHTS).collect()
    assert len(got) == len(rows)
    sizes, largest = defaultdict(int), defaultdict(int)
    for _, text, source in rows:
        n = len((text or "").split())
        sizes[source] += n
        largest[source] = max(largest[source], n)
    want = targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        ratio = r["target"] / r["source_size"] if r["source_size"] else 0
        assert r["copies"] <= 3 and (r["size"] == 0 or int(ratio + 1e-9) <= r["copies"] <= int(ratio) + 1)
        taken[r["source"]] += r["copies"] * r["size"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6


def test_reruns_agree_whatever_the_partitions(spark, make):
    docs = make(rows_of(300))
    runs = [
        Counter((r["id"], r["size"], r["copies"]) for r in mixing.mixed(mixing.sizes_of(d), WEIGHTS).collect())
        for d in (docs, docs.repartition(7, "text"))
    ]
    assert runs[0] == runs[1]


def test_expectation_is_kept(spark, make):
    """Over many equal sources the share taken comes near each document's ratio."""
    rows = [(i, " ".join(["w"] * (1 + i % 7)), f"s{i // 30:03d}") for i in range(3000)]
    got = mixing.mixed(mixing.sizes_of(make(rows)), WEIGHTS).collect()
    drift = sum(r["copies"] - r["target"] / r["source_size"] for r in got) / len(got)
    assert abs(drift) < 0.02


def test_rows_are_repeated_with_all_columns(spark):
    rows = [(i, "w " * (i % 9), f"s{i % 2}", i, i) for i in range(60)] + [(None, "x y", None, 1, 1)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row int, copies int")
    mixed = mixing.mix(docs, WEIGHTS)
    assert mixed.columns == docs.columns
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 9
    assert mixing.mix(docs.limit(0), WEIGHTS).count() == 0


def test_equal_rows_are_dealt_over_blocks(spark, make, monkeypatch):
    """20 000 equal rows, with a null id or (in mix) with row numbers: no block holds many of them."""
    largest = []

    def stored(df, name):
        out = kept(df, name)
        if name == "mixed":
            largest.append(out.agg(F.max(F.size("state.settled"))).first()[0])
        return out

    kept = mixing.materialise
    monkeypatch.setattr(mixing, "materialise", stored)
    rows = [(None, "one two three", None)] * 20_000 + [(i, "w " * (1 + i % 9), "abc"[i % 3]) for i in range(4000)]
    docs = make(rows)
    runs = []
    for frame in (docs, docs.repartition(7)):
        got = mixing.mixed(mixing.sizes_of(frame), WEIGHTS).collect()
        assert len(got) == len(rows)
        alike = [r for r in got if r["id"] is None]
        assert abs(sum(r["copies"] * r["size"] for r in alike) - alike[0]["target"]) <= 1.5 + 1e-6
        runs.append(Counter((r["id"], r["size"], r["copies"]) for r in got))
    assert runs[0] == runs[1]
    assert abs(mixing.mix(docs, WEIGHTS).where("source IS NULL").count() * 3 - alike[0]["target"]) <= 1.5 + 1e-6
    assert max(largest) < 4 * mixing.BLOCK
