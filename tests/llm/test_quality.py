import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import quality
from millrace.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 5), st.integers(0, 5)), max_size=12))
def test_isotonic_is_the_best_rising_fit(pairs):
    n = np.array([a for a, _ in pairs], float)
    k = np.array([min(a, b) for a, b in pairs], float)
    got = quality.isotonic(n, k)
    assert len(got) == len(n) and (np.diff(got) >= -1e-12).all()
    for i in range(len(n)):  # the min-max formula of isotonic regression
        want = max(min(k[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, len(n))) for a in range(i + 1))
        assert abs(got[i] - want) < 1e-9


def test_held_out_accuracy(spark):
    scores = {r["doc_id"]: r for r in QUERIES["op10_quality_classifier"](spark, SMALL).collect()}
    assert len(scores) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").collect()
    held = [r for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(scores[r["doc_id"]]["held_out"] == (r in held) for r in labels)
    assert np.mean([scores[r["doc_id"]]["predicted"] == r["quality"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in scores.values())


def test_odd_rows_and_clashing_columns(spark):
    rows = [(1, "good words here", 5), (1, "good words here", 5), (None, None, 5), (2, "", 5), (3, "long text " * 30_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    stats = quality.document_statistics(docs)
    none = quality.fit(stats, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality.scored(stats, none).collect()} == {0.5}
    assert quality.good_documents(docs, none).columns == docs.columns
    assert quality.good_documents(docs, none).count() == 5
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (4, 1), (2, None)], "doc_id long, quality int")
    some = quality.fit(stats, labels)
    assert quality.good_documents(docs.limit(0), some).count() == 0
    assert quality.scored(stats, some).where((F.col("score") >= 0) & (F.col("score") <= 1)).count() == 5
