import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import mixing, quality
from test_line_dedup import brute as line_brute
from test_mixing import targets
from test_ngram_join import brute as near_brute

SMALL = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on what the one before kept."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        before = docs.collect()
        after = out.collect()
        if k < 4:
            assert out.columns == columns, name
        if name == "quality classifier":
            model = quality.fit(quality.document_statistics(docs), spark.read.parquet(f"{SMALL}/labels.parquet"))
            scores = model.scores(quality.statistics([r["text"].encode() for r in before]))
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r, s in zip(before, scores) if s >= 0.3}
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
            kept = {r["doc_id"] for r in after}
            assert np.mean([(d in kept) == (labels[d] == 1) for d in labels]) > 0.95
        elif name == "line dedup":
            want = line_brute([(r["doc_id"], r["text"]) for r in before])
            lines = {r["doc_id"]: len(r["text"].split("\n")) for r in before}
            assert {r["doc_id"]: r["text"] for r in after} == {d: t for d, (t, n) in want.items() if n < lines[d]}
            assert all(r["n_chars"] == len(r["text"]) for r in after)
        elif name == "n-gram Jaccard join":
            classes = near_brute([(r["doc_id"], r["text"]) for r in before])
            assert sorted(r["doc_id"] for r in after) == sorted(d for d, (c, _) in classes.items() if c == d)
        elif name == "mixing sources to target weights":
            sizes, taken = {}, {}
            for rows, sums in ((before, sizes), (after, taken)):
                for r in rows:
                    sums[r["source"]] = sums.get(r["source"], 0) + len(r["text"].split())
            want = targets(sizes)
            longest = max(len(r["text"].split()) for r in before)
            assert all(abs(taken.get(s, 0) - want[s]) <= longest / 2 + 1 for s in sizes)
        else:
            library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            ids = sum(len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in before)
            assert sum(r["length"] for r in after) == ids
            fill = {}
            for r in after:
                fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
            assert max(fill.values()) <= 2048 and len(fill) <= -(-ids // 2048) + 1
        docs = out


def test_run_has_the_rows_of_the_stages(spark):
    first = corpus_pipeline.run(spark, SMALL).agg(F.count(F.lit(1)), F.sum("length"), F.sum("ids_crc32")).first()
    again = corpus_pipeline.run(spark, SMALL).agg(F.count(F.lit(1)), F.sum("length"), F.sum("ids_crc32")).first()
    assert first == again and first[0] > 0


def test_odd_rows(spark):
    """Null texts, ids and sources, repeated rows, more columns, and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, key int, row int, copies int, id int, c int"
    more = (1, 2, 3, 4, 5)
    rows = [(1, "a b c d e f\ng h i", "en", "s", 1, *more)] * 2 + [(None, None, None, None, None, *more), (2, "", "en", None, 0, *more), (3, "x y\n" * 3000, "en", "t", 12_000, *more)]
    docs = spark.createDataFrame(rows, schema)
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, SMALL)
            if name != "best-fit packing":
                assert out.columns == docs.columns
            assert (out.count() > 0) == (frame is docs)
    near = STAGES["n-gram Jaccard join"](spark, docs, SMALL)
    assert sorted(str(r["doc_id"]) for r in near.collect()) == ["1", "2", "3", "None"]
    assert mixing.mix(docs, corpus_pipeline.WEIGHTS).where("text = ''").count() == 0
