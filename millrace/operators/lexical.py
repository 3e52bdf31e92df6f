"""BM25 over a stored inverted index, and reciprocal rank fusion.

The index has three tables. `texts` holds each text's different terms with their counts, from one tokenisation.
`terms` holds how many texts a term occurs in and the highest weight it gives any text. `blocks` holds the postings of a
term by falling weight, BLOCK to a row, with the block's highest weight; a term of more than SHARD texts is dealt over
shards, so that no task sorts or reads a frequent term alone.

A search finds a floor first: the k best texts by the first blocks of a query's few weightiest terms, scored in full,
give a score that the k-th best reaches at least. If the postings that then remain to be read are more than the texts,
texts are scored in one scan: chunks of texts against blocks of queries, each a product of weights and terms, of which only
scores that reach the floor leave the task. Otherwise postings are read: terms whose highest weights add up to less than the floor can't bring
a text there alone; their postings aren't read. Of the others, a block is read only if its highest weight and those of all
other terms reach the floor. Every posting of a text above the floor lies in such a block, so sums over them bound what remains;
texts still in reach are scored in full from `texts`. Results equal those of scoring everything.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.columns import let
from millrace.functions.text import hit_text, tokenize
from millrace.session import materialise, scratch_path

# Usual constants of BM25 and of rank fusion.
K1 = 1.5
B = 0.75
RRF_K = 60

BLOCK = 256
SHARD = 65_536
LEADING_TERMS = 8
#: Queries of a block, texts and terms of a chunk, texts of one product.
QUERIES, TEXTS, TERMS, ROWS = 256, 1024, 1 << 17, 256
#: Room for the order of additions in comparisons with bounds.
SLACK = 1e-6


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1.0 + (n_docs - df + 0.5) / (df + 0.5))


def term_weight(weight: Column, tf: Column, doc_len: Column, avg_len: Column) -> Column:
    norm = K1 * (1.0 - B + B * doc_len / avg_len)
    return weight * tf * (K1 + 1.0) / (tf + norm)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different terms of each text, sorted, with their counts, instead of its tokens (the last column)."""
    for batch in batches:
        tokens = batch.column(batch.num_columns - 1)
        codes = tokens.flatten().dictionary_encode()
        names = codes.dictionary.to_numpy(zero_copy_only=False)
        order = np.argsort(names)
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        owner = np.repeat(np.arange(batch.num_rows), tokens.value_lengths().to_numpy())
        cells, counts = np.unique(owner * max(1, len(names)) + rank[codes.indices.to_numpy()], return_counts=True)
        ends = np.searchsorted(cells, np.arange(batch.num_rows + 1) * max(1, len(names))).astype(np.int32)
        terms = pa.array(names[order][cells % max(1, len(names))], pa.string())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(np.diff(np.append(0, np.cumsum(tokens.value_lengths().to_numpy()))).astype(np.int64)),
             pa.ListArray.from_arrays(pa.array(ends), terms), pa.ListArray.from_arrays(pa.array(ends), pa.array(counts))],
            names=[*batch.schema.names[:-1], "len", "terms", "tfs"])


def counted(docs: DataFrame, doc_id: str, text: Column) -> DataFrame:
    """(doc_id, len, terms, tfs): every text tokenised once."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), tokenize(text).alias("tokens"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_counted, f"doc_id {kind}, len long, terms array<string>, tfs array<long>")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, len, terms, tfs) as chunks of at most TEXTS texts and about TERMS terms."""
    for batch in batches:
        ends = np.cumsum(batch.column("terms").value_lengths().to_numpy())
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            n = min(TEXTS, max(1, int(np.searchsorted(ends, before + TERMS)) - at), batch.num_rows - at)
            part, at = batch.slice(at, n), at + n
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            yield pa.RecordBatch.from_arrays(
                [one(part.column("doc_id")), one(part.column("len")), one(part.column("terms").value_lengths()),
                 one(part.column("terms").flatten()), one(part.column("tfs").flatten())], names=["doc_ids", "lens", "sizes", "words", "tfs"])


def _scan(batches: Iterator[pa.RecordBatch], k: int, names: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
    """(query, doc_id, bm25) of chunks beside blocks of queries: positive scores that reach the query's floor, which rises."""
    weights: dict[int, tuple[pa.Array, np.ndarray]] = {}
    floors: dict[int, np.ndarray] = {}
    for batch in batches:
        for n in range(batch.num_rows):
            values = {c: batch.column(c)[n].values for c in ("doc_ids", "lens", "sizes", "words", "tfs", "queries")}
            block, queries = batch.column("block")[n].as_py(), values["queries"]
            if block not in weights:
                asked = queries.field("terms")
                owner = np.repeat(np.arange(len(queries)), asked.value_lengths().to_numpy())
                codes = asked.flatten().field("term").dictionary_encode()
                matrix = np.zeros((len(codes.dictionary), len(queries)))
                np.add.at(matrix, (codes.indices.to_numpy(), owner), asked.flatten().field("idf").to_numpy())
                weights[block], floors[block] = (codes.dictionary, matrix), queries.field("floor").to_numpy().copy()
            (known, matrix), floor = weights[block], floors[block]
            code = pc.index_in(values["words"], value_set=known)
            held = code.is_valid().to_numpy(zero_copy_only=False)
            lens, tf = values["lens"].to_numpy(), values["tfs"].to_numpy()[held]
            owner = np.repeat(np.arange(len(lens)), values["sizes"].to_numpy())[held]
            norm = K1 * (1.0 - B + B * lens / batch.column("avg_len")[n].as_py())
            share = tf * (K1 + 1.0) / (tf + norm[owner])
            code = code.drop_null().to_numpy()
            scores = np.empty((len(lens), len(queries)))
            for at in range(0, len(lens), ROWS):
                lo, hi = np.searchsorted(owner, [at, at + ROWS])
                dense = np.zeros((min(ROWS, len(lens) - at), len(known)))
                dense[owner[lo:hi] - at, code[lo:hi]] = share[lo:hi]
                scores[at:at + ROWS] = dense @ matrix
            scores = np.round(scores, 9)
            if len(lens) >= k:
                np.maximum(floor, np.partition(scores, len(lens) - k, axis=0)[len(lens) - k], out=floor)
            d, q = np.nonzero((scores > 0) & (scores >= floor))
            yield pa.RecordBatch.from_arrays(
                [queries.field("query").take(pa.array(q)), values["doc_ids"].take(pa.array(d)), pa.array(scores[d, q])], names=list(names))


def term_queries(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    return queries.select(query_id, F.explode(F.array_distinct(tokenize(F.col(text)))).alias("term"))


class TextIndex:
    """An index under a path, written by `build`."""

    def __init__(self, spark: SparkSession, path: str):
        self.texts = spark.read.parquet(f"{path}/texts")
        self.terms = spark.read.parquet(f"{path}/terms")
        self.blocks = spark.read.parquet(f"{path}/blocks")
        self.size = spark.read.parquet(f"{path}/size")

    def corpus_stats(self) -> DataFrame:
        """Per term: df, with the corpus size on every row (one row, hence the broadcast)."""
        return self.terms.select("term", "df").join(F.broadcast(self.size))

    def scored(self, pairs: DataFrame, terms: DataFrame, query_id: str, doc_id: str) -> DataFrame:
        """Add `bm25` to (query, text) pairs: all terms (query, term, idf) of the query in one expression."""
        per_query = terms.groupBy(query_id).agg(F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("_terms"))

        def add(total: Column, q: Column) -> Column:
            tf = F.get("_tfs", F.array_position("_words", q["term"]).cast("int") - 1)
            weight = let(tf, lambda n: term_weight(q["idf"], n, F.col("_len"), F.col("avg_len")))  # a term is looked up once
            return total + F.coalesce(weight, F.lit(0.0))

        texts = self.texts.select(
            F.col("doc_id").alias(doc_id), F.col("len").alias("_len"), F.col("terms").alias("_words"), F.col("tfs").alias("_tfs"))
        score = F.coalesce(F.aggregate("_terms", F.lit(0.0), add), F.lit(0.0))
        joined = pairs.join(texts, doc_id, "left").join(per_query, query_id, "left").join(F.broadcast(self.size.select("avg_len")))
        return joined.withColumn("bm25", F.round(score, 9)).drop("_terms", "_len", "_words", "_tfs", "avg_len")

    def search(self, queries: DataFrame, k: int, query_id: str, text: str) -> DataFrame:
        """(query, doc_id, bm25, rank): the k best texts that share a term with the query, ties to the smaller id."""
        asked = materialise(term_queries(queries, query_id, text).join(self.terms, "term").select(query_id, "term", "idf", "top", "shards"), "query_terms")
        floors = materialise(self.floors(asked, k, query_id), "floors")
        wanted = self.blocks_to_read(asked, floors, query_id).where("shard = 0").join(self.terms.select("term", "df"), "term")
        sums = wanted.agg(F.sum("df").alias("postings")).join(self.size).first()
        if (sums["postings"] or 0) > sums["n_docs"]:
            return _top(self.scan(asked, floors, k, query_id), k, query_id)
        pairs = materialise(self.in_reach(asked, floors, query_id), "in_reach")
        full = self.scored(pairs.select(query_id, "doc_id"), asked, query_id, "doc_id").where("bm25 > 0")
        return _top(full, k, query_id)

    def scan(self, asked: DataFrame, floors: DataFrame, k: int, query_id: str) -> DataFrame:
        """(query, doc_id, bm25) with all of the k best texts per query: every text against every query, in products."""
        per_query = asked.where(F.col(query_id).isNotNull()).groupBy(query_id).agg(F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("terms"))
        floored = per_query.join(floors, query_id, "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)) - SLACK)
        n = per_query.count()
        blocks = materialise(floored.groupBy(F.pmod(F.hash(query_id), F.lit(-(-n // QUERIES) or 1)).alias("block")).agg(
            F.collect_list(F.struct(F.col(query_id).alias("query"), "floor", "terms")).alias("queries")), "query_blocks")
        kind, asks = (df.schema[c].dataType.simpleString() for df, c in ((self.texts, "doc_id"), (asked, query_id)))
        chunks = self.texts.where("doc_id IS NOT NULL").select("doc_id", "len", "terms", "tfs").mapInArrow(
            _chunks, f"doc_ids array<{kind}>, lens array<bigint>, sizes array<int>, words array<string>, tfs array<bigint>")
        beside = chunks.crossJoin(blocks.join(self.size.select("avg_len")))
        return beside.mapInArrow(partial(_scan, k=k, names=(query_id, "doc_id", "bm25")), f"{query_id} {asks}, doc_id {kind}, bm25 double")

    def floors(self, asked: DataFrame, k: int, query_id: str) -> DataFrame:
        """(query, floor): a score that the k-th best text reaches; queries with fewer texts in view have none."""
        leading = Window.partitionBy(query_id).orderBy(F.col("top").desc(), "term")
        few = asked.withColumn("_n", F.row_number().over(leading)).where(F.col("_n") <= LEADING_TERMS).select(query_id, "term")
        first = self.blocks.where("shard = 0 AND block = 0").join(few, "term").select(query_id, F.inline("postings"))
        partial = first.groupBy(query_id, "doc_id").agg(F.sum("w").alias("bm25"))
        seen = _top(partial, k, query_id).drop("bm25", "rank")
        full = self.scored(seen, asked, query_id, "doc_id")
        return full.groupBy(query_id).agg(F.min("bm25").alias("floor"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).drop("n")

    def blocks_to_read(self, asked: DataFrame, floors: DataFrame, query_id: str) -> DataFrame:
        """(query, term, shard, others, rest): terms to read with what all other terms, and the unread ones, can add."""
        light = Window.partitionBy(query_id).orderBy("top", "term").rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy(query_id)
        floor = F.coalesce("floor", F.lit(0.0)) - SLACK
        told = asked.join(floors, query_id, "left").withColumns({"_up_to": F.sum("top").over(light), "_floor": floor})
        unread = F.col("_up_to") < F.col("_floor")
        told = told.withColumns({
            "others": F.sum("top").over(whole) - F.col("top"), "rest": F.sum(F.when(unread, F.col("top")).otherwise(0.0)).over(whole)})
        read = told.where(~unread)
        return read.select(query_id, "term", "others", "rest", "_floor", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))

    def in_reach(self, asked: DataFrame, floors: DataFrame, query_id: str) -> DataFrame:
        """(query, doc_id, part): texts whose read postings and the bound of the unread terms reach the floor."""
        wanted = self.blocks_to_read(asked, floors, query_id)
        blocks = self.blocks.join(wanted, ["term", "shard"]).where(F.col("top") + F.col("others") >= F.col("_floor"))
        postings = blocks.select(query_id, "rest", "_floor", F.inline("postings"))
        summed = postings.groupBy(query_id, "doc_id", "rest", "_floor").agg(F.sum("w").alias("part"))
        return summed.where(F.col("part") + F.col("rest") >= F.col("_floor")).select(query_id, "doc_id", "part")


def _top(scored: DataFrame, k: int, query_id: str) -> DataFrame:
    order = Window.partitionBy(query_id).orderBy(F.col("bm25").desc(), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def build(docs: DataFrame, path: str, doc_id: str = "doc_id", text: Column | str = "text") -> TextIndex:
    """Write the index of all texts; doc_id must be unique. Null texts are empty."""
    spark = docs.sparkSession
    counted(docs, doc_id, F.col(text) if isinstance(text, str) else text).write.mode("overwrite").parquet(f"{path}/texts")
    texts = spark.read.parquet(f"{path}/texts")
    texts.agg(
        F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n_docs"), F.coalesce(F.avg("len"), F.lit(1.0)).alias("avg_len")
    ).write.mode("overwrite").parquet(f"{path}/size")
    size = F.broadcast(spark.read.parquet(f"{path}/size"))  # one row
    df = materialise(texts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "df")
    told = df.join(size).select(
        "term", "df", idf(F.col("n_docs"), F.col("df")).alias("idf"), F.ceil(F.col("df") / SHARD).cast("int").alias("shards"), "avg_len")
    each = texts.select("doc_id", "len", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select(
        "doc_id", "len", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"))
    weighed = each.join(told, "term").select(
        "term", F.pmod(F.xxhash64("doc_id"), F.col("shards")).cast("int").alias("shard"), "doc_id",
        term_weight(F.col("idf"), F.col("tf"), F.col("len"), F.col("avg_len")).alias("w"))
    falling = Window.partitionBy("term", "shard").orderBy(F.col("w").desc(), "doc_id")
    numbered = weighed.repartition("term", "shard").withColumn("block", F.floor((F.row_number().over(falling) - 1) / BLOCK).cast("int"))
    numbered.groupBy("term", "shard", "block").agg(
        F.max("w").alias("top"), F.collect_list(F.struct("doc_id", "w")).alias("postings")
    ).write.mode("overwrite").parquet(f"{path}/blocks")
    heads = spark.read.parquet(f"{path}/blocks").where("block = 0").groupBy("term").agg(F.max("top").alias("top"))
    told.join(heads, "term").select("term", "df", "idf", "shards", "top").write.mode("overwrite").parquet(f"{path}/terms")
    return TextIndex(spark, path)


def of_hits(index: DataFrame, path: str | None = None) -> TextIndex:
    """The index of the texts that the lexical score sees of an index table's rows."""
    return build(index, path or scratch_path(index.sparkSession, "hit_texts"), "event_id", hit_text())


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Statistics of texts without an index: per term df, with the corpus size on every row."""
    texts = materialise(counted(docs.withColumn("_id", F.lit(0)), "_id", F.col(text)).select("len", "terms"), "counted")
    size = texts.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n_docs"), F.coalesce(F.avg("len"), F.lit(1.0)).alias("avg_len"))
    return texts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(size))


def bm25_topk(
    queries: DataFrame, docs: DataFrame | TextIndex, k: int,
    query_id: str = "item_id", doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """The k best texts per query; `docs` is an index, or a table that is indexed for this call."""
    index = docs if isinstance(docs, TextIndex) else build(docs, scratch_path(docs.sparkSession, "texts"), doc_id, text)
    return index.search(queries, k, query_id, text).withColumnRenamed("doc_id", doc_id)


def score_hits(hits: DataFrame, questions: DataFrame, index: DataFrame | TextIndex) -> DataFrame:
    """Add `bm25` to (question_id, event_id, …) candidates; statistics come from the whole index.

    Only the texts of candidates are read in full; terms weigh what the stored index says.
    """
    texts = index if isinstance(index, TextIndex) else of_hits(index)
    terms = term_queries(questions, "question_id", "question").join(texts.terms.select("term", "idf"), "term")
    return texts.scored(hits, terms, "question_id", "event_id")


def fuse(hits: DataFrame) -> DataFrame:
    """Re-rank (question_id, event_id, rank, bm25) by reciprocal rank fusion.

    Questions with one hit keep it as it is: both its ranks are 1. Ties follow the dense order.
    """
    per_question = Window.partitionBy("question_id")
    by_bm25 = per_question.orderBy(F.col("bm25").desc(), "rank")
    fused = hits.withColumn("bm25_rank", F.row_number().over(by_bm25)).withColumn(
        "rrf_score", 1.0 / (RRF_K + F.col("rank")) + 1.0 / (RRF_K + F.col("bm25_rank"))
    )
    by_rrf = per_question.orderBy(F.round("rrf_score", 12).desc(), "rank")
    return (
        fused.withColumn("_new", F.row_number().over(by_rrf))
        .withColumn("dense_rank", F.col("rank"))
        .withColumn("rank", F.col("_new")).drop("_new")
    )
