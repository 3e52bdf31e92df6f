"""Registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import digest_index, embed_dedup, html_blocks, line_dedup, mixing, ngram_join, packing, periods, quality, spelling, substring, token_counts, topk
from millrace.llm.common import WORD, table
from millrace.llm.mixing import let

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
CONTEXT_TOKENS = 2048
#: Weights of sources in code point order, repeating.
WEIGHTS = (5, 2, 1)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.with_token_counts(docs, TOKENIZER)
    return counted.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens", (F.col("n_tokens") > CONTEXT_TOKENS).alias("over_limit"),
    )


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenised(table(spark, sf_dir, "documents"), TOKENIZER, CONTEXT_TOKENS)
    return packing.packed(pieces, CONTEXT_TOKENS).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


@query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality.document_statistics(table(spark, sf_dir, "documents"))
    model = quality.fit(stats, table(spark, sf_dir, "labels"))
    return quality.scored(stats, model).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op4_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mixed(mixing.sizes_of(docs), WEIGHTS).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, drop_emptied=False).select("doc_id", "removed_lines", "text")


#: Rows of op8: lines, every two in a row that are not both blank, and the lines of those that stood so earlier.
LINE_DEDUP_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
), pairs AS (
  SELECT doc_id, i, line, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM lines
), ranked AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY line, after ORDER BY doc_id, i) AS k
  FROM pairs WHERE after IS NOT NULL AND NOT (trim(line, ' ') = '' AND trim(after, ' ') = '')
), gone AS (
  SELECT DISTINCT doc_id, unnest([i, i + 1]) AS i FROM ranked WHERE k > 1
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS text
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i WHERE g.i IS NULL GROUP BY l.doc_id
), lost AS (
  SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT d.doc_id, coalesce(lost.n, 0)::BIGINT AS removed_lines,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM documents d LEFT JOIN kept ON d.doc_id = kept.doc_id LEFT JOIN lost ON d.doc_id = lost.doc_id
"""
ORACLE_SQL["op8_line_dedup"] = LINE_DEDUP_SQL


@query
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return ngram_join.join(docs).withColumnRenamed("id", "doc_id")


@query
def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


#: Rows of op6: all pairs, in double precision, and the ids each reaches over links.
EMBED_DEDUP_SQL = """
WITH RECURSIVE able AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM able a JOIN able b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.9
), reach AS (
  SELECT vec_id AS u, vec_id AS r FROM embeddings
  UNION SELECT l.v, reach.r FROM reach JOIN links l ON reach.u = l.u
), components AS (
  SELECT u, min(r) AS component_id FROM reach GROUP BY u
), counts AS (
  SELECT u, count(*) AS n FROM links GROUP BY u
)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN components c ON e.vec_id = c.u LEFT JOIN counts ON e.vec_id = counts.u
"""
ORACLE_SQL["op6_embedding_near_dedup"] = EMBED_DEDUP_SQL


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


#: Rows of op2: every query with every other vector, ranked.
TOPK_SQL = """
WITH able AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM able q JOIN able c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
ORACLE_SQL["op2_exact_topk"] = TOPK_SQL


@query
def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    extracted = html_blocks.main_text(pages, html_blocks.fit(pages))
    return extracted.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest_index.dedup(docs, digest_index.DigestIndex.create(spark)).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


#: Rows of op11: groups of equal normalised texts.
EXACT_DEDUP_SQL = r"""
WITH normal AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM normal WINDOW g AS (PARTITION BY text_sha256)
"""
ORACLE_SQL["op11_exact_dedup"] = EXACT_DEDUP_SQL


def spelled_words(docs: DataFrame) -> DataFrame:
    """(word): one row per run of letters of (doc_id, text); runs whose checksum 97 divides lose a letter, as the contract says."""
    runs = docs.select("doc_id", F.explode(spelling.letter_runs(F.col("text"))).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    shorter = F.expr("concat(left(run, cast(h % char_length(run) as int)), substr(run, cast(h % char_length(run) as int) + 2))")
    return runs.withColumn("h", h).select(F.when(F.col("h") % 97 == 0, shorter).otherwise(F.col("run")).alias("word"))


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.variants(spelling.vocabulary(spelled_words(docs)))


def periodic_text(doc_id: Column, text: Column) -> Column:
    """The texts of op12: of every tenth document by checksum, the words from one on repeat with a period."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    h = F.crc32(doc_id.cast("string"))

    def repeated(s: Column) -> Column:
        a = (s["g"] % s["n"]).cast("int")
        p = (1 + F.floor((s["n"] - a) / (3 + s["g"] % 8))).cast("int")
        whole = F.transform(F.sequence(F.lit(0), s["n"] - 1), lambda i: F.get(s["words"], F.when(i < a, i).otherwise(a + (i - a) % p)))
        return F.array_join(whole, " ")

    changed = let(words, lambda w: F.when(F.size(w) > 0, let(
        F.struct(w.alias("words"), F.size(w).alias("n"), F.floor(h / 10).alias("g")), repeated)).otherwise(text))
    return F.when(h % 10 == 0, changed).otherwise(text)


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), periodic_text(F.col("doc_id"), F.col("text")).alias("text"))
    best = periods.longest(F.col("runs"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return periods.with_runs(docs).withColumn("best", best).select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), "collapsed_sha256",
    )
