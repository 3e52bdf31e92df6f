"""A corpus pipeline over `documents`: good texts, without repeated lines and near copies, mixed and packed.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All but the last return the columns of `docs`. Null texts count as empty; documents without
words pass the stages that compare texts; repeated rows are copies of one another. An empty table passes through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import line_dedup, mixing, ngram_join, packing, quality
from millrace.llm.common import fresh, materialise, table
from millrace.llm.queries import CONTEXT_TOKENS, TOKENIZER, WEIGHTS

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, learned from `labels` of the documents at hand."""
    model = quality.fit(quality.document_statistics(docs), table(spark, sf_dir, "labels"))
    return quality.good_documents(docs, model)


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without line chunks that came before; those that lose every line go. n_chars follows the text."""
    out = line_dedup.dedup_lines(docs).select(*docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out


def near_copy_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts: the one with the smallest doc_id, null ids last."""
    (row,) = fresh(docs, "row")
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    linked = ngram_join.join(numbered.select(F.col(row).alias("id"), "text"))
    ids = numbered.select(F.col(row).alias("id"), "doc_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id"))
    stays = linked.join(ids, "id").groupBy("class_id").agg(first.alias("first")).select(F.col("first.id").alias(row))
    return numbered.join(stays, row, "left_semi").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it."""
    return mixing.mix(docs, WEIGHTS)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences and places."""
    pieces = packing.tokenised(docs, TOKENIZER, CONTEXT_TOKENS)
    return packing.packed(pieces, CONTEXT_TOKENS).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


STAGES: tuple[tuple[str, Stage], ...] = (
    ("quality classifier", quality_filter),
    ("line dedup", line_filter),
    ("n-gram Jaccard join", near_copy_filter),
    ("mixing sources to target weights", mixture),
    ("best-fit packing", packed_sequences),
)

#: The classifier, the signatures, the random rounding and the tokenizer have no SQL; tests hold the rows
#: against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each one's rows stored before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
