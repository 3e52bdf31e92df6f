"""Exact dedup against a persistent index of text digests.

The index is a table of (digest, batch, keep), bucketed and sorted by digest: one row per different text ever seen,
with the place of the row that stays. A batch of rows is folded to one row per digest before anything is shuffled,
dealt to the index's buckets, and merge-joined (anti join) with the index, whose side is read bucket by bucket
without an exchange. What is not known yet is appended as one more sorted file per bucket. Texts are never shuffled.

Defined cases. Null texts count as empty. Of equal texts of one batch the row with the smallest id stays, null ids
last; of rows equal in id and text too, one stays. Against earlier batches the row that came first stays, so batches
in id order give the smallest id overall. Texts of any length are digested whole. An empty table gives an empty
result. Digests are SHA-256 of the normalised text. Clashing column names: only the id and text columns are read.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import materialise
from millrace.session import scratch_path, shuffle_partitions

SPACE = r"[\x20\x09-\x0D]+"
_SCHEMA = "digest BINARY, batch INT, keep STRUCT<none: BOOLEAN, id: BIGINT, run: BIGINT, row: BIGINT>"


def digest(text: Column) -> Column:
    """SHA-256 (binary) of a text with runs of white space as one space; null as of the empty text."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "), 256))


def digested(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(run, row, id, digest) of all rows, stored: `row` numbers the rows of this run for good; texts are not needed any more."""
    run = uuid.uuid4().int >> 65
    return materialise(docs.select(
        F.lit(run).cast("long").alias("run"), F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("id"), digest(F.col(text)).alias("digest"),
    ), "digested")


def _place() -> Column:
    return F.struct(F.col("id").isNull().alias("none"), *[F.col(c).alias(c) for c in ("id", "run", "row")])


@dataclass
class DigestIndex:
    """A bucketed table under `path`; `open` finds one that another application wrote."""

    spark: SparkSession
    path: str
    buckets: int
    name: str

    @classmethod
    def create(cls, spark: SparkSession, path: str | None = None, buckets: int | None = None) -> DigestIndex:
        """An empty index; by default of as many buckets as the session's shuffles have partitions."""
        buckets = buckets or shuffle_partitions(spark)
        path = path or scratch_path(spark, "digest_index")
        spark.createDataFrame([(json.dumps({"buckets": buckets}),)], "value string").coalesce(1).write.text(f"{path}/meta")
        return cls._register(spark, path, buckets)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> DigestIndex:
        meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
        return cls._register(spark, path, meta["buckets"])

    @classmethod
    def _register(cls, spark: SparkSession, path: str, buckets: int) -> DigestIndex:
        name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {name} ({_SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) "
            f"INTO {buckets} BUCKETS LOCATION '{path}/rows'"
        )
        return cls(spark, path, buckets, name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def unknown(self, rows: DataFrame, batch: int) -> DataFrame:
        """(digest, keep): one row per digest of (run, row, id, digest) that no earlier batch has, in the index's buckets."""
        first = rows.groupBy("digest").agg(F.min(_place()).alias("keep")).repartition(self.buckets, "digest")
        known = self.rows().where(F.col("batch") < batch).select("digest")
        return first.join(known.hint("merge"), "digest", "left_anti")

    def append(self, rows: DataFrame, batch: int) -> None:
        """Adds what is new; a batch that is there already (a job that is run again) is left alone."""
        if self.rows().where(F.col("batch") == batch).limit(1).count():
            return
        new = self.unknown(rows, batch).select("digest", F.lit(batch).alias("batch"), "keep")
        (
            new.write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest")
            .option("path", f"{self.path}/rows").saveAsTable(self.name)
        )

    def lookup(self, rows: DataFrame) -> DataFrame:
        """`rows` with keep_id, kept, group_size (of the given rows).

        Groups are counted before they meet the index, and stored: the join back to the rows then has a plain
        exchange on both sides, whose hot partitions adaptive execution splits.
        """
        sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size")).repartition(self.buckets, "digest")
        groups = materialise(sizes.join(self.rows().select("digest", "keep").hint("merge"), "digest"), "digest_groups")
        kept = (F.col("keep.run") == F.col("run")) & (F.col("keep.row") == F.col("row"))
        return rows.join(groups, "digest").select("id", "row", "digest", F.col("keep.id").alias("keep_id"), kept.alias("kept"), "group_size")


def parted(rows: DataFrame, batches: int) -> list[DataFrame]:
    """Rows in `batches` parts by ascending id, null ids in the last; equal ids stay together."""
    shares = [k / batches for k in range(1, batches)]
    edges = rows.agg(F.percentile_approx("id", shares).alias("e")).first()["e"] if shares else None
    if not edges:
        return [rows]
    edges = sorted(set(edges))
    at = F.lit(0)
    for e in edges:
        at = at + (F.coalesce(F.col("id") > e, F.lit(True))).cast("int")
    return [rows.where(at == k) for k in range(len(edges) + 1)]


def dedup(docs: DataFrame, index: DigestIndex, batches: int = 2) -> DataFrame:
    """(id, row, digest, keep_id, kept, group_size) of all rows: they join a new index batch by batch, in id order."""
    rows = digested(docs)
    for number, part in enumerate(parted(rows, batches)):
        index.append(part, number)
    return index.lookup(rows)
