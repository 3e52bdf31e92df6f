"""Session settings the jobs expect, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def tune(spark: SparkSession) -> SparkSession:
    """Settings that only affect planning: UTC clock readings, adaptive execution."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # Text work is bound by the processor: keep small shuffles on several cores. Has no effect
    # once a partition holds more than this.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    return spark


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# Scratch folder of local sessions that name none, by application.
_LOCAL_SCRATCH: dict[str, str] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the folder that the cluster names in spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _LOCAL_SCRATCH.setdefault(app, "") or tempfile.mkdtemp(prefix="millrace-")
        _LOCAL_SCRATCH[app] = base
    return f"{base.rstrip('/')}/millrace/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and fixes row placement that would
    otherwise be sampled anew for every consumer of a range repartitioning.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
