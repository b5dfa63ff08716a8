"""Session settings, and the shared folder that jobs may write to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tickweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and naive UTC time.

    Sizes that depend on the cluster (shuffle partitions, executor memory) are left to the caller: AQE
    coalesces small shuffles and splits skewed join partitions at run time.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables, on the storage the cluster names in spark.checkpoint.dir.

    Only a local master may go without: it gets a temporary folder. Elsewhere every executor would write to its own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tickweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def reuse(df: DataFrame) -> DataFrame:
    """Keep a frame that one plan reads several times; lost blocks are recomputed from lineage."""
    return df if df.storageLevel.useMemory else df.persist(StorageLevel.MEMORY_AND_DISK)
