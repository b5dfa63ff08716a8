"""Bars that late ticks restate: partial bars that can be merged, a correction branch beside the watermark, compaction.

A partial bar of (symbol, window) holds high, low, volume, and open and close with the order of their ticks, so any number of
them merge to the bar of all their ticks. Each micro-batch folds its ticks to partial bars and writes them under its batch number, which
it replaces if it is run again: every tick counts once. The watermark, the latest tick so far less ``delay``, is kept beside them. Partial bars
of windows the watermark had closed before the batch go to ``corrections``, others to ``parts``; so a late tick is neither dropped nor does it hold
windows open. `bars` merges what is there, `compacted` replaces the partial bars of many batches by one file set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.bars import tick_order
from .jobs import _exists

PART = ("symbol STRING, ts TIMESTAMP, open STRUCT<at: DECIMAL(38,0), price: DOUBLE>, close STRUCT<at: DECIMAL(38,0), price: DOUBLE>, "
        "high DOUBLE, low DOUBLE, volume DOUBLE, kind STRING, batch BIGINT")
PROGRESS = "mark TIMESTAMP, latest TIMESTAMP, batch BIGINT"
KINDS = ("parts", "corrections")


def partial_bars(ticks: DataFrame, every: str) -> DataFrame:
    """Ticks (symbol, ts, price, tie) as partial bars of tumbling windows; rows without symbol or time are left out."""
    at = tick_order("ts", "tie").cast("decimal(38,0)")
    t = ticks.where(F.col("symbol").isNotNull() & F.col("ts").isNotNull()).withColumn("at", at)
    return merged(t.select("symbol", F.window("ts", every)["start"].alias("ts"), F.struct("at", "price").alias("open"), F.struct("at", "price").alias("close"),
                           F.col("price").alias("high"), F.col("price").alias("low"), F.lit(1.0).alias("volume")))


def merged(parts: DataFrame, *more: Column) -> DataFrame:
    """One partial bar for each symbol and window; fixed-width states are folded in each task first."""
    return parts.groupBy("symbol", "ts").agg(
        F.min_by("open", "open.at").alias("open"), F.max_by("close", "close.at").alias("close"), F.max("high").alias("high"),
        F.min("low").alias("low"), F.sum("volume").alias("volume"), *more)


def _progress(spark: SparkSession, path: str, before: int) -> tuple | None:
    """The row of the last batch before this one."""
    if not _exists(spark, f"{path}/progress"):
        return None
    rows = spark.read.schema(PROGRESS).parquet(f"{path}/progress").where(F.col("batch") < before)
    return rows.agg(F.max(F.struct("batch", "mark", "latest")).alias("r")).first()["r"]


def write_batch(ticks: DataFrame, number: int, path: str, every: str, delay: str) -> None:
    """The partial bars of one micro-batch, replacing those of an earlier try; what is read of the progress is one row a batch."""
    spark = ticks.sparkSession
    done = _progress(spark, path, number)
    mark, latest = (done["mark"], done["latest"]) if done else (None, None)
    closed = F.col("ts") + F.expr(f"INTERVAL {every}") <= F.lit(mark).cast("timestamp")
    bars = partial_bars(ticks, every).withColumn("kind", F.when(closed, "corrections").otherwise("parts"))
    for kind in KINDS:
        bars.where(F.col("kind") == kind).drop("kind").write.mode("overwrite").parquet(f"{path}/{kind}/batch={number}")
    last = ticks.agg(F.max("ts").cast("timestamp").alias("t")).select(F.greatest("t", F.lit(latest).cast("timestamp")).alias("latest"))
    last.select((F.col("latest") - F.expr(f"INTERVAL {delay}")).alias("mark"), "latest").coalesce(1).write.mode("overwrite").parquet(f"{path}/progress/batch={number}")


def restated_bars(ticks: DataFrame, path: str, checkpoint: str, every: str, delay: str, trigger: str | None = "60 seconds") -> StreamingQuery:
    """A stream of ticks to partial bars; without ``trigger`` it is drained and stops."""
    w = ticks.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda b, i: write_batch(b, i, path, every, delay))
    return (w.trigger(processingTime=trigger) if trigger else w.trigger(availableNow=True)).start()


def _base(spark: SparkSession, path: str) -> int | None:
    """The last batch that the newest complete compaction holds."""
    if not _exists(spark, f"{path}/base"):
        return None
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/base")
    fs = fs_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = [f.getPath() for f in fs.listStatus(fs_path)]
    done = [int(p.getName().split("=")[1]) for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return max(done, default=None)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """All partial bars with ``kind`` and ``batch``: the newest compaction and the batches after it."""
    base = _base(spark, path)
    out = spark.createDataFrame([], PART)
    if base is not None:
        schema = PART.replace(", batch BIGINT", "")
        out = out.unionByName(spark.read.schema(schema).parquet(f"{path}/base/upto={base}").withColumn("batch", F.lit(base).cast("bigint")))
    for kind in KINDS:
        if _exists(spark, f"{path}/{kind}"):
            rows = spark.read.schema(PART.replace(", kind STRING", "")).parquet(f"{path}/{kind}").withColumn("kind", F.lit(kind))
            out = out.unionByName(rows.where(F.col("batch") > (base if base is not None else -1)))
    return out


def bars(spark: SparkSession, path: str, closed: str | None = None) -> DataFrame:
    """The bars as all ticks so far have them: symbol, ts, open, high, low, close, volume, and ``corrected``, the ticks that came after closing.

    closed: the length of a window; windows the watermark has not closed yet are then left out.
    """
    late = F.sum(F.when(F.col("kind") == "corrections", F.col("volume")).otherwise(0.0)).alias("corrected")
    d = merged(stored(spark, path), late)
    if closed:
        done = _progress(spark, path, 1 << 62)
        d = d.where(F.col("ts") + F.expr(f"INTERVAL {closed}") <= F.lit(done["mark"] if done else None).cast("timestamp"))
    return d.select("symbol", "ts", F.col("open.price").alias("open"), "high", "low", F.col("close.price").alias("close"), "volume", "corrected")


def compacted(spark: SparkSession, path: str) -> int | None:
    """Merge the partial bars of all batches so far into one file set, which readers take as soon as it is complete.

    Batches are kept: they are no longer read, and dropping them is left to the retention of the folder. Gives the last batch it holds.
    """
    last = _progress(spark, path, 1 << 62)
    if last is None:
        return None
    rows = stored(spark, path)
    upto = int(last["batch"])
    both = [merged(rows.where((F.col("kind") == k) & (F.col("batch") <= upto))).withColumn("kind", F.lit(k)) for k in KINDS]
    both[0].unionByName(both[1]).write.mode("overwrite").parquet(f"{path}/base/upto={upto}")
    return upto
