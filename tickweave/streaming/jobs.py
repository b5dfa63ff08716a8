"""Streaming jobs: upsert into the bar lake, appended depth snapshots, deduplication, bars closed by watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.bars import tick_order
from ..sources import schemas

PARTITIONS = ("symbol", "year", "month")


#: Tasks that may write one symbol's month.
SPLIT = 8


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def append_new_bars(batch: DataFrame, path: str) -> None:
    """Append the bars of a batch that the lake does not hold yet; stored bars win.

    Of several bars of one symbol and time in a batch the one with the smallest (partition, offset) counts, where the
    source has them; else the one whose values come first in order, so that a retry picks the same. The months of a batch
    (no more than its rows) are named as literals, so only their partitions are listed and read, and a batch costs what it
    brings, whatever the size of the lake. Repeating a batch adds nothing.
    """
    spark = batch.sparkSession
    values = ["open", "high", "low", "close", "volume"]
    rank = F.struct(*(c for c in ("partition", "offset") if c in batch.columns), *values)
    fresh = batch.groupBy("symbol", "ts").agg(F.min_by(F.struct(*values), rank).alias("b")).select("symbol", "ts", "b.*")
    fresh = fresh.withColumn("year", F.year("ts")).withColumn("month", F.month("ts"))
    months = fresh.select(*PARTITIONS).distinct().collect()
    if not months:
        return
    if _exists(spark, path):
        lake = spark.read.schema(f"{schemas.BARS}, symbol STRING, year INT, month INT").parquet(path)
        touched = F.lit(False)
        by_month: dict[tuple[int, int], list[str]] = {}
        for r in months:
            by_month.setdefault((r["year"], r["month"]), []).append(r["symbol"])
        for (year, month), symbols in sorted(by_month.items()):
            touched = touched | ((F.col("year") == year) & (F.col("month") == month) & F.col("symbol").isin(symbols))
        fresh = fresh.join(lake.filter(touched).select("symbol", "ts"), ["symbol", "ts"], "left_anti")
    split = F.pmod(F.xxhash64("ts"), F.lit(SPLIT))
    fresh.repartition(*PARTITIONS, split).write.mode("append").partitionBy(*PARTITIONS).parquet(path)


def upsert_bars(bars: DataFrame, path: str, checkpoint: str, every: str | None = "60 seconds") -> StreamingQuery:
    """Micro-batch upsert; without ``every`` the stream is drained and stops."""
    w = bars.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda b, _: append_new_bars(b, path))
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def append_stream(df: DataFrame, path: str, checkpoint: str, every: str | None = "60 seconds") -> StreamingQuery:
    """Append rows as parquet, exactly once by the sink's log."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def deduplicated(bars: DataFrame, delay: str = "1 day") -> DataFrame:
    """First event per (symbol, ts); keys are forgotten once the watermark has passed them."""
    return bars.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["symbol", "ts"])


def windowed_bars(ticks: DataFrame, every: str, delay: str) -> DataFrame:
    """Bars per tumbling window from ticks (symbol, ts, price, tie), closed when the watermark passes.

    A row without a symbol makes no bar but moves the watermark: ``end_of_ticks`` makes one that closes all windows.
    """
    t = ticks.withColumn("_o", tick_order("ts", "tie")).withWatermark("ts", delay)
    return t.groupBy("symbol", F.window("ts", every).alias("w")).agg(
        F.min_by("price", "_o").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "_o").alias("close"), F.count(F.lit(1)).cast("double").alias("volume"),
        F.count("symbol").alias("_n"),  # a filter on the key would be pushed below the watermark
    ).filter("_n > 0").select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def end_of_ticks(ticks: DataFrame, ts: str, every: str, delay: str) -> DataFrame:
    """One row with the columns of ticks, all null but for a time by which every window is closed: what a stopped stream is sent last."""
    last = ticks.agg(F.max(ts).alias("_last"))
    at = F.col("_last") + F.expr(f"INTERVAL {every}") * 2 + F.expr(f"INTERVAL {delay}")
    return last.select(*(at.cast(t).alias(c) if c == ts else F.lit(None).cast(t).alias(c) for c, t in ticks.dtypes))


def drain(query: StreamingQuery) -> None:
    """Wait until a drained stream has written everything, and pass on its failure if it has one."""
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def read_result(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
