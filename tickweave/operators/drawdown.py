"""Running drawdowns of value curves and the periods below the peak."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..timeline import running


def drawdown(curve: DataFrame, value: str = "close", key: str = "symbol") -> DataFrame:
    d = running(curve, {"peak": ("max", F.col(value))}, key=(key,))
    return d.withColumn("drawdown", F.round(F.when(F.col("peak") > 0, (F.col(value) - F.col("peak")) / F.col("peak")).otherwise(0.0), 8))


def drawdown_periods(dd: DataFrame, key: str = "symbol") -> DataFrame:
    """One row per stretch below the peak.

    Each row at the peak opens an island that also holds the rows below it until the next peak, and it ends
    the island before. So a peak row is sent to both islands, and everything about a stretch is one hash
    aggregation by (key, island). Indexes count from 0.
    """
    d = running(dd, {"island": ("sum", F.when(F.col("drawdown") < 0, 0).otherwise(1))}, key=(key,))
    below = F.col("drawdown") < 0
    home = F.struct(F.col("island").alias("island"), F.lit(False).alias("ends"))
    previous = F.struct((F.col("island") - 1).alias("island"), F.lit(True).alias("ends"))
    d = d.select(key, "ts", (F.col("pos") - 1).alias("idx"), "drawdown",
                 F.explode(F.when(below, F.array(home)).otherwise(F.array(home, previous))).alias("_i"))
    d = d.select(key, "ts", "idx", "drawdown", "_i.island", "_i.ends")
    # depth, then position, as one number: drawdowns have 8 places
    depth = (F.round(F.col("drawdown") * 1e8).cast("decimal(12,0)") * F.lit(Decimal(10**19)) + F.col("idx").cast("decimal(19,0)")).cast("decimal(38,0)")

    def inside(column: str):
        return F.when(below, F.col(column))

    def end(column: str):
        return F.max(F.when(F.col("ends"), F.col(column)))

    out = d.groupBy(key, "island").agg(
        F.min(inside("idx")).alias("start_idx"), F.max(inside("idx")).alias("end_idx"),
        F.min_by("idx", F.when(below, depth)).alias("trough_idx"),
        F.min(inside("ts")).alias("start_ts"), F.max(inside("ts")).alias("end_ts"),
        F.min_by("ts", F.when(below, depth)).alias("trough_ts"), F.min("drawdown").alias("max_drawdown"),
        end("idx").alias("recovery_idx"), end("ts").alias("recovery_ts"),
    ).filter("start_idx is not null")
    return out.select(
        key, "start_idx", "end_idx", "trough_idx", "start_ts", "end_ts", "trough_ts", "max_drawdown",
        (F.col("end_idx") - F.col("start_idx") + 1).alias("duration"), F.col("recovery_idx").isNotNull().alias("recovered"),
        "recovery_idx", (F.col("recovery_idx") - F.col("trough_idx")).alias("recovery_duration"), "recovery_ts")


def drawdown_summary(dd: DataFrame, key: str = "symbol") -> DataFrame:
    periods = drawdown_periods(dd, key).groupBy(key).agg(F.count(F.lit(1)).alias("n_periods"), F.max("duration").alias("longest_duration"))
    below = F.col("drawdown") < 0
    rows = dd.groupBy(key).agg(
        F.min("drawdown").alias("max_drawdown"), F.coalesce(F.avg(F.when(below, F.col("drawdown"))), F.lit(0.0)).alias("avg_drawdown"),
        F.max_by("drawdown", "pos").alias("current_drawdown"),
        (F.count_if(below) / F.count(F.lit(1))).alias("time_in_drawdown"))
    return rows.join(periods, key, "left").na.fill(0, ["n_periods", "longest_duration"])
