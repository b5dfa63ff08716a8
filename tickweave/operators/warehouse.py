"""Star-schema marts and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import asset_class, calendar
from ..timeline import number_rows, trailing


def dedupe(bars: DataFrame) -> DataFrame:
    """One row per (symbol, ts): the smallest by all values, folded with map-side partials."""
    values = [c for c in bars.columns if c not in ("symbol", "ts")]
    return bars.groupBy("symbol", "ts").agg(F.min(F.struct(*values)).alias("_v")).select("symbol", "ts", "_v.*")


def date_spine(bars: DataFrame) -> DataFrame:
    """Every day from the first to the last bar."""
    span = bars.agg(F.min(F.to_date("ts")).alias("lo"), F.max(F.to_date("ts")).alias("hi"))
    return span.select(F.explode(F.expr("sequence(lo, hi, INTERVAL 1 DAY)")).alias("date"))


def dim_date(bars: DataFrame) -> DataFrame:
    d = date_spine(bars)
    return d.select("date", *[c.alias(n) for n, c in calendar("date").items()])


def dim_date_ids(bars: DataFrame) -> DataFrame:
    """Distinct times with ids in time order."""
    return number_rows(bars.select("ts").distinct(), key=(), out="date_id")


def dim_symbol(bars: DataFrame) -> DataFrame:
    return symbol_span(bars).withColumn("asset_class", asset_class("symbol"))


def symbol_span(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_rows")
    )


def symbol_summary(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.avg("close").alias("avg_close"), F.min("close").alias("min_close"), F.max("close").alias("max_close"),
        F.avg("volume").alias("avg_volume"),
    )


def dataset_summary(bars: DataFrame) -> DataFrame:
    """Totals over all bars; symbols are counted after a per-symbol fold."""
    per = bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.sum("volume").alias("v")
    )
    return per.agg(
        F.count(F.lit(1)).alias("n_symbols"), F.sum("n").alias("n_rows"), F.min("lo").alias("first_ts"),
        F.max("hi").alias("last_ts"), F.sum("v").alias("total_volume"),
    )


def volume_analysis(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(
        F.sum("volume").alias("total_volume"), F.avg("volume").alias("avg_volume"), F.max("volume").alias("max_volume"),
        F.min("volume").alias("min_volume"), F.count(F.lit(1)).alias("n_rows"),
        F.try_divide(F.sum(F.col("close") * F.col("volume")), F.sum("volume")).alias("vwap"),
    )


def price_ranking(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.avg("close").alias("avg_close"), F.count(F.lit(1)).alias("n_rows"))


def top_by_price(bars: DataFrame, dim: DataFrame, k: int = 10) -> DataFrame:
    """Facts are folded per symbol before the dimension join."""
    per = bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("close").alias("avg_close"), F.max("high").alias("max_high")
    )
    return per.join(dim, "symbol").orderBy(F.col("avg_close").desc(), "symbol").limit(k)


def index_stats(daily: DataFrame) -> DataFrame:
    return daily.groupBy("index_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.min("close").alias("min_close"), F.max("close").alias("max_close"), F.avg("close").alias("avg_close"),
        F.stddev_samp("close").alias("std_close"),
    )


def previous_close(bars: DataFrame, key: tuple[str, ...] = ("symbol",)) -> DataFrame:
    numbered = bars if "pos" in bars.columns else number_rows(bars, key=key)
    return trailing(numbered, 1, lambda w: {"prev_close": F.lag("close").over(w)}, key=key)


def stat_card(bars: DataFrame) -> DataFrame:
    """Price range, standard deviation of percent changes and total return per symbol."""
    d = previous_close(bars)
    change = F.when(F.col("prev_close").isNotNull(), F.try_divide("close", "prev_close") - 1)
    return d.groupBy("symbol").agg(
        F.min("close").alias("min_close"), F.max("close").alias("max_close"), F.avg("close").alias("avg_close"),
        F.stddev_samp(change).alias("std_change"),
        (F.try_divide(F.max_by("close", "pos"), F.min_by("close", "pos")) - 1).alias("total_return"),
    )


def volume_metrics(bars: DataFrame, now: str) -> DataFrame:
    """Row counts, time span and hours since the newest bar, per symbol."""
    moment = F.unix_micros(F.lit(now).cast("timestamp"))
    out = symbol_span(bars)
    age = (moment - F.unix_micros(F.col("last_ts").cast("timestamp"))) / 3_600_000_000
    return out.withColumn("freshness_hours", F.round(age, 2))
