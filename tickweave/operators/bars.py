"""From ticks and exchange records to bars."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket_start(ts: str, bucket: str) -> Column:
    """Start of the calendar bucket (minute, hour, day, week, month, '6 hours')."""
    if bucket == "6 hours":
        t = F.col(ts)
        six = F.floor(F.hour(t) / 6) * 6
        return (F.date_trunc("day", t) + F.make_dt_interval(F.lit(0), six.cast("int"))).cast("timestamp_ntz")
    return F.date_trunc(bucket, F.col(ts)).cast("timestamp_ntz")


def tick_order(ts: str, tie: str) -> Column:
    """Time, then ``tie``, as one decimal: a fixed-width buffer that keeps min_by/max_by in hash aggregation."""
    micros = F.unix_micros(F.col(ts).cast("timestamp")).cast("decimal(17,0)")
    return (micros * F.lit(Decimal(10**19)) + F.col(tie).cast("decimal(19,0)")).cast("decimal(38,0)")


def build_bars(
    ticks: DataFrame, *, symbol: str, ts: str, price: str, bucket: str, tie: str, volume: Column | None = None
) -> DataFrame:
    """Open/high/low/close/volume per symbol and bucket; without ``volume`` ticks are counted.

    One hash aggregation with map-side partials: a hot symbol shrinks to its buckets before the shuffle.
    """
    t = ticks.select(
        F.col(symbol).alias("symbol"), bucket_start(ts, bucket).alias("ts"), F.col(price).alias("_p"),
        tick_order(ts, tie).alias("_o"), (F.lit(1.0) if volume is None else volume).alias("_v"),
    )
    return t.groupBy("symbol", "ts").agg(
        F.min_by("_p", "_o").alias("open"), F.max("_p").alias("high"), F.min("_p").alias("low"),
        F.max_by("_p", "_o").alias("close"), F.sum("_v").alias("volume"),
    )


def parse_candle_array(df: DataFrame, json: str = "payload", daily: bool = True) -> DataFrame:
    """Positional candle arrays ``[openMs, o, h, l, c, v, closeMs]`` to bars with an ISO time string."""
    a = F.from_json(F.col(json), "array<string>")
    ts = F.timestamp_millis(F.get(a, F.lit(0)).cast("bigint"))
    fmt = "yyyy-MM-dd" if daily else "yyyy-MM-dd'T'HH:mm:ss"
    return df.select(
        "symbol", F.date_format(ts, fmt).alias("timestamp"),
        *[F.get(a, F.lit(i)).cast("double").alias(n)
          for i, n in enumerate(("open", "high", "low", "close", "volume"), 1)],
    )


def ticker_snapshot(df: DataFrame, symbols: list[str], json: str = "payload") -> DataFrame:
    """Latest ticker per requested symbol with percent change over the previous price."""
    fields = "symbol STRING, last STRING, prev STRING, high STRING, low STRING, vol STRING"
    rows = df.select("ts", F.inline(F.array(F.from_json(json, fields)))).filter(F.col("symbol").isin(*symbols))
    newest = rows.groupBy("symbol").agg(*[
        F.max_by(F.col(f).cast("double"), "ts").alias(n)
        for f, n in (("last", "price"), ("prev", "_prev"), ("high", "high"), ("low", "low"), ("vol", "volume"))])
    prev = F.col("_prev")
    change = F.when(prev > 0, F.round((F.col("price") / prev - 1) * 100, 2)).otherwise(F.lit(0.0))
    return newest.select("symbol", "price", change.alias("change_pct"), "high", "low", "volume")
