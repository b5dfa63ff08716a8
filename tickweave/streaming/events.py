"""Parsing of exchange events; the same functions serve batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.schemas import CANDLE_EVENT, DEPTH_EVENT

DEPTH_LEVELS = 20


def topic_source(spark: SparkSession, servers: str, topic: str, max_per_trigger: int = 100_000, **options: str) -> DataFrame:
    """A Kafka topic from its earliest offset as ``value`` strings (needs Spark's Kafka connector on the class path)."""
    r = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    r = r.option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", max_per_trigger)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "partition", "offset",
                           F.col("timestamp").alias("received"))


def file_source(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Text files with one event per line."""
    r = spark.readStream.format("text")
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.load(path)


#: Columns of a source that say where and when a message stood; they are kept if they are there.
ORIGIN = ("partition", "offset", "received")


def _origin(events: DataFrame) -> list[str]:
    return [c for c in ORIGIN if c in events.columns]


def _parsed(events: DataFrame, value: str, schema: str) -> DataFrame:
    """The fields of a JSON column. Going through ``inline`` keeps later filters from parsing the text again."""
    return events.select(*_origin(events), F.inline(F.array(F.from_json(value, schema))))


def parse_candles(events: DataFrame, value: str = "value") -> DataFrame:
    """Closed candles as bars; other events and open candles are dropped."""
    d = _parsed(events, value, CANDLE_EVENT)
    k = F.col("k")
    ts = F.timestamp_millis(k["t"])
    return d.filter((F.col("e") == "kline") & k["x"]).select(
        k["s"].alias("symbol"), ts.alias("ts"), F.date_format(ts, "yyyy-MM-dd").alias("timestamp"),
        *[k[f].cast("double").alias(n) for f, n in zip("ohlcv", ("open", "high", "low", "close", "volume"), strict=True)], *_origin(events))


def _depth(side: Column) -> Column:
    return F.round(F.aggregate(F.slice(side, 1, DEPTH_LEVELS), F.lit(0.0), lambda a, x: a + x[1].cast("double")), 4)


def parse_depth(events: DataFrame, value: str = "value") -> DataFrame:
    """Depth snapshots with spread, mid price and depth of the first levels; one-sided books are dropped.

    Wrapped events name the symbol in ``stream`` and carry the book in ``data``. The time is the message's own, at its
    root or in ``data``; else the time the source received it; else now.
    """
    received = F.col("received") if "received" in events.columns else F.current_timestamp()
    d = _parsed(events, value, DEPTH_EVENT)
    wrapped = F.col("stream").isNotNull()
    d = d.select(
        F.when(wrapped, F.upper(F.element_at(F.split("stream", "@"), 1))).otherwise(F.coalesce("s", F.lit("UNKNOWN"))).alias("symbol"),
        F.coalesce(F.timestamp_millis(F.coalesce("E", "data.E")), received).alias("ts"), F.when(wrapped, F.col("data.bids")).otherwise(F.col("bids")).alias("bids"),
        F.when(wrapped, F.col("data.asks")).otherwise(F.col("asks")).alias("asks"),
    ).filter((F.size("bids") > 0) & (F.size("asks") > 0))
    bid, ask = F.get(F.get("bids", F.lit(0)), F.lit(0)).cast("double"), F.get(F.get("asks", F.lit(0)), F.lit(0)).cast("double")
    return d.select(
        "symbol", "ts", F.round(ask - bid, 8).alias("spread"), F.round((bid + ask) / 2, 8).alias("mid_price"),
        _depth(F.col("bids")).alias("bid_depth"), _depth(F.col("asks")).alias("ask_depth"),
        F.coalesce(bid, F.lit(0.0)).alias("best_bid"), F.coalesce(ask, F.lit(0.0)).alias("best_ask"))
