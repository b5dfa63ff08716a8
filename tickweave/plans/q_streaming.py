"""Queries: event parsing and streaming jobs, run over event files until they are drained."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources.writers import write_bars
from ..streaming import buffer as B
from ..streaming import events as V
from ..streaming import jobs as J
from ..streaming import restate as R
from . import panels as P
from .oracle import sql
from .registry import query


#: Rows of a file that a query sends to its stream; more rows make more files.
ROWS = 50_000


def _ms(c="ts"):
    return F.unix_millis(F.col(c).cast("timestamp"))


def _files(df, least):
    """Files for the rows of a frame, so that no task writes more than ROWS of them; an even number, half of them a batch."""
    return max(least, 2 * -(-df.count() // (2 * ROWS)))


def candle_events(df):
    """Bars (symbol, ts, open .. volume, event, closed) as exchange messages."""
    k = F.struct(_ms().alias("t"), F.col("symbol").alias("s"), *[F.col(n).cast("string").alias(a) for a, n in zip(
        "ohlcv", ("open", "high", "low", "close", "volume"), strict=True)], F.col("closed").alias("x"))
    return df.select(F.to_json(F.struct(F.col("event").alias("e"), _ms().alias("E"), F.col("symbol").alias("s"), k.alias("k"))).alias("value"))


def _ticks_as_candles(spark, sf):
    v = F.col("value")
    return candle_events(P.table(spark, sf, "events").select(
        F.col("event_type").alias("symbol"), "ts", v.alias("open"), (v + 2).alias("high"), (v / 2).alias("low"), (v + 1).alias("close"),
        F.col("user_id").cast("double").alias("volume"), F.when(v > 100, "trade").otherwise("kline").alias("event"), (F.col("user_id") > 20).alias("closed")))


@query("m1_candle_events", """
    SELECT event_type AS symbol, date_trunc('millisecond', ts) AS ts, strftime(ts, '%Y-%m-%d') AS timestamp, value AS open, value + 2 AS high, value / 2 AS low,
      value + 1 AS close, CAST(user_id AS DOUBLE) AS volume FROM events WHERE value <= 100 AND user_id > 20""")
def _(spark, sf):
    return V.parse_candles(_ticks_as_candles(spark, sf)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def depth_events(spark, sf, files=None):
    """A book of 25 levels per side around each event's value; some wrapped, some one-sided. files: deal the events, before they get their books."""
    v, k = F.col("value"), F.get_json_object("props", "$.k").cast("int")
    levels = F.sequence(F.lit(0), F.lit(24))
    bids = F.transform(levels, lambda i: F.array((v - i * 0.25).cast("string"), (k + i).cast("string")))
    asks = F.when(F.col("value") < 200, F.transform(levels, lambda i: F.array((v + 1 + i * 0.5).cast("string"), (k * 2 + i).cast("string"))))
    events = P.table(spark, sf, "events").select("event_type", "ts", "value", "props")
    e = (events.repartition(files) if files else events).select("event_type", _ms().alias("E"), bids.alias("bids"), F.coalesce(asks, F.array().cast("array<array<string>>")).alias("asks"))
    wrapped = F.struct(F.concat("event_type", F.lit("@depth20")).alias("stream"), F.struct("E", "bids", "asks").alias("data"))
    plain = F.struct(F.col("event_type").alias("s"), "E", "bids", "asks")
    return e.select(F.when(F.col("event_type").isin("click", "view"), F.to_json(wrapped)).otherwise(F.to_json(plain)).alias("value"))


_DEPTH = """SELECT CASE WHEN event_type IN ('click', 'view') THEN upper(event_type) ELSE event_type END AS symbol, date_trunc('millisecond', ts) AS ts,
    1.0::DOUBLE AS spread, round(value + 0.5, 6) AS mid_price, CAST(20 * k + 190 AS DOUBLE) AS bid_depth, CAST(40 * k + 190 AS DOUBLE) AS ask_depth,
    value AS best_bid, round(value + 1, 6) AS best_ask FROM (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events) WHERE value < 200"""


def _depth_out(d):
    return d.withColumns({"ts": F.col("ts").cast("timestamp_ntz"), "mid_price": F.round("mid_price", 6), "best_ask": F.round("best_ask", 6)})


@query("m2_depth_events", _DEPTH)
def _(spark, sf):
    return _depth_out(V.parse_depth(depth_events(spark, sf)))


@query("m4_upsert_bars", sql("""
    SELECT symbol, ts, open, high, low, CASE WHEN volume > 20 THEN close + 1000 ELSE close END AS close, volume FROM bars_h6"""))
def _(spark, sf):
    bars = P.event_bars(spark, sf, "6 hours")
    lake, inbox = shared_dir(spark, "lake"), shared_dir(spark, "inbox")
    write_bars(bars.filter("volume > 20").withColumn("close", F.col("close") + 1000), lake)
    files = _files(bars, 4)
    sent = candle_events(bars.repartition(files).withColumn("event", F.lit("kline")).withColumn("closed", F.lit(True)))
    for _ in range(2):
        sent.write.mode("append").text(inbox)
    J.drain(J.upsert_bars(V.parse_candles(V.file_source(spark, inbox, files * 3 // 4)).drop("timestamp").withColumn("ts", F.col("ts").cast("timestamp_ntz")),
                          lake, shared_dir(spark, "checkpoint"), every=None))
    from ..sources.readers import read_bars
    return read_bars(spark, lake)


@query("m4_buffered_upsert", sql("SELECT symbol, ts, open, high, low, close, volume FROM bars_h6"))
def _(spark, sf):
    """Bars flushed at 25 rows of a symbol or after a minute, the rest when the stream ends; they come twice, in two runs."""
    bars, inbox = P.event_bars(spark, sf, "6 hours"), shared_dir(spark, "inbox")
    lake, state = shared_dir(spark, "lake"), shared_dir(spark, "checkpoint")
    schema = f"{bars.schema.simpleString()[7:-1].replace(':', ' ')}, {B.END} boolean"
    for batch in (bars, bars, B.end_of_rows(bars)):
        batch.withColumn(B.END, F.lit(B.END in batch.columns)).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(schema).parquet(inbox)
        J.drain(B.buffered_upsert(stream, lake, state, limit=25, shards=2, every=None))
    from ..sources.readers import read_bars
    return read_bars(spark, lake)


@query("m5_append_depth", _DEPTH)
def _(spark, sf):
    inbox, out = shared_dir(spark, "inbox"), shared_dir(spark, "depth")
    files = _files(P.table(spark, sf, "events"), 4)
    depth_events(spark, sf, files).write.text(inbox)
    J.drain(J.append_stream(V.parse_depth(V.file_source(spark, inbox, files // 2)), out, shared_dir(spark, "checkpoint"), every=None))
    return _depth_out(J.read_result(spark, out))


@query("m6_stream_dedupe", sql("SELECT symbol, ts, open, close, volume FROM bars_h6"))
def _(spark, sf):
    inbox, out = shared_dir(spark, "inbox"), shared_dir(spark, "unique")
    bars = P.event_bars(spark, sf, "6 hours")
    twice = bars.unionByName(bars)
    candle_events(twice.repartition(_files(twice, 4)).withColumn("event", F.lit("kline")).withColumn("closed", F.lit(True))).write.text(inbox)
    stream = J.deduplicated(V.parse_candles(V.file_source(spark, inbox)), "40 days")
    J.drain(J.append_stream(stream, out, shared_dir(spark, "checkpoint"), every=None))
    return J.read_result(spark, out).select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "open", "close", "volume")


@query("m7_windowed_bars", sql("""
    SELECT symbol, ts, open, high, low, close, volume FROM bars_d"""))
def _(spark, sf):
    inbox, out = shared_dir(spark, "inbox"), shared_dir(spark, "windows")
    P.table(spark, sf, "events").write.parquet(inbox)
    ticks = spark.readStream.schema(P.table(spark, sf, "events").schema).parquet(inbox).select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.col("event_id").alias("tie"))
    bars, state = J.windowed_bars(ticks, "1 day", "1 hour"), shared_dir(spark, "checkpoint")
    J.drain(J.append_stream(bars, out, state, every=None))
    J.end_of_ticks(P.table(spark, sf, "events"), "ts", "1 day", "1 hour").write.mode("append").parquet(inbox)
    J.drain(J.append_stream(bars, out, state, every=None))
    return J.read_result(spark, out).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("m7_restated_bars", sql("SELECT symbol, ts, open, high, low, close, volume FROM bars_d"))
def _(spark, sf):
    """Ticks in an order of their hash, days late: closed bars are restated; the first batches are compacted on the way."""
    inbox, out, state = (shared_dir(spark, n) for n in ("inbox", "restated", "checkpoint"))
    events = P.table(spark, sf, "events")
    half, files = F.pmod(F.xxhash64("event_id"), F.lit(2)), _files(events, 12) // 2
    for i in range(2):
        events.where(half == i).repartition(files, F.xxhash64("event_id")).write.mode("append").parquet(inbox)
        ticks = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", -(-files // 2)).parquet(inbox).select(
            F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.col("event_id").alias("tie"))
        J.drain(R.restated_bars(ticks, out, state, "1 day", "1 hour", trigger=None))
        if i == 0:
            R.compacted(spark, out)
    return R.bars(spark, out).drop("corrected").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
