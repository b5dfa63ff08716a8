"""Streams with state: flush by count, time and end; bars that late ticks restate."""

from __future__ import annotations

import random
import time
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickweave.operators.bars import build_bars
from tickweave.plans import q_streaming
from tickweave.plans.catalog import QUERIES
from tickweave.streaming import buffer, events, jobs, restate

ROWS = "symbol string, ts timestamp, close double, flush_end boolean"
DAY = datetime(2024, 3, 1)


@pytest.fixture
def folder(tmp_path):
    return lambda name: str(tmp_path / name)


def flushed(spark, folder, limit=20, wait=600.0, shards=2):
    """One batch over what the inbox has got since the last one."""
    before = spark.conf.get(buffer.PROVIDER)
    spark.conf.set(buffer.PROVIDER, buffer.ROCKS)
    rows = buffer.buffered(spark.readStream.schema(ROWS).parquet(folder("in")), limit, wait, shards)
    out = rows.writeStream.option("path", folder("out")).option("checkpointLocation", folder("state")).format("parquet")
    query = out.trigger(once=True).start()
    spark.conf.set(buffer.PROVIDER, before)
    jobs.drain(query)
    return spark.read.parquet(folder("out"))


def sent(spark, folder, rows):
    spark.createDataFrame([(*r, False) for r in rows], ROWS).repartition(3).write.mode("append").parquet(folder("in"))


def test_flush_by_count_and_at_the_end(spark, folder):
    rows = [(f"s{i % 3}", DAY + timedelta(hours=i), float(i)) for i in range(1000)]
    sent(spark, folder, rows[:700])
    first = flushed(spark, folder)
    sizes = Counter((r["symbol"], r["flush_shard"], r["flush"]) for r in first.withColumn("flush_shard", F.pmod(F.xxhash64("ts"), F.lit(2))).collect())
    assert set(sizes.values()) == {20} and {r["cause"] for r in first.collect()} == {"count"}
    held = 700 - sum(sizes.values())
    assert 0 < held < 6 * 20
    sent(spark, folder, rows[700:])
    assert {r["cause"] for r in flushed(spark, folder).collect()} == {"count"}
    buffer.end_of_rows(spark.createDataFrame([(*r, False) for r in rows], ROWS).drop("flush_end")).write.mode("append").parquet(folder("in"))
    all_of = flushed(spark, folder).collect()
    assert sorted((r["symbol"], r["close"]) for r in all_of) == sorted((s, c) for s, _, c in rows)
    assert Counter(r["cause"] for r in all_of)["end"] == 1000 % 20 or Counter(r["cause"] for r in all_of)["end"] < 6 * 20


def test_flush_by_time(spark, folder):
    sent(spark, folder, [("a", DAY + timedelta(hours=i), float(i)) for i in range(5)])
    assert flushed(spark, folder, wait=2.0, shards=1).count() == 0
    time.sleep(2.5)
    sent(spark, folder, [("b", DAY, 1.0)])
    got = flushed(spark, folder, wait=2.0, shards=1).collect()
    assert [(r["symbol"], r["cause"]) for r in got] == [("a", "time")] * 5


def test_buffered_bars_come_once(spark, folder):
    """Bars that are sent twice, and stored ones, change nothing; those still held reach the lake with the end."""
    bars = spark.createDataFrame([(f"s{i % 2}", DAY + timedelta(hours=i), *[float(i)] * 5) for i in range(60)],
                                 "symbol string, ts timestamp, open double, high double, low double, close double, volume double")
    bars = bars.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    lake = folder("lake")
    jobs.append_new_bars(bars.where("close < 5").withColumn("close", F.lit(-1.0)), lake)
    for batch in (bars, bars.where("close > 10"), buffer.end_of_rows(bars)):
        batch.withColumn("flush_end", F.lit("flush_end" in batch.columns)).write.mode("append").parquet(folder("in"))
        stream = spark.readStream.schema(spark.read.parquet(folder("in")).schema).parquet(folder("in"))
        jobs.drain(buffer.buffered_upsert(stream, lake, folder("state"), limit=7, shards=2, every=None))
    got = sorted((r["symbol"], r["open"], r["close"]) for r in spark.read.parquet(lake).collect())
    assert got == sorted((f"s{i % 2}", float(i), -1.0 if i < 5 else float(i)) for i in range(60))


TICKS = "symbol string, ts timestamp, price double, tie long"


def ticks(n, seed=0):
    r = random.Random(seed)
    return [(f"s{r.randrange(3)}", DAY + timedelta(minutes=r.randrange(6 * 24 * 60)), r.choice([1.0, 2.0, r.random()]), i) for i in range(n)]


def wanted(spark, rows):
    d = build_bars(spark.createDataFrame(rows, TICKS), symbol="symbol", ts="ts", price="price", bucket="day", tie="tie")
    return sorted((r["symbol"], r["ts"], r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in d.select("*", F.col("ts").cast("timestamp")).collect())


def got(df):
    return sorted((r["symbol"], r["ts"], r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in df.collect())


def test_late_ticks_restate_closed_bars(spark, folder):
    rows, path = ticks(600), folder("bars")
    ordered = sorted(rows, key=lambda t: t[1])
    late, on_time = ordered[:40:2], ordered[1:40:2] + ordered[40:]
    batches = [on_time[:200], on_time[200:500], on_time[500:], late, [(None, DAY, 1.0, 1), ("s0", None, 1.0, 2)]]
    for i, batch in enumerate(batches):
        restate.write_batch(spark.createDataFrame(batch, TICKS), i, path, "1 day", "1 hour")
        if i == 2:
            before = restate.bars(spark, path)
            assert before.agg(F.sum("corrected")).first()[0] == 0 and got(before.drop("corrected")) == wanted(spark, on_time)
            closed = restate.bars(spark, path, closed="1 day")
            assert closed.count() < before.count()
    after = restate.bars(spark, path)
    assert got(after.drop("corrected")) == wanted(spark, rows)
    assert after.agg(F.sum("corrected")).first()[0] == len(late)
    assert spark.read.parquet(f"{path}/corrections").agg(F.sum("volume")).first()[0] == len(late)


def test_a_batch_that_runs_again_counts_once_and_compaction_changes_nothing(spark, folder):
    rows, path = ticks(400, 1), folder("bars")
    r = random.Random(2)
    r.shuffle(rows)
    frames = [spark.createDataFrame(rows[i * 100 : i * 100 + 100], TICKS) for i in range(4)]
    assert restate.compacted(spark, path) is None and restate.bars(spark, path).count() == 0
    for i in (0, 1, 1, 0, 1):
        restate.write_batch(frames[i], i, path, "1 day", "1 hour")
    corrected = restate.bars(spark, path).agg(F.sum("corrected")).first()[0]
    assert restate.compacted(spark, path) == 1
    assert restate.stored(spark, path).where("batch > 1").count() == 0
    assert got(restate.bars(spark, path).drop("corrected")) == wanted(spark, rows[:200])
    assert restate.bars(spark, path).agg(F.sum("corrected")).first()[0] == corrected
    for i in (2, 3):
        restate.write_batch(frames[i], i, path, "1 day", "1 hour")
    assert got(restate.bars(spark, path).drop("corrected")) == wanted(spark, rows)
    assert restate.compacted(spark, path) == 3
    assert got(restate.bars(spark, path).drop("corrected")) == wanted(spark, rows)


@pytest.mark.parametrize("name", ["m5_append_depth", "m6_stream_dedupe", "m4_upsert_bars"])
def test_files_sent_hold_few_rows(spark, sf, monkeypatch, name):
    """More rows make more files, not larger ones."""
    inboxes, source = [], events.file_source
    monkeypatch.setattr(q_streaming, "ROWS", 20, raising=False)
    monkeypatch.setattr(events, "file_source", lambda s, path, n=None: inboxes.append(path) or source(s, path, n))
    QUERIES[name](spark, sf)
    sizes = [r["count"] for r in spark.read.text(inboxes[0]).groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > 4 and max(sizes) <= 25
