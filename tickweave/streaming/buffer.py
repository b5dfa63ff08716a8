"""Count-or-time flush: rows of a key are held in state until there are enough of them or the first has waited long enough.

The state of a key is its rows that were not flushed yet, fewer than ``limit`` ones, and their number. ``limit`` rows are a flush; a
processing-time timer set when the first of them came flushes what there is; a row of `end_of_rows`, sent to a stream that is to stop,
flushes the rest. Keys are (symbol, shard), the shard from the hash of the row's time, so that a symbol with a third of all rows is spread
over ``shards`` tasks and rows that repeat a time stay together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from .jobs import append_new_bars

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
END = "flush_end"


class Flusher(StatefulProcessor):
    """Emits the rows of a flush with its number in the key and what caused it: count, time or end."""

    def __init__(self, schema: StructType, limit: int, wait_ms: int):
        self.schema, self.limit, self.wait_ms = schema, limit, wait_ms
        self.names = schema.fieldNames()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.schema)
        # rows held, flushes so far, time of the timer
        self.count = handle.getValueState("count", StructType([StructField("n", IntegerType()), StructField("flushes", LongType()), StructField("timer", LongType())]))

    def _rows(self) -> list[tuple]:
        return list(self.held.get())

    def _flushed(self, rows: list[tuple], flushes: int, cause: str) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=self.names)
        return out.assign(flush=flushes, cause=cause)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, flushes, timer = self.count.get() if self.count.exists() else (0, 0, -1)
        held, new, ended = None, [], False
        for frame in rows:
            ended |= bool(frame[END].any())
            new += list(frame.loc[~frame[END].astype(bool), self.names].itertuples(index=False, name=None))
            while n + len(new) >= self.limit:
                held = self._rows() if n else []
                take = self.limit - len(held)
                yield self._flushed(held + new[:take], flushes, "count")
                new, n, flushes = new[take:], 0, flushes + 1
                self.held.clear()
        if ended and n + len(new):
            yield self._flushed((self._rows() if n else []) + new, flushes, "end")
            self.held.clear()
            new, n, flushes = [], 0, flushes + 1
        if new:
            self.held.appendList(new)
        n += len(new)
        if (held is not None or not n) and timer >= 0:
            self.handle.deleteTimer(timer)
            timer = -1
        if n and timer < 0:
            timer = timerValues.getCurrentProcessingTimeInMs() + self.wait_ms
            self.handle.registerTimer(timer)
        self.count.update((n, flushes, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, flushes, _ = self.count.get()
        if n:
            yield self._flushed(self._rows(), flushes, "time")
            self.held.clear()
            flushes += 1
        self.count.update((0, flushes, -1))


def buffered(rows: DataFrame, limit: int = 100, wait: float = 60.0, shards: int = 8) -> DataFrame:
    """The rows of a stream (symbol, ts, ...) once their buffer is flushed, with ``flush`` and ``cause``.

    A column ``flush_end`` marks rows of `end_of_rows`; it need not be there.
    """
    names = [c for c in rows.columns if c != END]
    end = F.coalesce(END, F.lit(False)) if END in rows.columns else F.lit(False)
    every = F.sequence(F.lit(0), F.lit(shards - 1))
    own = F.array(F.pmod(F.xxhash64("ts"), F.lit(shards)).cast("int"))
    keyed = rows.select(*names, end.alias(END)).withColumn("flush_shard", F.explode(F.when(F.col(END), every).otherwise(own)))
    schema = rows.select(*names).schema
    out = StructType([*schema.fields, StructField("flush", LongType()), StructField("cause", StringType())])
    return keyed.groupBy("symbol", "flush_shard").transformWithStateInPandas(
        Flusher(schema, limit, int(1000 * wait)), outputStructType=out, outputMode="Append", timeMode="ProcessingTime")


def end_of_rows(rows: DataFrame) -> DataFrame:
    """One row for each symbol, marked ``flush_end``: what a stream that is to stop is sent last."""
    kept = [F.col("symbol") if c == "symbol" else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes]
    return rows.select("symbol").distinct().select(*kept, F.lit(True).alias(END))


def buffered_upsert(bars: DataFrame, path: str, checkpoint: str, limit: int = 100, wait: float = 60.0, shards: int = 8,
                    every: str | None = "5 seconds") -> StreamingQuery:
    """Bars to the lake after ``limit`` rows of a key or ``wait`` seconds; stored bars win, repeating a batch adds nothing."""
    spark = bars.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)  # timers need it; a query keeps the setting it started with
    try:
        flushed = buffered(bars, limit, wait, shards).drop("flush", "cause")
        w = flushed.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda b, _: append_new_bars(b, path))
        # with timers availableNow never ends: it goes on with batches without data
        return (w.trigger(processingTime=every) if every else w.trigger(once=True)).start()
    finally:
        spark.conf.set(PROVIDER, before)
