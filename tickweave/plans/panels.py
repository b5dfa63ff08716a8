"""Bars, returns and weights derived from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.align import common_dates, portfolio_series, returns_only, with_returns
from ..operators.bars import build_bars, bucket_start
from ..session import shared_dir
from ..timeline import number_rows

_WRITTEN: dict[tuple[str, str, str], tuple[str, object]] = {}


def _state(spark: SparkSession, sf: str) -> int:
    path = spark._jvm.org.apache.hadoop.fs.Path(sf)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return hash(tuple((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path)))


def lake(spark: SparkSession, sf: str, name: str, build: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """A derived table of the lake, written to the shared folder once per application and state of the source.

    The state is the listing of the source's files with their sizes and times, so changed files are read anew.

    Analytics read it like any table: raw data is scanned once, plans stay short, and a lost executor
    loses nothing.
    """
    key = (spark.sparkContext.applicationId, f"{sf}@{_state(spark, sf)}", name)
    if key not in _WRITTEN:
        df = build(spark, sf)
        path = shared_dir(spark, name)
        df.write.parquet(path)
        _WRITTEN[key] = (path, df.schema)
    path, schema = _WRITTEN[key]
    return spark.read.schema(schema).parquet(path)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def supplier_region(spark: SparkSession, sf: str) -> DataFrame:
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    geo = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", F.col("r_name").alias("symbol"))
    return s.join(geo, s.s_nationkey == geo.n_nationkey).select("s_suppkey", "symbol")


def trades(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with the supplier's region as symbol."""
    li = table(spark, sf, "lineitem")
    return li.join(supplier_region(spark, sf), li.l_suppkey == F.col("s_suppkey"))


def build_weekly_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly bars per region: volume-weighted price, extremes of the unit price, quantity."""
    unit = F.try_divide("l_extendedprice", "l_quantity")  # null at quantity 0
    return (
        trades(spark, sf)
        .groupBy("symbol", bucket_start("l_shipdate", "week").alias("ts"))
        .agg(
            F.try_divide(F.sum("l_extendedprice"), F.sum("l_quantity")).alias("close"),
            F.max(unit).alias("high"), F.min(unit).alias("low"), F.sum("l_quantity").alias("volume"),
        )
    )


def build_silver(spark: SparkSession, sf: str) -> DataFrame:
    return with_returns(common_dates(weekly_bars(spark, sf))).select(
        "symbol", "ts", "close", "high", "low", "volume", "pos", "r", "s")


def symbols(spark: SparkSession, sf: str) -> list[str]:
    """The names of the panel's symbols in order: the columns of wide tables, a bounded universe."""
    return [r[0] for r in weekly_bars(spark, sf).select("symbol").distinct().orderBy("symbol").collect()]


def weekly_bars(spark: SparkSession, sf: str) -> DataFrame:
    return lake(spark, sf, "bars_weekly", build_weekly_bars)


def numbered(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly bars with their position in the symbol's history."""
    return lake(spark, sf, "bars_numbered", lambda sp, d: number_rows(weekly_bars(sp, d)))


def silver(spark: SparkSession, sf: str) -> DataFrame:
    """Aligned weekly bars with positions and returns; the shared input of the analytics."""
    return lake(spark, sf, "silver", build_silver)


def returns(spark: SparkSession, sf: str) -> DataFrame:
    return returns_only(silver(spark, sf))


def event_bars(spark: SparkSession, sf: str, bucket: str = "day") -> DataFrame:
    return build_bars(
        table(spark, sf, "events"), symbol="event_type", ts="ts", price="value", bucket=bucket, tie="event_id"
    )


def target_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Share of traded quantity per region."""
    return lake(spark, sf, "target_weights", _build_target_weights)


def _build_target_weights(spark: SparkSession, sf: str) -> DataFrame:
    v = weekly_bars(spark, sf).groupBy("symbol").agg(F.sum("volume").alias("v"))
    total = v.agg(F.sum("v"))
    return v.select("symbol", (F.col("v") / total.scalar()).alias("weight"))


def books(spark: SparkSession, sf: str) -> DataFrame:
    """Several portfolios: one per return flag and line status, weighted by amount per region."""
    return lake(spark, sf, "books", _build_books)


def _build_books(spark: SparkSession, sf: str) -> DataFrame:
    v = trades(spark, sf).groupBy(
        F.concat_ws("-", "l_returnflag", "l_linestatus").alias("portfolio"), "symbol"
    ).agg(F.sum("l_extendedprice").alias("v"))
    totals = v.groupBy("portfolio").agg(F.sum("v").alias("t"))
    return v.join(totals, "portfolio").select("portfolio", "symbol", (F.col("v") / F.col("t")).alias("weight"))


def portfolio_returns(spark: SparkSession, sf: str) -> DataFrame:
    """Return series of the target weights: ts, pos, r."""
    return portfolio_series(returns(spark, sf), target_weights(spark, sf))


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols and the portfolio as return series of one frame."""
    return lake(spark, sf, "entities", _build_entities)


def _build_entities(spark: SparkSession, sf: str) -> DataFrame:
    r = returns(spark, sf).select("symbol", "ts", "pos", "r")
    return r.unionByName(portfolio_returns(spark, sf).withColumn("symbol", F.lit("portfolio")))


def market(spark: SparkSession, sf: str) -> DataFrame:
    return returns(spark, sf).groupBy("ts", "pos").agg(F.avg("r").alias("m"))
