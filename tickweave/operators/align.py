"""Alignment of many series on common dates, and the joins on date, symbol and weight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import log_return, simple_return
from ..timeline import number_rows, trailing


def common_dates(bars: DataFrame) -> DataFrame:
    """Bars on the dates that every symbol has; of rows that repeat (symbol, ts) one stays.

    The last one by an ``arrival`` column wins, if there is one, else the largest values. No common date is an error.
    """
    rest = [c for c in bars.columns if c not in ("symbol", "ts")]
    rank = F.struct("arrival", *rest) if "arrival" in rest else F.struct(*rest)
    if rest:
        bars = bars.groupBy("symbol", "ts").agg(F.max_by(F.struct(*rest), rank).alias("_b")).select("symbol", "ts", "_b.*")
    else:
        bars = bars.distinct()
    n_symbols = bars.select("symbol").distinct().agg(F.count(F.lit(1)).alias("n"))
    full = bars.groupBy("ts").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == n_symbols.scalar())
    some = full.agg(F.count(F.lit(1)).alias("n"))
    none = F.raise_error(F.lit("the symbols have no date in common"))
    full = full.select("ts").unionByName(some.filter("n = 0").select(none.cast("timestamp_ntz").alias("ts")))
    return bars.join(full, "ts", "left_semi")


def with_returns(bars: DataFrame, slice_by=None) -> DataFrame:
    """Numbered bars with log return ``r`` and simple return ``s``; both null on the first bar."""
    numbered = number_rows(bars, slice_by=slice_by) if "pos" not in bars.columns else bars
    lagged = trailing(numbered, 1, lambda w: {"prev_close": F.lag("close").over(w)})
    return lagged.withColumn("r", log_return("close", "prev_close")).withColumn("s", simple_return("close", "prev_close"))


def returns_only(priced: DataFrame) -> DataFrame:
    """Return rows, renumbered from 1."""
    return priced.filter("pos > 1").withColumn("pos", F.col("pos") - 1)


def symbol_pairs(returns: DataFrame, value: str = "r", *, ordered: bool = True) -> DataFrame:
    """All symbol pairs on the same date: a < b, or all n*n when not ``ordered``.

    The join key is the date. Each symbol has one row per date, so a symbol with a long history adds at most
    one row to any date and the join stays even. The n*n pairs per date are the matrix itself; callers
    aggregate them in the same stage, before any shuffle.
    """
    a = returns.select("ts", "pos", F.col("symbol").alias("symbol_a"), F.col(value).alias("x_a"))
    b = returns.select("ts", F.col("symbol").alias("symbol_b"), F.col(value).alias("x_b"))
    pairs = a.join(b, "ts")
    return pairs.filter("symbol_a < symbol_b") if ordered else pairs


def portfolio_series(returns: DataFrame, weights: DataFrame, value: str = "r") -> DataFrame:
    """Return of each portfolio by date; symbols without returns are skipped and weights stay as given."""
    by = ["portfolio", "ts", "pos"] if "portfolio" in weights.columns else ["ts", "pos"]
    return returns.join(weights, "symbol").groupBy(*by).agg(F.sum(F.col("weight") * F.col(value)).alias("r"))


def outer_weights(current: DataFrame, target: DataFrame) -> DataFrame:
    c = current.select("symbol", F.col("weight").alias("current_weight"))
    t = target.select("symbol", F.col("weight").alias("target_weight"))
    return c.join(t, "symbol", "full_outer").na.fill(0.0, ["current_weight", "target_weight"])


def renormalised(weights: DataFrame, universe: DataFrame) -> DataFrame:
    """Weights of the symbols in ``universe``, scaled to sum to 1."""
    kept = weights.join(universe.select("symbol").distinct(), "symbol", "left_semi")
    return kept.withColumn("weight", F.col("weight") / kept.agg(F.sum("weight")).scalar())
