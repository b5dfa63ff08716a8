"""Moving averages, oscillators, trading signals and market regimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import guarded_ratio
from ..timeline import smoothed, trailing
from .align import returns_only, with_returns
from .risk import median

# Fixed values.
BUY, SELL, HOLD = "BUY", "SELL", "HOLD"
BULL, BEAR, SIDEWAYS = "BULL", "BEAR", "SIDEWAYS"


def _full(window: int, x: Column, pos: str = "pos") -> Column:
    return F.when(F.col(pos) >= window, x)


def volatility_surface(returns: DataFrame, windows: tuple[int, ...] = (7, 14, 30, 60, 90)) -> DataFrame:
    """Latest sample deviation per window; windows longer than the history use what there is.

    Only the last rows matter, so each window is a filtered aggregate and nothing is sorted.
    """
    last = returns.groupBy("symbol").agg(F.max("pos").alias("_n"))
    d = returns.join(last, "symbol").groupBy("symbol").agg(
        *[F.stddev_samp(F.when(F.col("pos") > F.col("_n") - n, F.col("r"))).alias(str(n)) for n in windows])
    out = d.unpivot(["symbol"], [str(n) for n in windows], "window", "volatility")
    return out.withColumn("window", F.col("window").cast("int"))


def rolling_volatility(returns: DataFrame, window: int, periods: int) -> DataFrame:
    d = trailing(returns, window - 1, lambda w: {"_sd": F.stddev_pop("r").over(w.rowsBetween(-(window - 1), 0))})
    return d.select("symbol", "ts", _full(window, F.col("_sd") * periods**0.5).alias("volatility"))


def realised_volatility(returns: DataFrame, window: int = 20, periods: int = 365) -> DataFrame:
    last = returns.groupBy("symbol").agg(F.max("pos").alias("_n"))
    tail = returns.join(last, "symbol").filter(F.col("pos") > F.col("_n") - window)
    return tail.groupBy("symbol").agg((F.coalesce(F.stddev_samp("r"), F.lit(0.0)) * periods**0.5).alias("volatility"))


def rolling_sharpe(series: DataFrame, window: int, risk_free: float, periods: int, key: tuple[str, ...] = ()) -> DataFrame:
    """Over the ``window`` rows before each row, population deviation."""
    d = trailing(series, window, lambda w: {
        "_m": F.avg("r").over(w.rowsBetween(-window, -1)), "_sd": F.stddev_pop("r").over(w.rowsBetween(-window, -1))}, key=key)
    x = guarded_ratio((F.col("_m") - risk_free / periods) * periods**0.5, F.col("_sd"), floor=1e-10)
    return d.filter(F.col("pos") > window).select(*key, "ts", x.alias("rolling_sharpe"))


def moving_average(bars: DataFrame, window: int, full: bool = True) -> DataFrame:
    d = trailing(bars, window - 1, lambda w: {"sma": F.avg("close").over(w.rowsBetween(-(window - 1), 0))})
    return d.withColumn("sma", _full(window, F.col("sma"))) if full else d


def _frame(n: int):
    return lambda w: w.rowsBetween(-(n - 1), 0)


def _band_inputs(w, window: int) -> dict[str, Column]:
    f = _frame(window)(w)
    return {"_m": F.avg("close").over(f), "_sd": F.stddev_pop("close").over(f)}


def _bands(d: DataFrame, window: int, width: float) -> DataFrame:
    return d.withColumns({
        "middle": _full(window, F.col("_m")), "upper": _full(window, F.col("_m") + F.col("_sd") * width),
        "lower": _full(window, F.col("_m") - F.col("_sd") * width)}).drop("_m", "_sd")


def bollinger(bars: DataFrame, window: int = 20, width: float = 2.0) -> DataFrame:
    return _bands(trailing(bars, window - 1, lambda w: _band_inputs(w, window)), window, width)


def ema(bars: DataFrame, window: int, value: str = "close", out: str = "ema", pos: str = "pos") -> DataFrame:
    return smoothed(bars, {out: (value, 2.0 / (window + 1), window)}, pos=pos)


def _change(w) -> dict[str, Column]:
    return {"_d": F.col("close") - F.lag("close").over(w)}


def _rsi(d: DataFrame, window: int) -> DataFrame:
    later = F.col("pos") > 1
    d = d.withColumns({"_k": F.col("pos") - 1, "_up": F.when(later, F.greatest(F.col("_d"), F.lit(0.0))),
                       "_down": F.when(later, F.greatest(-F.col("_d"), F.lit(0.0)))})
    d = smoothed(d, {"_gain": ("_up", 1.0 / window, window), "_loss": ("_down", 1.0 / window, window)}, pos="_k")
    x = F.when(F.col("_loss") > 0, 100 - 100 / (1 + F.col("_gain") / F.col("_loss"))).otherwise(100.0)
    return d.withColumn("rsi", F.when(F.col("_gain").isNotNull(), x)).drop("_d", "_k", "_up", "_down", "_gain", "_loss")


def rsi(bars: DataFrame, window: int = 14) -> DataFrame:
    """Wilder's index: gains and losses smoothed by 1/window after a plain-mean start."""
    return _rsi(trailing(bars, 1, _change), window)


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Difference of two averages and its histogram; the signal line starts on the first differences."""
    d = smoothed(bars, {"_f": ("close", 2.0 / (fast + 1), fast), "_s": ("close", 2.0 / (slow + 1), slow)})
    d = d.withColumns({"macd": F.col("_f") - F.col("_s"), "_k": F.col("pos") - (slow - 1)})
    d = ema(d, signal, value="macd", out="_sig", pos="_k")
    return d.withColumn("histogram", F.col("macd") - F.col("_sig")).drop("_f", "_s", "_k", "_sig")


def _vote(up: Column, down: Column, known: Column) -> Column:
    return F.when(known, F.when(up, BUY).when(down, SELL).otherwise(HOLD))


def _crossing_inputs(w, short: int, long: int) -> dict[str, Column]:
    return {"_a": F.avg("close").over(_frame(short)(w)), "_b": F.avg("close").over(_frame(long)(w))}


def _crossing(d: DataFrame, long: int) -> DataFrame:
    a, b = F.col("_a"), F.col("_b")
    return d.withColumn("sma_signal", _vote(a > b, a < b, F.col("pos") >= long)).drop("_a", "_b")


def crossing_signal(bars: DataFrame, short: int = 10, long: int = 30) -> DataFrame:
    return _crossing(trailing(bars, long - 1, lambda w: _crossing_inputs(w, short, long)), long)


def _rsi_vote(d: DataFrame, high: float = 70.0, low: float = 30.0) -> DataFrame:
    return d.withColumn("rsi_signal", _vote(F.col("rsi") <= low, F.col("rsi") >= high, F.col("rsi").isNotNull()))


def rsi_signal(bars: DataFrame, window: int = 14, high: float = 70.0, low: float = 30.0) -> DataFrame:
    return _rsi_vote(rsi(bars, window), high, low)


def macd_signal(bars: DataFrame) -> DataFrame:
    d = macd(bars)
    h = F.col("histogram")
    return d.withColumn("macd_signal", _vote(h > 0, h < 0, h.isNotNull()))


def _bollinger_vote(d: DataFrame) -> DataFrame:
    c = F.col("close")
    return d.withColumn("bollinger_signal", _vote(c > F.col("upper"), c < F.col("lower"), F.col("upper").isNotNull()))


def bollinger_signal(bars: DataFrame) -> DataFrame:
    """Breakout reading: above the upper band buys, below the lower band sells."""
    return _bollinger_vote(bollinger(bars))


SIGNALS = ("sma_signal", "rsi_signal", "macd_signal", "bollinger_signal")


def all_signals(bars: DataFrame, short: int = 10, long: int = 30, band: int = 20, rsi_window: int = 14) -> DataFrame:
    """All signals by date; every plain frame comes from one pass over the blocks."""
    d = trailing(bars, max(long, band) - 1, lambda w: _crossing_inputs(w, short, long) | _band_inputs(w, band) | _change(w))
    d = _bollinger_vote(_bands(_crossing(d, long), band, 2.0))
    return macd_signal(_rsi_vote(_rsi(d, rsi_window)))


def majority(votes: list[Column]) -> Column:
    score, known = F.lit(0), F.lit(False)
    for v in votes:
        score = score + F.when(v == BUY, 1).when(v == SELL, -1).otherwise(0)
        known = known | v.isNotNull()
    return F.when(known, F.when(score > 0, BUY).when(score < 0, SELL).otherwise(HOLD))


def latest_signals(bars: DataFrame) -> DataFrame:
    """Last known signal of each kind and the vote over them."""
    def last(name: str) -> Column:
        return F.max_by(F.col(name), F.when(F.col(name).isNotNull(), F.col("pos"))).alias(name)

    d = all_signals(bars).groupBy("symbol").agg(*[last(s) for s in SIGNALS], last("rsi").alias("rsi_value"), F.max("pos").alias("n_periods"))
    return d.withColumn("combined", majority([F.col(s) for s in SIGNALS]))


def signal_board(bars: DataFrame, min_bars: int = 30) -> DataFrame:
    """Latest signals of symbols with enough bars, buys first."""
    d = latest_signals(bars).filter(F.col("n_periods") >= min_bars)
    order = F.when(F.col("combined") == BUY, 0).when(F.col("combined") == HOLD, 1).when(F.col("combined") == SELL, 2).otherwise(3)
    return d.withColumn("board_order", order).orderBy("board_order", "symbol")


def signal_counts(board: DataFrame) -> DataFrame:
    c = F.col("combined")
    buy, sell, n = F.count_if(c == BUY), F.count_if(c == SELL), F.count(F.lit(1))
    return board.agg(buy.alias("buy_count"), sell.alias("sell_count"), (n - buy - sell).alias("hold_count"), n.alias("total"))


def regimes(bars: DataFrame, short: int = 20, long: int = 50, vol_window: int = 20, periods: int = 365) -> DataFrame:
    """Trend and volatility state per symbol; symbols with fewer than ``long`` bars are undecided."""
    priced = with_returns(bars)
    r = returns_only(priced)
    n = bars.groupBy("symbol").agg(F.max("pos").alias("n_periods"))
    recent = bars.join(n, "symbol")

    def tail(k: int) -> Column:
        return F.avg(F.when(F.col("pos") > F.col("n_periods") - k, F.col("close")))

    t = recent.groupBy("symbol", "n_periods").agg(tail(short).alias("short_sma"), tail(long).alias("long_sma"), F.max_by("close", "pos").alias("_price"))
    vols = trailing(r, vol_window - 1, lambda w: {"_v": F.stddev_samp("r").over(w.rowsBetween(-(vol_window - 1), 0)) * periods**0.5})
    mid = median(vols.filter(F.col("pos") >= vol_window), "_v").withColumnRenamed("median", "median_vol")
    now = vols.groupBy("symbol").agg(F.coalesce(F.max_by("_v", "pos"), F.lit(0.0)).alias("current_vol"))
    d = t.join(now, "symbol", "left").join(mid, "symbol", "left")
    known = F.col("n_periods") >= long
    d = d.withColumn("median_vol", F.coalesce("median_vol", "current_vol"))
    high = (F.col("median_vol") > 0) & (F.col("current_vol") > F.col("median_vol") * 1.2)
    up, above = F.col("short_sma") > F.col("long_sma"), F.col("_price") > F.col("long_sma")
    agree = F.when(high, 0.7).otherwise(1.0)
    return d.select(
        "symbol",
        F.when(known & up & above, BULL).when(known & ~up & ~above, BEAR).otherwise(SIDEWAYS).alias("regime"),
        F.when(~known, 0.0).when(up == above, agree).otherwise(0.5).alias("confidence"),
        F.when(known & up, "BULLISH").when(known & (F.col("short_sma") < F.col("long_sma")), "BEARISH").otherwise("NEUTRAL").alias("trend_signal"),
        F.when(~known, "UNKNOWN").when(high, "HIGH").otherwise("LOW").alias("vol_regime"),
        F.when(known, F.col("short_sma")).alias("short_sma"), F.when(known, F.col("long_sma")).alias("long_sma"),
        F.when(known, F.col("current_vol")).otherwise(0.0).alias("current_vol"),
        F.when(known, F.col("median_vol")).otherwise(0.0).alias("median_vol"), "n_periods")


def market_state(states: DataFrame) -> DataFrame:
    c = F.col("regime")
    d = states.agg(F.count_if(c == BULL).alias("bull_count"), F.count_if(c == BEAR).alias("bear_count"),
                   F.count_if(c == SIDEWAYS).alias("sideways_count"), F.count(F.lit(1)).alias("n_assets"))
    bull, bear, side = F.col("bull_count"), F.col("bear_count"), F.col("sideways_count")
    return d.withColumn("market_regime", F.when((bull > bear) & (bull > side), BULL).when((bear > bull) & (bear > side), BEAR).otherwise(SIDEWAYS))
