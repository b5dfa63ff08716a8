"""The report of a portfolio: every measure of its return series side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import risk as K


def portfolio_report(series: DataFrame, market: DataFrame, risk_free: float, periods: int, confidence: float = 0.95, threshold: float = 0.0,
                     key: str = "portfolio") -> DataFrame:
    """One row per portfolio with 4 returns or more. series: key, ts, pos, r; market: ts, m.

    Regression on the market, capture, downside and upside deviation, Sortino and gain-to-pain ratios, omega, shape, historical, normal and
    moment-adjusted VaR and CVaR, the largest fall of compounded wealth, annual return and Calmar ratio. Measures against the market cover
    the dates both have; the others all dates of the series.
    """
    both = series.select(key, "ts", F.col("r").alias("p")).join(market.select("ts", F.col("m").alias("b")), "ts")
    parts = [
        K.downside(series, risk_free, periods, key), K.alpha_beta(both, risk_free, periods, [key]).withColumnRenamed("n_periods", "n_market"),
        K.capture(both, [key]), K.omega(series, threshold, key), K.sample_shape(series, key).drop("n"),
        K.value_at_risk(series, confidence, key).drop("n_observations"), K.calmar(series, periods, key)]
    return reduce(lambda a, b: a.join(b, key), parts)
