"""The derived layer: returns, their moments and matrices as one long table of metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import moments as M


def silver_bundle(returns: DataFrame, periods: int) -> DataFrame:
    """All metrics of one asset class; ``periods`` is 365 for round-the-clock markets, 252 for exchanges.

    Mean and volatility come from one aggregation and both matrices from one pass over the pair rows.
    """
    single = M.mean_vol(returns, periods).unpivot(["symbol"], ["mean_return", "volatility"], "metric", "value").select(
        F.when(F.col("metric") == "mean_return", "mean").otherwise("volatility").alias("metric"),
        F.col("symbol").alias("symbol_row"), F.lit("").alias("symbol_col"), "value")
    pairs = M.symbol_pairs(returns, ordered=False).groupBy("symbol_a", "symbol_b").agg(
        (F.covar_samp("x_a", "x_b") * periods).alias("covariance"), M.pair_correlation().alias("_c"))
    corr = F.when(F.col("symbol_a") == F.col("symbol_b"), 1.0).otherwise(F.col("_c"))
    matrices = pairs.withColumn("correlation", corr).unpivot(
        ["symbol_a", "symbol_b"], ["covariance", "correlation"], "metric", "value"
    ).select("metric", F.col("symbol_a").alias("symbol_row"), F.col("symbol_b").alias("symbol_col"), "value")
    return single.unionByName(matrices)


def monthly_grid(returns: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Sums of log returns by month, one column per symbol or strategy."""
    month = F.date_format("ts", "yyyy-MM").alias("month")
    return returns.groupBy(month).pivot(column, values).agg(F.sum("r")).na.fill(0.0)
