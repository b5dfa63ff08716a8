"""Portfolio algebra on long tables: weights (portfolio, symbol, weight), matrices (symbol_row, symbol_col, value).

Every step is a join on symbol and a sum by portfolio. A portfolio has at most one row per symbol, so no group
exceeds the universe, and any number of portfolios goes through the same job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clip, guarded_ratio, is_crypto
from .align import outer_weights

TOLERANCE = 0.01


def marginal_variance(weights: DataFrame, cov: DataFrame) -> DataFrame:
    """(portfolio, symbol, sigma_w): the product of the covariance matrix and the weights."""
    w = weights.select("portfolio", F.col("symbol").alias("symbol_col"), F.col("weight").alias("_w"))
    return cov.join(w, "symbol_col").groupBy("portfolio", F.col("symbol_row").alias("symbol")).agg(
        F.sum(F.col("value") * F.col("_w")).alias("sigma_w"))


def portfolio_stats(weights: DataFrame, mu: DataFrame, cov: DataFrame, risk_free: float = 0.05) -> DataFrame:
    """Return, variance, volatility and Sharpe ratio per portfolio, and whether its weights sum to 1."""
    d = weights.join(mu.select("symbol", "mean_return"), "symbol").join(marginal_variance(weights, cov), ["portfolio", "symbol"])
    out = d.groupBy("portfolio").agg(
        F.sum(F.col("weight") * F.col("mean_return")).alias("expected_return"),
        F.greatest(F.lit(0.0), F.sum(F.col("weight") * F.col("sigma_w"))).alias("variance"),
        (F.abs(F.sum("weight") - 1) <= TOLERANCE).alias("weights_ok"))
    out = out.withColumn("volatility", F.sqrt("variance"))
    return out.withColumn("sharpe", guarded_ratio(F.col("expected_return") - risk_free, F.col("volatility"), floor=1e-10))


def risk_contributions(weights: DataFrame, cov: DataFrame) -> DataFrame:
    """Marginal and total risk contribution per position, largest first within its portfolio."""
    d = weights.join(marginal_variance(weights, cov), ["portfolio", "symbol"])
    of_portfolio = Window.partitionBy("portfolio")
    vol = F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("weight") * F.col("sigma_w")).over(of_portfolio)))
    d = d.withColumn("_vol", vol).withColumn("mctr", guarded_ratio(F.col("sigma_w"), F.col("_vol")))
    d = d.withColumn("risk_contribution", F.col("weight") * F.col("mctr"))
    d = d.withColumn("pct_contribution", guarded_ratio(F.col("risk_contribution"), F.col("_vol")))
    rank = F.row_number().over(Window.partitionBy("portfolio").orderBy(F.abs("risk_contribution").desc(), "symbol"))
    return d.withColumn("rank", rank).drop("_vol", "sigma_w")


def equal_weights(symbols: DataFrame) -> DataFrame:
    n = symbols.select("symbol").distinct().agg(F.count(F.lit(1)))
    return symbols.select("symbol").distinct().withColumn("weight", F.lit(1.0) / n.scalar())


def inverse_volatility_weights(mv: DataFrame) -> DataFrame:
    """Weights by 1 / volatility; the volatility of a flat symbol counts as 1e-6."""
    inverse = 1 / F.greatest(F.col("volatility"), F.lit(1e-6))
    return mv.select("symbol", (inverse / mv.agg(F.sum(inverse)).scalar()).alias("weight"))


def volatility_reduction(stats: DataFrame, reference: DataFrame) -> DataFrame:
    """Percent by which each portfolio's volatility is below that of the single reference portfolio."""
    base = reference.select("volatility").scalar()
    return stats.select("portfolio", F.when(base > 0, F.round((1 - F.col("volatility") / base) * 100, 2)).otherwise(0.0).alias("reduction_pct"))


def equilibrium_returns(weights: DataFrame, cov: DataFrame, risk_aversion: float = 2.5) -> DataFrame:
    return marginal_variance(weights, cov).select("portfolio", "symbol", (F.col("sigma_w") * risk_aversion).alias("equilibrium_return"))


def compounded_return(returns: DataFrame) -> DataFrame:
    return returns.groupBy("symbol").agg((F.product(1 + F.col("r")) - 1).alias("asset_return"))


def attribution(weights: DataFrame, asset_returns: DataFrame) -> DataFrame:
    """Contribution of each position and its share of the portfolio return, largest first."""
    d = weights.join(asset_returns, "symbol", "left").na.fill(0.0, ["asset_return"])
    d = d.withColumn("contribution", F.col("weight") * F.col("asset_return"))
    total = F.sum("contribution").over(Window.partitionBy("portfolio"))
    d = d.withColumn("portfolio_return", total)
    d = d.withColumn("pct_contribution", F.when(F.col("portfolio_return") != 0, F.col("contribution") / F.col("portfolio_return")).otherwise(0.0))
    w = Window.partitionBy("portfolio")
    return d.withColumn("rank", F.row_number().over(w.orderBy(F.col("contribution").desc(), "symbol"))).withColumn(
        "rank_from_bottom", F.row_number().over(w.orderBy("contribution", "symbol")))


def extreme_contributors(attributed: DataFrame, k: int = 3) -> DataFrame:
    top = attributed.filter(F.col("rank") <= k).withColumn("side", F.lit("top"))
    bottom = attributed.filter(F.col("rank_from_bottom") <= k).withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom)


# The predefined scenarios.
SAFE_SYMBOLS = ("GLD", "TLT", "SLV")
COV_MULTIPLIER = {"volatility_spike": 2.0}
VAR_QUANTILE = 2.326


def scenario_shocks(symbol: Column, custom: dict[str, float] | None = None) -> dict[str, Column]:
    crypto = is_crypto(symbol)
    shocks = {
        "crypto_crash": F.when(crypto, -0.30).otherwise(-0.05),
        "volatility_spike": F.lit(0.0),
        "flight_to_safety": F.when(symbol.isin(*SAFE_SYMBOLS), 0.10).otherwise(-0.20),
        "btc_halving_rally": F.when(symbol.startswith("BTC"), 0.50).when(crypto, 0.25).otherwise(-0.05),
        "black_swan": F.lit(-0.40),
    }
    if custom:
        shock = F.lit(0.0)
        for name, size in custom.items():
            shock = F.when(symbol == name, size).otherwise(shock)
        shocks["custom"] = shock
    return shocks


def stress_positions(weights: DataFrame, custom: dict[str, float] | None = None) -> DataFrame:
    """Impact of every scenario on every position: each weight row is spread over the scenario list."""
    rows = F.array(*[F.struct(F.lit(n).alias("scenario"), s.alias("shock")) for n, s in scenario_shocks(F.col("symbol"), custom).items()])
    d = weights.select("portfolio", "symbol", "weight", F.explode(rows).alias("_s")).select("portfolio", "symbol", "weight", "_s.*")
    return d.withColumn("impact", F.col("weight") * F.col("shock")).withColumn("stressed_weight", F.col("weight") * (1 + F.col("shock")))


def stress_summary(positions: DataFrame, stats: DataFrame) -> DataFrame:
    by_impact = F.struct("impact", "symbol")
    d = positions.groupBy("portfolio", "scenario").agg(
        F.sum("impact").alias("total_impact"), F.min_by("symbol", by_impact).alias("worst_hit"), F.max_by("symbol", by_impact).alias("best_performer"))
    factor = F.lit(1.0)
    for name, m in COV_MULTIPLIER.items():
        factor = F.when(F.col("scenario") == name, m**0.5).otherwise(factor)
    d = d.join(stats.select("portfolio", "expected_return", "volatility"), "portfolio")
    d = d.withColumn("stressed_return", F.col("expected_return") + F.col("total_impact")).withColumn("stressed_volatility", F.col("volatility") * factor)
    return d.withColumn("value_at_risk_1pct", F.col("stressed_return") - VAR_QUANTILE * F.col("stressed_volatility"))


def rebalance_alerts(current: DataFrame, target: DataFrame, threshold: float, value: float) -> DataFrame:
    d = outer_weights(current, target).withColumn("drift", F.col("current_weight") - F.col("target_weight"))
    d = d.withColumn("alert", F.abs("drift") >= threshold)
    return d.withColumn("action", F.when(F.col("drift") > 0, "SELL").otherwise("BUY")).withColumn("amount_usd", F.abs("drift") * value)


def rebalance_summary(alerts: DataFrame) -> DataFrame:
    n = F.count_if("alert")
    return alerts.agg(
        F.sum(F.abs("drift")).alias("total_drift"), F.coalesce(F.max(F.when(F.col("alert"), F.abs("drift"))), F.lit(0.0)).alias("max_drift"),
        n.alias("n_alerts"), F.count(F.lit(1)).alias("n_symbols"), (n > 0).alias("needs_rebalance"))


def trade_costs(current: DataFrame, target: DataFrame, value: float, fee: float = 0.001, slippage_bps: float = 5.0) -> DataFrame:
    """Fee and slippage of every trade of at least a cent."""
    d = outer_weights(current, target).withColumn("weight_change", F.col("target_weight") - F.col("current_weight"))
    d = d.withColumn("trade_value", F.abs("weight_change") * value).filter("trade_value >= 0.01")
    d = d.withColumn("fee_cost", F.col("trade_value") * fee).withColumn("slippage_cost", F.col("trade_value") * (slippage_bps / 10000))
    d = d.withColumn("total_cost", F.col("fee_cost") + F.col("slippage_cost")).withColumn("cost_pct", F.col("total_cost") / F.col("trade_value"))
    return d.withColumn("action", F.when(F.col("weight_change") > 0, "BUY").otherwise("SELL"))


def cost_summary(trades: DataFrame, value: float) -> DataFrame:
    total = F.coalesce(F.sum("total_cost"), F.lit(0.0))
    return trades.agg(total.alias("total_cost"), F.coalesce(F.sum("trade_value"), F.lit(0.0)).alias("total_turnover"),
                      (total / value).alias("cost_pct_of_portfolio"), F.count(F.lit(1)).alias("n_trades"))


def net_of_costs(stats: DataFrame, cost: Column, rebalances: int) -> DataFrame:
    d = stats.withColumn("annual_cost", cost * rebalances).withColumn("net_return", F.col("expected_return") - F.col("annual_cost"))
    d = d.withColumn("gross_sharpe", guarded_ratio(F.col("expected_return"), F.col("volatility")))
    d = d.withColumn("net_sharpe", guarded_ratio(F.col("net_return"), F.col("volatility")))
    return d.withColumn("sharpe_drag", F.col("gross_sharpe") - F.col("net_sharpe"))


def position_sizes(weights: DataFrame, vols: DataFrame, value: float = 10000.0, target: float = 0.15, risk: float = 0.02) -> DataFrame:
    """Position sizes by plain weight, by volatility target and by fixed fraction at risk, one row per method."""
    d = weights.join(vols.select("symbol", "volatility"), "symbol", "left").na.fill(0.0, ["volatility"])
    v, w = F.col("volatility"), F.col("weight")
    methods = {"weight": w, "vol_target": F.when(v > 0, w * (target / v)).otherwise(0.0),
               "fixed_fractional": F.when(v > 0, risk / (v * 0.1)).otherwise(w)}
    rows = F.array(*[F.struct(F.lit(n).alias("method"), c.alias("adjusted_weight")) for n, c in methods.items()])
    d = d.select("portfolio", "symbol", "weight", F.explode(rows).alias("_m")).select("portfolio", "symbol", "weight", "_m.*")
    return d.withColumn("amount_usd", F.round(F.col("adjusted_weight") * value, 2))


def kelly(returns: DataFrame) -> DataFrame:
    """Kelly fraction and its half from the signs and sizes of returns."""
    win, loss = F.col("r") > 0, F.col("r") < 0
    d = returns.groupBy("symbol").agg(
        F.avg(F.when(win, 1.0).otherwise(0.0)).alias("win_rate"), F.coalesce(F.avg(F.when(win, F.col("r"))), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(F.when(loss, -F.col("r"))), F.lit(0.0)).alias("avg_loss"))
    p, usable = F.col("win_rate"), (F.col("avg_loss") > 0) & (F.col("avg_win") > 0) & (F.col("win_rate") > 0) & (F.col("win_rate") < 1)
    b = F.col("avg_win") / F.col("avg_loss")
    d = d.withColumn("kelly", F.when(usable, clip((p * b - (1 - p)) / b, 0.0, 1.0)).otherwise(0.0))
    return d.withColumn("half_kelly", F.col("kelly") / 2)


def combined_weights(first: DataFrame, second: DataFrame, share: float) -> DataFrame:
    """``share`` of the first portfolio and the rest of the second; a symbol in both keeps the second's entry."""
    a = first.select("symbol", (F.col("weight") * share).alias("weight")).join(second.select("symbol"), "symbol", "left_anti")
    return a.unionByName(second.select("symbol", (F.col("weight") * (1 - share)).alias("weight")))


def blended_stats(stats: DataFrame, first: str, second: str, share: float) -> DataFrame:
    """Return and volatility of a blend of two portfolios that are taken to be uncorrelated."""
    one, two = F.col("portfolio") == first, F.col("portfolio") == second
    part = F.when(one, share).otherwise(1 - share)
    d = stats.filter(one | two).agg(
        F.sum(part * F.col("expected_return")).alias("expected_return"), F.sqrt(F.sum(part * part * F.col("variance"))).alias("volatility"))
    return d.withColumn("sharpe", guarded_ratio(F.col("expected_return"), F.col("volatility")))


def drifted_weights(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """Weights left to drift: period 0 is the target, period t follows t compounded returns."""
    from ..timeline import wealth

    grown = wealth(returns, 1 + F.col("r")).select("symbol", "pos", F.col("value").alias("growth"))
    start = weights.select("symbol").withColumn("pos", F.lit(0).cast("long")).withColumn("growth", F.lit(1.0))
    d = grown.withColumn("pos", F.col("pos").cast("long")).unionByName(start).join(weights, "symbol")
    held = F.col("weight") * F.col("growth")
    total = F.sum(held).over(Window.partitionBy("pos"))
    return d.select("symbol", F.col("pos").alias("period"), F.col("weight").alias("target_weight"), guarded_ratio(held, total).alias("drifted_weight"))


def drift_deviation(drifted: DataFrame) -> DataFrame:
    gap = F.col("drifted_weight") - F.col("target_weight")
    return drifted.groupBy("period").agg(F.sqrt(F.sum(gap * gap)).alias("tracking_error"), F.max(F.abs(gap)).alias("max_deviation"))


def periods_to_threshold(deviation: DataFrame, threshold: float = 0.05) -> DataFrame:
    over = F.col("max_deviation") > threshold
    first, last = F.min(F.when(over, F.col("period"))), F.max("period")
    at = F.coalesce(F.min_by("max_deviation", F.when(over, F.col("period"))), F.max_by("max_deviation", "period"))
    return deviation.agg(F.coalesce(first, last).alias("periods_to_threshold"), at.alias("max_drift_at_threshold"))


def evaluate(weights: DataFrame, mu: DataFrame, cov: DataFrame, risk_free: float = 0.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(totals, contributions, unknown symbols) of given portfolios; totals fail where weights do not sum to 1."""
    unknown = weights.join(mu.select("symbol"), "symbol", "left_anti")
    stats = portfolio_stats(weights, mu, cov, risk_free)
    ok = F.when(F.col("weights_ok"), F.col("expected_return")).otherwise(
        F.raise_error(F.concat(F.lit("weights do not sum to 1: "), F.col("portfolio"))).cast("double"))
    return stats.withColumn("expected_return", ok), risk_contributions(weights, cov).join(mu.select("symbol", "mean_return"), "symbol"), unknown
