"""Distribution and tail-risk measures per entity (symbol or portfolio)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import guarded_ratio, normal_density, normal_quantile
from ..timeline import lowest_mean, nth, running, value_ladder, wealth

NORMAL_LIMIT = 5.991  # fixed value: chi-squared with 2 degrees of freedom at 95 %


def _n() -> Column:
    return F.count("r")


def population_shape(r: DataFrame, key: str = "symbol") -> DataFrame:
    """Population skewness and excess kurtosis; 0 for series that hardly vary or are too short."""
    flat = F.stddev_pop("r") < 1e-10
    return r.groupBy(key).agg(
        F.when((_n() < 3) | flat, 0.0).otherwise(F.skewness("r")).alias("skewness"),
        F.when((_n() < 4) | flat, 0.0).otherwise(F.kurtosis("r")).alias("excess_kurtosis"),
    )


def sample_shape(r: DataFrame, key: str = "symbol") -> DataFrame:
    """Bias-adjusted skewness (3 rows or more) and excess kurtosis (4 or more), and the normality statistic."""
    d = r.groupBy(key).agg(
        _n().alias("n"), F.stddev_samp("r").alias("_sd"), F.skewness("r").alias("_g1"), F.kurtosis("r").alias("_g2")
    )
    n = F.col("n")
    skew = F.when(n >= 3, F.when(F.col("_sd") == 0, 0.0).otherwise(F.sqrt(n * (n - 1)) / (n - 2) * F.col("_g1")))
    kurt = F.when(n >= 4, F.when(F.col("_sd") == 0, 0.0).otherwise(
        (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("_g2") + 6)))
    d = d.withColumn("skewness", skew).withColumn("excess_kurtosis", kurt)
    jb = n / 6 * (F.pow("skewness", F.lit(2)) + F.pow("excess_kurtosis", F.lit(2)) / 4)
    return d.withColumn("jarque_bera", jb).withColumn("is_normal", jb <= NORMAL_LIMIT).drop("_sd", "_g1", "_g2")


def omega(r: DataFrame, threshold: float = 0.0, key: str = "symbol") -> DataFrame:
    x = F.col("r") - threshold
    up = F.sum(F.when(x > 0, x).otherwise(0.0))
    down = F.sum(F.when(x < 0, -x).otherwise(0.0))
    ratio = F.when(down > 0, up / down).when(up > 0, F.lit(float("inf"))).otherwise(0.0)
    return r.groupBy(key).agg(ratio.alias("omega"))


def downside(r: DataFrame, risk_free: float, periods: int, key: str = "symbol") -> DataFrame:
    """Downside and upside deviation around the per-period risk-free rate, the ratio on them, and counts."""
    rf = risk_free / periods
    below = F.pow(F.greatest(F.lit(0.0), rf - F.col("r")), F.lit(2))
    above = F.pow(F.greatest(F.lit(0.0), F.col("r") - rf), F.lit(2))
    pain = F.abs(F.sum(F.when(F.col("r") < 0, F.col("r")).otherwise(0.0)))
    total = F.sum("r")
    d = r.groupBy(key).agg(
        (F.sqrt(F.avg(below)) * periods**0.5).alias("downside_deviation"),
        (F.sqrt(F.avg(above)) * periods**0.5).alias("upside_deviation"),
        (F.avg("r") * periods - risk_free).alias("_excess"),
        F.when(pain > 0, total / pain).when(total == 0, 0.0).otherwise(F.lit(float("inf"))).alias("gain_to_pain"),
        _n().alias("n_periods"), F.count_if(F.col("r") < 0).alias("n_negative"), F.count_if(F.col("r") > 0).alias("n_positive"),
        F.min("r").alias("worst_return"), F.max("r").alias("best_return"),
    )
    return d.withColumn("sortino_ratio", guarded_ratio(F.col("_excess"), F.col("downside_deviation"))).drop("_excess")


def capture(both: DataFrame, key: list[str]) -> DataFrame:
    """Up and down capture of ``p`` against benchmark ``b``."""
    def side(cond: Column) -> Column:
        mine, other = F.avg(F.when(cond, F.col("p"))), F.avg(F.when(cond, F.col("b")))
        return F.coalesce(F.when(other != 0, mine / other), F.lit(0.0))

    return both.groupBy(*key).agg(side(F.col("b") > 0).alias("upside_capture"), side(F.col("b") < 0).alias("downside_capture"))


def alpha_beta(both: DataFrame, risk_free: float, periods: int, key: list[str]) -> DataFrame:
    """Regression of portfolio excess returns on benchmark excess returns, tracking error, information ratio."""
    d = both.groupBy(*key).agg(
        F.covar_samp("p", "b").alias("_c"), F.var_samp("p").alias("_vp"), F.var_samp("b").alias("_vb"),
        F.avg("p").alias("_mp"), F.avg("b").alias("_mb"), F.stddev_samp(F.col("p") - F.col("b")).alias("_te"),
        F.count(F.lit(1)).alias("n_periods"),
    )
    rf = risk_free / periods
    d = d.withColumn("beta", guarded_ratio(F.col("_c"), F.col("_vb")))
    d = d.withColumn("alpha_annual", ((F.col("_mp") - rf) - F.col("beta") * (F.col("_mb") - rf)) * periods)
    both_vary = (F.col("_vp") > 0) & (F.col("_vb") > 0)
    d = d.withColumn("r_squared", F.when(both_vary, F.col("_c") * F.col("_c") / (F.col("_vp") * F.col("_vb"))).otherwise(0.0))
    d = d.withColumn("tracking_error", F.col("_te") * periods**0.5)
    d = d.withColumn("information_ratio", guarded_ratio(F.col("alpha_annual"), F.col("tracking_error")))
    return d.drop("_c", "_vp", "_vb", "_mp", "_mb", "_te")


def market_beta(returns: DataFrame, market: DataFrame) -> DataFrame:
    """Population beta to the market; 1 where the market does not vary or rows are too few."""
    d = returns.join(market.select("ts", "m"), "ts").groupBy("symbol").agg(
        F.covar_pop("r", "m").alias("_c"), F.var_pop("m").alias("_v"), F.count(F.lit(1)).alias("_n"))
    return d.select("symbol", F.when((F.col("_n") >= 2) & (F.col("_v") > 1e-10), F.col("_c") / F.col("_v")).otherwise(1.0).alias("beta"))


def value_at_risk(r: DataFrame, confidence: float = 0.95, key: str = "symbol") -> DataFrame:
    """Historical, parametric and moment-adjusted VaR and CVaR side by side, for entities with 4 rows or more.

    Order statistics come from a ladder of distinct values, so no entity is sorted in one task.
    """
    tail = 1.0 - confidence
    ladder = value_ladder(r, "r", key=(key,))
    raw = F.floor(F.col("size") * tail)
    index = F.least(F.greatest(raw, F.lit(0)), F.col("size") - 1)
    count = F.least(F.greatest(raw, F.lit(1)), F.col("size"))
    m = r.groupBy(key).agg(
        _n().alias("n_observations"), F.avg("r").alias("_m"), F.stddev_samp("r").alias("_sd"),
        F.skewness("r").alias("_s"), F.kurtosis("r").alias("_k")).filter("n_observations >= 4")
    z = normal_quantile(F.lit(confidence))
    m = m.withColumn("parametric_var", -(F.col("_m") - z * F.col("_sd"))).withColumn(
        "parametric_cvar", -(F.col("_m") - F.col("_sd") * normal_density(z) / tail))
    s, k = F.coalesce(F.col("_s"), F.lit(0.0)), F.coalesce(F.col("_k"), F.lit(0.0))
    zc = z + (z * z - 1) * s / 6 + (z * z * z - 3 * z) * k / 24 - (2 * z * z * z - 5 * z) * s * s / 36
    m = m.withColumn("cornish_fisher_var", F.when(F.col("_sd") == 0, -F.col("_m")).otherwise(-(F.col("_m") - zc * F.col("_sd"))))
    beyond = F.col("r") <= -F.col("cornish_fisher_var")
    ordered = ladder.join(m.select(key, "cornish_fisher_var"), key).groupBy(key).agg(
        (-nth("r", index)).alias("historical_var"), (-lowest_mean("r", count)).alias("historical_cvar"),
        F.sum(F.when(beyond, F.col("r") * F.col("n"))).alias("_ts"), F.sum(F.when(beyond, F.col("n"))).alias("_tn"))
    out = m.join(ordered, key)
    out = out.withColumn("cornish_fisher_cvar", F.coalesce(-F.col("_ts") / F.col("_tn"), F.col("cornish_fisher_var")))
    return out.drop("_m", "_sd", "_s", "_k", "_ts", "_tn")


def charted_var(r: DataFrame, confidence: float = 0.95, key: str = "symbol") -> DataFrame:
    """Signed variant with index max(0, int(n*(1-c)) - 1), whose tail includes that row; 0 below 5 rows."""
    ladder = value_ladder(r, "r", key=(key,))
    index = F.greatest(F.lit(0), F.floor(F.col("size") * (1 - confidence)) - 1)
    enough = F.max("size") >= 5
    return ladder.groupBy(key).agg(
        F.when(enough, nth("r", index)).otherwise(0.0).alias("var"),
        F.when(enough, lowest_mean("r", index + 1)).otherwise(0.0).alias("cvar"))


def histogram(r: DataFrame, bins: int = 40, key: str = "symbol", value: str = "s") -> DataFrame:
    """Counts in ``bins`` equal bins between the smallest and the largest value."""
    span = r.groupBy(key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    at = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)).otherwise(0)
    return r.join(span, key).select(key, F.least(at, F.lit(bins - 1)).alias("bin")).groupBy(key, "bin").agg(F.count(F.lit(1)).alias("n"))


def median(df: DataFrame, value: str, key: str = "symbol") -> DataFrame:
    n = F.col("size")
    mid = (nth(value, F.floor((n - 1) / 2)) + nth(value, F.floor(n / 2))) / 2
    return value_ladder(df, value, key=(key,)).groupBy(key).agg(mid.alias("median"))


def compounded_drawdown(r: DataFrame, key: str = "symbol") -> DataFrame:
    """Largest fall of the compounded wealth below its peak; wealth and peak start at 1."""
    return _deepest(wealth(r, 1 + F.col("r"), key=(key,)), key)


def _deepest(path: DataFrame, key: str) -> DataFrame:
    fall = (F.col("peak") - F.col("value")) / F.col("peak")
    return path.groupBy(key).agg(F.greatest(F.lit(0.0), F.max(fall)).alias("max_drawdown"))


def log_drawdown(r: DataFrame, key: str = "symbol") -> DataFrame:
    """The same on the curve exp(sum of returns)."""
    return _deepest(wealth(r, F.exp("r"), key=(key,)), key)


def calmar(r: DataFrame, periods: int, key: str = "symbol") -> DataFrame:
    d = compounded_drawdown(r, key).join(r.groupBy(key).agg((F.avg("r") * periods).alias("annual_return")), key)
    return d.withColumn("calmar", guarded_ratio(F.col("annual_return"), F.col("max_drawdown")))


def cumulative_curve(r: DataFrame, key: str = "symbol") -> DataFrame:
    return running(r, {"_cum": ("sum", F.col("r"))}, key=(key,)).withColumn("cumulative", F.exp("_cum") - 1).drop("_cum")


def rebased(bars: DataFrame) -> DataFrame:
    """Close over the first close; symbols whose first close is 0 are left out."""
    first = bars.groupBy("symbol").agg(F.min_by("close", "ts").alias("_first")).filter("_first <> 0")
    return bars.join(first, "symbol").withColumn("rebased", F.col("close") / F.col("_first")).drop("_first")
