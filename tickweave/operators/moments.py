"""Means, variances, and the covariance and correlation matrices as long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import guarded_ratio
from ..session import reuse
from ..timeline import trailing
from .align import symbol_pairs


def mean_vol(returns: DataFrame, periods: int, value: str = "r") -> DataFrame:
    """Annualised mean and sample volatility per symbol."""
    return returns.groupBy("symbol").agg(
        (F.avg(value) * periods).alias("mean_return"), (F.stddev_samp(value) * periods**0.5).alias("volatility")
    )


def risk_return(returns: DataFrame, periods: int) -> DataFrame:
    mv = mean_vol(returns, periods)
    return mv.withColumn("sharpe", guarded_ratio(F.col("mean_return"), F.col("volatility"), floor=1e-10))


def _matrix(pairs: DataFrame, value: Column) -> DataFrame:
    return pairs.groupBy(F.col("symbol_a").alias("symbol_row"), F.col("symbol_b").alias("symbol_col")).agg(
        value.alias("value")
    )


def covariance(returns: DataFrame, periods: int) -> DataFrame:
    """All n*n annualised sample covariances; pair rows are folded before the shuffle."""
    return _matrix(symbol_pairs(returns, ordered=False), F.covar_samp("x_a", "x_b") * periods)


def pair_correlation() -> Column:
    """Sample correlation of x_a and x_b as an aggregate that gives 0 for a side that does not vary."""
    both = F.stddev_pop("x_a") * F.stddev_pop("x_b")
    return guarded_ratio(F.covar_pop("x_a", "x_b"), both)


def correlation(returns: DataFrame) -> DataFrame:
    """Sample correlations: diagonal 1, and 0 where a symbol does not vary."""
    out = _matrix(symbol_pairs(returns, ordered=False), pair_correlation())
    return out.withColumn("value", F.when(F.col("symbol_row") == F.col("symbol_col"), 1.0).otherwise(F.col("value")))


def shrunk_covariance(returns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sample covariance blended with a constant-correlation target: (matrix, intensity).

    Two passes of sums over the pair rows give the sample covariance and the variance of each product; the
    intensity is one row.
    """
    means = returns.groupBy("symbol").agg(F.avg("r").alias("m"))
    centred = returns.join(means, "symbol").withColumn("d", F.col("r") - F.col("m"))
    p = F.col("x_a") * F.col("x_b")
    n = F.count(F.lit(1))
    cov = symbol_pairs(centred, "d", ordered=False).groupBy("symbol_a", "symbol_b").agg(
        n.alias("n"), (F.sum(p) / (n - 1)).alias("s"), F.sum(p).alias("sp"), F.sum(p * p).alias("spp"))
    cov = reuse(cov)
    var = cov.filter("symbol_a = symbol_b")
    va = var.select("symbol_a", F.col("s").alias("va"))
    vb = var.select("symbol_b", F.col("s").alias("vb"))
    both = cov.join(va, "symbol_a").join(vb, "symbol_b").withColumn("sd", F.sqrt(F.col("va") * F.col("vb")))
    off = F.when((F.col("symbol_a") < F.col("symbol_b")) & (F.col("sd") > 0), F.col("s") / F.col("sd"))
    target_corr = both.agg(F.coalesce(F.avg(off), F.lit(0.0)))
    t = F.when(F.col("symbol_a") == F.col("symbol_b"), F.col("s")).otherwise(F.col("sd") * target_corr.scalar())
    both = both.withColumn("target", t)
    pi = (F.col("spp") - 2 * F.col("s") * F.col("sp") + F.col("n") * F.col("s") * F.col("s")) / F.col("n")
    gamma = F.sum(F.pow(F.col("target") - F.col("s"), 2))
    delta = F.when(gamma == 0, 0.0).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sum(pi) / (F.max("n") * gamma))))
    intensity = both.agg(delta.alias("shrinkage"), F.max("n").alias("n_observations"))
    d = intensity.select("shrinkage").scalar()
    matrix = both.select(
        F.col("symbol_a").alias("symbol_row"), F.col("symbol_b").alias("symbol_col"), F.col("s").alias("sample"), "target",
        (d * F.col("target") + (1 - d) * F.col("s")).alias("value"))
    return matrix, intensity


def correlation_edges(corr: DataFrame, threshold: float = 0.3) -> DataFrame:
    return corr.filter((F.col("symbol_row") < F.col("symbol_col")) & (F.abs("value") >= threshold)).withColumn(
        "sign", F.when(F.col("value") > 0, "positive").otherwise("negative"))


def correlation_distance(corr: DataFrame) -> DataFrame:
    c = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("value")))
    return corr.withColumn("value", F.sqrt((1 - c) * 0.5))


PAIR = ("symbol_a", "symbol_b")


def _pair_moments(w, n: int) -> dict[str, Column]:
    f = w.rowsBetween(-(n - 1), 0)
    a, b = F.col("x_a"), F.col("x_b")
    return {"_ma": F.avg(a).over(f), "_mb": F.avg(b).over(f), "_cov_p": F.covar_pop(a, b).over(f),
            "_va_p": F.var_pop(a).over(f), "_vb_p": F.var_pop(b).over(f)}


def rolling_correlation(returns: DataFrame, window: int) -> DataFrame:
    """Sample correlation over full windows, null before; 0 where a side does not vary."""
    if window < 2:
        raise ValueError("window must be at least 2")
    d = trailing(symbol_pairs(returns), window - 1, lambda w: _pair_moments(w, window), key=PAIR)
    c = F.when((F.col("_va_p") > 0) & (F.col("_vb_p") > 0), F.col("_cov_p") / F.sqrt(F.col("_va_p") * F.col("_vb_p"))).otherwise(0.0)
    return d.select("symbol_a", "symbol_b", "ts", F.when(F.col("pos") >= window, c).alias("correlation"))


def rolling_correlation_pop(returns: DataFrame, window: int, default: float | None = 0.0) -> DataFrame:
    """Population form; ``default`` where the product of deviations is 1e-10 or less."""
    d = trailing(symbol_pairs(returns), window - 1, lambda w: _pair_moments(w, window), key=PAIR)
    den = F.sqrt(F.col("_va_p") * F.col("_vb_p"))
    c = guarded_ratio(F.col("_cov_p"), den, default=default, floor=1e-10)
    return d.select("symbol_a", "symbol_b", "ts", "pos", F.when(F.col("pos") >= window, c).alias("correlation"))


def rolling_correlation_drifting(returns: DataFrame, window: int) -> DataFrame:
    """Variant in which each row keeps the window mean it had itself; partial windows count."""
    def f(w):
        return w.rowsBetween(-(window - 1), 0)

    d = trailing(symbol_pairs(returns), window - 1, lambda w: {
        "_da": F.col("x_a") - F.avg("x_a").over(f(w)), "_db": F.col("x_b") - F.avg("x_b").over(f(w))}, key=PAIR)
    d = trailing(d, window - 1, lambda w: {
        "_c": F.avg(F.col("_da") * F.col("_db")).over(f(w)), "_sa": F.sqrt(F.avg(F.col("_da") * F.col("_da")).over(f(w))),
        "_sb": F.sqrt(F.avg(F.col("_db") * F.col("_db")).over(f(w)))}, key=PAIR)
    c = F.when((F.col("_sa") > 0) & (F.col("_sb") > 0), F.col("_c") / (F.col("_sa") * F.col("_sb")))
    return d.select("symbol_a", "symbol_b", "ts", c.alias("correlation"))


def mean_pair_correlation(returns: DataFrame, window: int) -> DataFrame:
    """Mean of all pairs' rolling correlations by date, leaving out pairs that do not vary."""
    c = rolling_correlation_pop(returns, window, default=None)
    return c.groupBy("ts").agg(F.avg("correlation").alias("mean_correlation"))
