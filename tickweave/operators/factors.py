"""Market, momentum and volatility factors, and the regression of each symbol on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clip
from ..timeline import trailing


def _half_split(scored: DataFrame, ascending: bool, out: str) -> DataFrame:
    """Mean return of the first half by score minus that of the rest, by date; 0 with fewer than two symbols.

    The window is one date's symbols, so its size is the universe, whatever the history of any symbol.
    """
    score = F.col("score") if ascending else -F.col("score")
    w = Window.partitionBy("ts", "pos").orderBy(score, "symbol")
    all_of_date = Window.partitionBy("ts", "pos")
    d = scored.withColumn("_k", F.row_number().over(w)).withColumn("_half", F.floor(F.count(F.lit(1)).over(all_of_date) / 2))
    first = F.col("_k") <= F.col("_half")
    value = F.avg(F.when(first, F.col("s"))) - F.avg(F.when(~first, F.col("s")))
    return d.groupBy("ts", "pos").agg(F.coalesce(value, F.lit(0.0)).alias(out))


def momentum_factor(returns: DataFrame, window: int = 20) -> DataFrame:
    """Winners minus losers by compounded return over the ``window`` periods before each date."""
    d = trailing(returns, window, lambda w: {"score": F.product(1 + F.col("s")).over(w.rowsBetween(-window, -1)) - 1})
    return _half_split(d.filter(F.col("pos") > window), False, "momentum")


def volatility_factor(returns: DataFrame, window: int = 20) -> DataFrame:
    """Calm minus volatile symbols by sample deviation over the ``window`` periods before each date."""
    d = trailing(returns, window, lambda w: {"score": F.stddev_samp("s").over(w.rowsBetween(-window, -1))})
    return _half_split(d.filter(F.col("pos") > window), True, "volatility")


def factor_table(returns: DataFrame, window: int = 20) -> DataFrame:
    market = returns.groupBy("ts", "pos").agg(F.avg("s").alias("market"))
    return market.join(momentum_factor(returns, window), ["ts", "pos"]).join(volatility_factor(returns, window), ["ts", "pos"])


def _det3(m: list[list[Column]]) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def regress_on_three(data: DataFrame, y: str, factors: Sequence[str], key: str = "symbol") -> DataFrame:
    """Least squares of ``y`` on an intercept and three columns, per key, from one pass of covariances.

    The centred normal equations are 3x3, so each coefficient is a ratio of two determinants.
    """
    f = list(factors)
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(y).alias("_my"), F.var_pop(y).alias("_vy")]
    for i, a in enumerate(f):
        aggs += [F.avg(a).alias(f"_m{i}"), F.covar_pop(a, y).alias(f"_y{i}")]
        aggs += [F.covar_pop(a, f[j]).alias(f"_c{i}{j}") for j in range(i, 3)]
    d = data.groupBy(key).agg(*aggs).filter("n >= 4")
    c = [[F.col(f"_c{min(i, j)}{max(i, j)}") for j in range(3)] for i in range(3)]
    det = _det3(c)
    beta = []
    for k in range(3):
        swapped = [[F.col(f"_y{i}") if j == k else c[i][j] for j in range(3)] for i in range(3)]
        beta.append(_det3(swapped) / det)
    d = d.filter(det != 0).select("*", *[b.alias(f"beta_{n}") for b, n in zip(beta, f, strict=True)])
    fitted, shift = F.lit(0.0), F.col("_my")
    for i, n in enumerate(f):
        fitted = fitted + F.col(f"beta_{n}") * F.col(f"_y{i}")
        shift = shift - F.col(f"beta_{n}") * F.col(f"_m{i}")
    r2 = F.when(F.col("_vy") * F.col("n") > 1e-15, clip(fitted / F.col("_vy"), 0.0, 1.0)).otherwise(0.0)
    left = F.greatest(F.lit(0.0), F.col("_vy") - fitted) * F.col("n")
    return d.select(
        key, shift.alias("alpha"), *[f"beta_{n}" for n in f], r2.alias("r_squared"),
        F.when(F.col("n") > 4, F.sqrt(left / (F.col("n") - 4))).otherwise(0.0).alias("residual_std"), "n")


FACTORS = ("market", "momentum", "volatility")


def factor_model(returns: DataFrame, window: int = 20) -> DataFrame:
    data = returns.select("symbol", "ts", "s").join(factor_table(returns, window), "ts")
    return regress_on_three(data, "s", FACTORS)
