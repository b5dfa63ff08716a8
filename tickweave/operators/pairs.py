"""Cointegration of symbol pairs and their spread signals; all pairs go through one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import reuse
from ..timeline import running, trailing
from .align import symbol_pairs

PAIR = ("symbol_a", "symbol_b")
CRITICAL = -3.34  # fixed value: 5 % critical value of the residual test


def price_index(priced: DataFrame, base: float = 100.0) -> DataFrame:
    """Prices rebuilt from returns by compounding, ``base`` on the first date."""
    growth = 1 + F.coalesce(F.col("r"), F.lit(0.0))
    return running(priced, {"price": ("product", growth)}).withColumn("price", F.col("price") * base)


def fitted_pairs(pairs: DataFrame) -> DataFrame:
    """Slope and intercept of a on b per pair, for pairs of 3 rows or more whose b varies."""
    return pairs.groupBy(*PAIR).agg(
        F.regr_slope("x_a", "x_b").alias("slope"), F.regr_intercept("x_a", "x_b").alias("intercept"),
        F.count(F.lit(1)).alias("n"), F.var_pop("x_b").alias("_v")).filter("n >= 3 and _v > 0").drop("_v")


def residuals(pairs: DataFrame, fits: DataFrame) -> DataFrame:
    d = pairs.join(fits, list(PAIR))
    return d.withColumn("residual", F.col("x_a") - F.col("intercept") - F.col("slope") * F.col("x_b"))


def unit_root_statistic(series: DataFrame, value: str = "residual", key: tuple[str, ...] = PAIR) -> DataFrame:
    """t statistic of the regression of changes on levels, with intercept and no lags."""
    d = trailing(series, 1, lambda w: {"_lag": F.lag(value).over(w)}, key=key)
    d = d.filter("_lag is not null").withColumn("_d", F.col(value) - F.col("_lag"))
    s = d.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_m"), F.regr_sxx("_d", "_lag").alias("_sxx"), F.regr_sxy("_d", "_lag").alias("_sxy"),
        F.regr_syy("_d", "_lag").alias("_syy"))
    slope = F.col("_sxy") / F.col("_sxx")
    s2 = F.greatest(F.lit(0.0), F.col("_syy") - slope * F.col("_sxy")) / (F.col("_m") - 2)
    usable = (F.col("_sxx") > 0) & (F.col("_m") > 2)
    t = F.when(usable, F.when(s2 > 0, slope / F.sqrt(s2 / F.col("_sxx"))).otherwise(0.0)).otherwise(0.0)
    return s.select(*key, t.alias("statistic"))


def lagged_moments(rows: DataFrame, value: str = "price") -> DataFrame:
    """Per pair of an aligned panel: n, slope and intercept of a on b, and the centred second moments of levels and changes.

    Lags are taken per symbol, before the join by date; the pairs' sums are folded in the join's stage, so no row of a pair is
    shuffled or sorted. ``al``, ``bl`` are the levels before a change, ``da``, ``db`` the changes, ``m`` their number.
    """
    d = trailing(rows, 1, lambda w: {"_lag": F.lag(value).over(w)})
    d = d.select("symbol", "ts", F.col(value).alias("x"), F.col("_lag").alias("l"), (F.col(value) - F.col("_lag")).alias("d"))
    a, b = (d.select("ts", *[F.col(c).alias(n) for c, n in (("symbol", f"symbol_{s}"), ("x", f"x_{s}"), ("l", f"{s}l"), ("d", f"d{s}"))]) for s in "ab")
    both = F.col("da").isNotNull() & F.col("db").isNotNull()
    names = ("al", "bl", "da", "db")
    moments = [F.covar_pop(F.when(both, F.col(p)), F.when(both, F.col(q))).alias(f"{p}_{q}") for i, p in enumerate(names) for q in names[i:]]
    return a.join(b, "ts").where("symbol_a < symbol_b").groupBy(*PAIR).agg(
        F.regr_slope("x_a", "x_b").alias("slope"), F.regr_intercept("x_a", "x_b").alias("intercept"), F.count(F.lit(1)).alias("n"),
        F.var_pop("x_b").alias("_v"), F.count_if(both).alias("m"), *moments).filter("n >= 3 and _v > 0").drop("_v")


def residual_statistic(d: DataFrame) -> DataFrame:
    """Adds ``statistic``, the unit-root test of a - intercept - slope * b, in closed form from `lagged_moments`."""
    s, c = F.col("slope"), F.col
    level = F.greatest(F.lit(0.0), c("al_al") - 2 * s * c("al_bl") + s * s * c("bl_bl"))
    change = F.greatest(F.lit(0.0), c("da_da") - 2 * s * c("da_db") + s * s * c("db_db"))
    cross = c("al_da") - s * (c("bl_da") + c("al_db")) + s * s * c("bl_db")
    d = d.withColumns({"_sxx": c("m") * level, "_sxy": c("m") * cross, "_syy": c("m") * change})
    slope = F.try_divide("_sxy", "_sxx")
    s2 = F.greatest(F.lit(0.0), F.col("_syy") - slope * F.col("_sxy")) / (F.col("m") - 2)
    t = F.when((F.col("_sxx") > 0) & (F.col("m") > 2), F.when(s2 > 0, slope / F.sqrt(s2 / F.col("_sxx"))).otherwise(0.0)).otherwise(0.0)
    return d.withColumn("statistic", t).drop("_sxx", "_sxy", "_syy")


def cointegrated_pairs(priced: DataFrame, min_rows: int = 50) -> DataFrame:
    """Residual test of every pair of an aligned panel on rebuilt prices, most stationary first."""
    fits = lagged_moments(reuse(price_index(priced))).filter(F.col("n") >= min_rows)
    return residual_statistic(fits).select(
        *PAIR, F.col("statistic").alias("adf_statistic"), F.col("slope").alias("hedge_ratio"),
        (F.col("statistic") < CRITICAL).alias("is_cointegrated")).orderBy("adf_statistic")


def spreads(priced: DataFrame, hedges: DataFrame) -> DataFrame:
    """close_a - hedge_ratio * close_b per pair and date."""
    d = symbol_pairs(priced, "close").join(hedges.select(*PAIR, "hedge_ratio"), list(PAIR))
    return d.withColumn("spread", F.col("x_a") - F.col("hedge_ratio") * F.col("x_b"))


def spread_signals(spread: DataFrame, window: int = 20, keep: int | None = 10) -> DataFrame:
    """Rolling z-score and its signal; the last ``keep`` rows per pair. 0 and neutral until the window is full."""
    def f(w):
        return w.rowsBetween(-(window - 1), 0)

    d = trailing(spread, window - 1, lambda w: {"_m": F.avg("spread").over(f(w)), "_sd": F.stddev_samp("spread").over(f(w))}, key=PAIR)
    full = (F.col("pos") >= window) & (F.col("_sd") > 0)
    d = d.withColumn("z_score", F.when(full, (F.col("spread") - F.col("_m")) / F.col("_sd")).otherwise(0.0))
    z = F.col("z_score")
    d = d.withColumn("signal", F.when(z < -2, "long").when(z > 2, "short").otherwise("neutral"))
    if keep is not None:
        last = spread.groupBy(*PAIR).agg(F.max("pos").alias("_n"))
        d = d.join(last, list(PAIR)).filter(F.col("pos") > F.col("_n") - keep)
    return d.select(*PAIR, "ts", (F.col("pos") - 1).alias("period"), "z_score", "signal")
