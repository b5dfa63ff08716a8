"""Walk-forward evaluation: strategies, windows and baselines are columns of one job."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import guarded_ratio
from ..session import shared_dir
from ..timeline import running, wealth
from . import grid as G
from .align import symbol_pairs
from .comoments import in_windows, merged, state
from .simplex import search_weights


def _n_windows(n: Column, train: int, test: int) -> Column:
    short = F.concat(F.lit("too few dates: "), n.cast("string"), F.lit(f", need {train + test}"))
    return F.when(n >= train + test, F.floor((n - train - test) / test) + 1).otherwise(F.raise_error(short).cast("bigint"))


def train_membership(dates: DataFrame, train: int, test: int, *, skip_first: bool = False) -> DataFrame:
    """Each date (``pos`` from 1) with every training window that holds it, by arithmetic on the position.

    ``skip_first`` leaves out a window's first date, whose return reaches outside the window.
    """
    count = _n_windows(dates.agg(F.max("pos")).scalar(), train, test)
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - train) / test))
    last = F.least(count - 1, F.floor((F.col("pos") - (2 if skip_first else 1)) / test))
    return dates.withColumn("window_id", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))


def test_membership(dates: DataFrame, train: int, test: int, *, skip_first: bool = False) -> DataFrame:
    count = _n_windows(dates.agg(F.max("pos")).scalar(), train, test)
    offset = F.col("pos") - train - 1
    d = dates.withColumn("window_id", F.floor(offset / test)).filter((offset >= 0) & (F.col("window_id") < count))
    return d.filter(offset % test > 0) if skip_first else d


def windows(dates: DataFrame, train: int, test: int) -> DataFrame:
    a = train_membership(dates, train, test).groupBy("window_id").agg(F.min("ts").alias("train_start"), F.max("ts").alias("train_end"))
    b = test_membership(dates, train, test).groupBy("window_id").agg(F.min("ts").alias("test_start"), F.max("ts").alias("test_end"))
    return a.join(b, "window_id")


def window_moments(priced: DataFrame, train: int, test: int, periods: int) -> tuple[DataFrame, DataFrame]:
    """Annualised means and covariances per training window, from the returns inside the window.

    Rows are folded to centred states of panes between the windows' ends; windows merge the states of their panes.
    """
    count = _n_windows(priced.agg(F.max("pos")).scalar(), train, test)
    pane, inside = in_windows(priced, train, test, count)
    known = priced.where(F.col("r").isNotNull())
    alone = known.groupBy("symbol", pane.alias("_pane")).agg(*state("r", "r"))
    mu = merged(alone.withColumn("window_id", F.explode(inside)), ["window_id", "symbol"]).select(
        "window_id", "symbol", (F.col("ma") * periods).alias("mean_return"), (F.sqrt(_sample("caa")) * periods**0.5).alias("volatility"))
    pairs = symbol_pairs(known, ordered=False).where("symbol_a <= symbol_b").groupBy("symbol_a", "symbol_b", pane.alias("_pane")).agg(*state("x_a", "x_b"))
    cov = merged(pairs.withColumn("window_id", F.explode(inside)), ["window_id", "symbol_a", "symbol_b"])
    both = F.array(F.struct(F.col("symbol_a").alias("symbol_row"), F.col("symbol_b").alias("symbol_col")), F.struct(F.col("symbol_b").alias("symbol_row"), F.col("symbol_a").alias("symbol_col")))
    orders = F.explode(F.slice(both, F.lit(1), F.when(F.col("symbol_a") == F.col("symbol_b"), 1).otherwise(2))).alias("_p")
    return mu, cov.select("window_id", orders, (_sample("cab") * periods).alias("value")).select("window_id", "_p.*", "value")


def _sample(total: str) -> Column:
    return F.try_divide(total, F.when(F.col("n") > 1, F.col("n") - 1))


def rule_weights(mu: DataFrame, rule: str) -> DataFrame:
    """Weights per window by a rule that needs no search."""
    w = Window.partitionBy("window_id")
    inverse = 1 / F.greatest(F.col("volatility"), F.lit(1e-6))  # a flat symbol counts as nearly flat
    share = {"equal_weight": F.lit(1.0) / F.count(F.lit(1)).over(w), "inverse_volatility": inverse / F.sum(inverse).over(w)}
    if rule not in share:
        raise ValueError(f"unknown rule {rule!r}; known: {', '.join(share)}")
    return mu.select("window_id", F.lit(rule).alias("strategy"), "symbol", share[rule].alias("weight"))


def benchmark_weights(mu: DataFrame, contains: str) -> DataFrame:
    """All weight on the first symbol whose name holds ``contains``, else on the first symbol."""
    order = F.struct(F.when(F.col("symbol").contains(contains), 0).otherwise(1), F.col("symbol"))
    return mu.groupBy("window_id").agg(F.min_by("symbol", order).alias("symbol")).select(
        "window_id", F.lit("benchmark").alias("strategy"), "symbol", F.lit(1.0).alias("weight"))


def grid_weights(mu: DataFrame, cov: DataFrame, k: int, units: int, objectives: list[str], risk_free: float = 0.05) -> DataFrame:
    u = G.universe(mu, cov, ["window_id"])
    chosen = G.best(G.scored(G.candidates(u, k, units), k, units, risk_free), ["window_id"], objectives)
    return G.weights_of(chosen.withColumnRenamed("objective", "strategy"), units, ["window_id", "strategy"])


#: A strategy makes weights (window_id, symbol, weight) of means and covariances per window.
STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    "equal_weight": lambda mu, cov, **_: rule_weights(mu, "equal_weight"),
    "inverse_volatility": lambda mu, cov, **_: rule_weights(mu, "inverse_volatility"),
    "benchmark": lambda mu, cov, benchmark="", **_: benchmark_weights(mu, benchmark),
} | {name: (lambda mu, cov, name=name, units=10, risk_free=0.05, **_: search_weights(mu, cov, units, [name], risk_free=risk_free)) for name in G.OBJECTIVES}


def strategy(name: str):
    """Adds a function of (mu, cov, **options) to the strategies that `strategy_weights` knows by name."""
    def add(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        STRATEGIES[name] = fn
        return fn

    return add


def _message(e: Exception) -> str:
    """The line of an error that names its class in brackets, as Spark's do, else the first one."""
    lines = [x.strip(" :") for x in str(e).splitlines() if x.strip(" :")]
    return next((x for x in lines if "[" in x), next(iter(lines), type(e).__name__))[:300]


def strategy_weights(mu: DataFrame, cov: DataFrame, names: list[str], **options) -> tuple[DataFrame, DataFrame]:
    """(weights, failures) of strategies by name: window_id, strategy, symbol, weight; window_id, strategy, error.

    A name that is not known is an error. Each strategy is a job of its own, whose result is written: one that fails has a failure for every
    window, with the first line of its message, and the others go on. Weights of a window that are null, not finite, or do not sum to 1
    within 0.01 are a failure of that window alone.
    """
    unknown = [n for n in names if n not in STRATEGIES]
    if unknown:
        raise ValueError(f"unknown strategy {unknown[0]!r}; known: {', '.join(sorted(STRATEGIES))}")
    spark = mu.sparkSession
    windows = mu.select("window_id").distinct()
    weights, failures = [], []
    for name in names:
        try:
            path = shared_dir(spark, f"strategy-{name}")
            made = STRATEGIES[name](mu, cov, **options).select(
                F.col("window_id").cast("long").alias("window_id"), F.lit(name).alias("strategy"), "symbol", F.col("weight").cast("double").alias("weight"))
            made.write.parquet(path)
            rows = spark.read.schema(made.schema).parquet(path)
        except Exception as e:
            failures.append(windows.select("window_id", F.lit(name).alias("strategy"), F.lit(_message(e)).alias("error")))
            continue
        w = F.col("weight")
        bad = F.count_if(w.isNull() | F.isnan(w) | (F.abs(w) == float("inf")))
        total = F.sum(w)
        said = F.when(bad > 0, F.concat(bad.cast("string"), F.lit(" weights are null or not finite"))).when(
            F.abs(total - 1) > 0.01, F.concat(F.lit("weights sum to "), F.round(total, 6).cast("string")))
        checked = windows.join(rows.groupBy("window_id").agg(said.alias("error"), F.count(F.lit(1)).alias("n")), "window_id", "left")
        checked = checked.select("window_id", F.when(F.col("n").isNull(), F.lit("no weights")).otherwise(F.col("error")).alias("error")).where("error is not null")
        failures.append(checked.select("window_id", F.lit(name).alias("strategy"), "error"))
        weights.append(rows.join(checked.select("window_id"), "window_id", "left_anti"))
    none = spark.createDataFrame([], "window_id long, strategy string, symbol string, weight double")
    return reduce(DataFrame.unionByName, weights, none), reduce(DataFrame.unionByName, failures, spark.createDataFrame([], "window_id long, strategy string, error string"))


def out_of_sample(priced: DataFrame, weights: DataFrame, train: int, test: int) -> DataFrame:
    """Daily returns of every strategy inside the test windows; a window's first date has no return."""
    d = test_membership(priced, train, test, skip_first=True).join(weights, ["window_id", "symbol"])
    return d.groupBy("strategy", "window_id", "ts", "pos").agg(F.sum(F.col("weight") * F.col("r")).alias("r"))


def window_results(daily: DataFrame) -> DataFrame:
    return daily.groupBy("strategy", "window_id").agg(F.sum("r").alias("test_return"), F.count(F.lit(1)).alias("n_days"))


def equity_curve(daily: DataFrame) -> DataFrame:
    """exp of the running sum, after a starting row of 1 (without a date)."""
    d = running(daily, {"_c": ("sum", F.col("r"))}, key=("strategy",)).select("strategy", "ts", F.exp("_c").alias("value"))
    start = daily.select("strategy").distinct().select("strategy", F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(1.0).alias("value"))
    return d.unionByName(start)


def performance(daily: DataFrame, risk_free: float, periods: int) -> DataFrame:
    """Cumulative and annual return, drawdown, Sharpe, Sortino and Calmar ratios per strategy."""
    rf = risk_free / periods
    n = F.count(F.lit(1))
    low = F.least(F.col("r") - rf, F.lit(0.0))
    d = wealth(daily, F.exp("r"), key=("strategy",)).groupBy("strategy").agg(
        n.alias("n_days"), F.sum("r").alias("_s"), F.avg("r").alias("_m"), F.coalesce(F.stddev_samp("r"), F.lit(0.0)).alias("_sd"),
        F.sqrt(F.avg(low * low)).alias("_dd"), F.greatest(F.lit(0.0), F.max((F.col("peak") - F.col("value")) / F.col("peak"))).alias("max_drawdown"))
    d = d.withColumn("cumulative_return", F.exp("_s") - 1).withColumn("annualized_return", F.exp(F.col("_s") * periods / F.col("n_days")) - 1)
    excess = (F.col("_m") - rf) * periods**0.5
    return d.select(
        "strategy", "n_days", "cumulative_return", "annualized_return", "max_drawdown",
        guarded_ratio(excess, F.col("_sd"), floor=1e-10).alias("sharpe_ratio"),
        F.when(F.col("n_days") > 1, guarded_ratio(excess, F.col("_dd"), floor=1e-10)).otherwise(0.0).alias("sortino_ratio"),
        guarded_ratio(F.col("annualized_return"), F.col("max_drawdown"), floor=1e-10).alias("calmar_ratio"))


def multi_performance(daily: DataFrame, periods: int, expected: DataFrame | None = None, failures: DataFrame | None = None) -> DataFrame:
    """Compounded performance and rank by Sharpe ratio; expected strategies without results rank last as failed.

    failures: those of `strategy_weights`. Their strategies are expected, too, and ``error`` has the message of the first window that failed and
    ``n_failed`` the number of windows; a strategy that failed in some windows only is ranked by the others.
    """
    if failures is not None:
        told = failures.groupBy("strategy").agg(F.min_by("error", "window_id").alias("error"), F.count(F.lit(1)).alias("n_failed"))
        names = told.select("strategy") if expected is None else expected.select("strategy").union(told.select("strategy")).distinct()
        names = names.union(daily.select("strategy").distinct()).distinct()
        return multi_performance(daily, periods, names).join(told, "strategy", "left").na.fill(0, ["n_failed"])
    d = daily.groupBy("strategy").agg(
        (F.product(1 + F.col("r")) - 1).alias("total_return"), (F.stddev_samp("r") * periods**0.5).alias("volatility"), F.count(F.lit(1)).alias("n_periods"))
    d = d.withColumn("annualized_return", F.col("total_return") * periods / F.col("n_periods"))
    d = d.withColumn("sharpe_ratio", guarded_ratio(F.col("annualized_return"), F.col("volatility")))
    if expected is not None:
        d = expected.join(d, "strategy", "left").na.fill(0, ["n_periods"])
    d = d.withColumn("failed", F.col("sharpe_ratio").isNull())
    return d.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy("failed", F.col("sharpe_ratio").desc(), "strategy")))


def win_rate(results: DataFrame, against: str = "equal_weight") -> DataFrame:
    """Share of windows with a higher return; a difference within 1e-12, which is rounding, is no win."""
    base = results.filter(F.col("strategy") == against).select("window_id", F.col("test_return").alias("_b"))
    d = results.filter(F.col("strategy") != against).join(base, "window_id")
    return d.groupBy("strategy").agg(F.avg(F.when(F.col("test_return") > F.col("_b") + 1e-12, 1.0).otherwise(0.0)).alias("win_rate"), F.count(F.lit(1)).alias("n_windows"))


def window_contributions(weights: DataFrame, results: DataFrame) -> DataFrame:
    total = F.sum("weight").over(Window.partitionBy("strategy", "window_id"))
    d = weights.withColumn("_share", F.col("weight") / total).join(results, ["strategy", "window_id"])
    return d.select("strategy", "window_id", "symbol", (F.col("_share") * F.col("test_return")).alias("contribution"))
