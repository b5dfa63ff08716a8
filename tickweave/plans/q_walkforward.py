"""Queries: weight grids and walk-forward tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rounded
from ..operators import grid as G
from ..operators import walkforward as K
from . import panels as P
from .oracle import sql
from .q_portfolio import cov, mu
from .q_risk import r6
from .registry import query
from .silver import monthly_grid

UNITS, TRAIN, TEST, DAYS = 10, 104, 26, 365
STRATEGIES = ["max_sharpe", "min_variance", "max_diversification", "risk_parity"]


def _parts(key: str, mu_table: str, cov_table: str, p: str = "", units: int = 10) -> str:
    """Check SQL: grid candidates and their scores per ``key``."""
    return f"""{p}sy AS (SELECT symbol, row_number() OVER (ORDER BY symbol) AS i FROM (SELECT DISTINCT symbol FROM ret)),
    {p}gr AS (SELECT a, b, c, d, {units} - a - b - c - d AS e, concat_ws('-', a, b, c, d, {units} - a - b - c - d) AS cand
      FROM range({units + 1}) t1(a), range({units + 1}) t2(b), range({units + 1}) t3(c), range({units + 1}) t4(d) WHERE a + b + c + d <= {units}),
    {p}gw AS (SELECT cand, symbol, [a, b, c, d, e][i] / {units}.0::DOUBLE AS w FROM {p}gr, {p}sy),
    {p}sg AS (SELECT {key}, cand, g.symbol, w, mean, (SELECT 0) AS z FROM {p}gw g JOIN {mu_table} m ON m.symbol = g.symbol),
    {p}sr AS (SELECT {key}, cand, symbol_row AS symbol, sum(value * w) AS sw, max(CASE WHEN symbol_row = symbol_col THEN value END) AS own FROM {p}gw g JOIN {cov_table} c ON c.symbol_col = g.symbol GROUP BY ALL),
    {p}s1 AS (SELECT {key}, cand, sum(w * mean) AS er, sum(w * sw) AS var, sum(w * sqrt(own)) AS ow FROM {p}sg JOIN {p}sr USING ({key}, cand, symbol) GROUP BY ALL),
    {p}s2 AS (SELECT {key}, cand, max(abs(w * sw / var - 0.2)) AS gap FROM {p}sg JOIN {p}sr USING ({key}, cand, symbol) JOIN {p}s1 USING ({key}, cand) GROUP BY ALL),
    {p}sc AS (SELECT *, sqrt(var) AS vol, (er - 0.05) / sqrt(var) AS sharpe, ow / sqrt(var) AS div FROM {p}s1 JOIN {p}s2 USING ({key}, cand)),
    {p}bs AS (SELECT {key}, unnest(['max_sharpe', 'min_variance', 'max_diversification', 'risk_parity']) AS objective,
      unnest([arg_max(cand, (sharpe, cand)), arg_max(cand, (-var, cand)), arg_max(cand, (div, cand)), arg_max(cand, (-gap, cand))]) AS cand FROM {p}sc GROUP BY {key})"""


_GRID = "mg AS (SELECT 0 AS g, symbol, mu AS mean FROM mu), cg AS (SELECT 0 AS g, * FROM cov), " + _parts("g", "mg", "cg")


def build_grid(spark, sf):
    k = len(P.symbols(spark, sf))
    return G.scored(G.candidates(G.universe(mu(spark, sf), cov(spark, sf)), k, UNITS), k, UNITS)


def grid(spark, sf):
    return P.lake(spark, sf, "grid", build_grid)


@query("j6_candidate_scores", sql(f"""WITH {_GRID} SELECT cand AS candidate, #er# AS expected_return, #vol# AS volatility, #sharpe# AS sharpe,
    #div# AS diversification, #gap# AS risk_imbalance FROM sc"""))
def _(spark, sf):
    return r6(build_grid(spark, sf).select("candidate", "expected_return", "volatility", "sharpe", "diversification", "risk_imbalance"), "candidate")


@query("j7_best_by_objective", sql(f"WITH {_GRID} SELECT objective, cand AS candidate, #er# AS expected_return, #vol# AS volatility, #sharpe# AS sharpe FROM bs JOIN sc USING (g, cand)"))
def _(spark, sf):
    return r6(G.best(grid(spark, sf)).select("objective", "candidate", "expected_return", "volatility", "sharpe"), "objective", "candidate")


_LOW, _HIGH, _GROUPS = {"AFRICA": 0.1}, {"EUROPE": 0.4, "ASIA": 0.3}, [(["AMERICA", "MIDDLE EAST"], 0.5)]


@query("j8_constrained", sql(f"""WITH {_GRID}, ok AS (SELECT * FROM sc JOIN gr USING (cand) WHERE a >= 1 AND d <= 4 AND c <= 3 AND b + e <= 5),
    top AS (SELECT * FROM ok ORDER BY sharpe DESC, cand DESC LIMIT 1)
    SELECT symbol, #w# AS weight, #sharpe# AS sharpe, CASE WHEN symbol = 'AFRICA' AND abs(w - 0.1) < 1e-9 THEN 'lower'
      WHEN symbol = 'EUROPE' AND abs(w - 0.4) < 1e-9 THEN 'upper' WHEN symbol = 'ASIA' AND abs(w - 0.3) < 1e-9 THEN 'upper' END AS active_bound FROM top JOIN gw USING (cand)"""))
def _(spark, sf):
    kept = G.constrained(grid(spark, sf), UNITS, _LOW, _HIGH, _GROUPS)
    chosen = G.best(kept, objectives=["max_sharpe"])
    w = G.weights_of(chosen, UNITS, ["sharpe"])
    return r6(G.active_bounds(w, _LOW, _HIGH), "symbol", "active_bound")


@query("j8_feasibility", sql("""SELECT #sum(CASE symbol WHEN 'AFRICA' THEN 0.1 ELSE 0 END)# AS min_total,
    #sum(CASE symbol WHEN 'EUROPE' THEN 0.4 WHEN 'ASIA' THEN 0.3 ELSE 1.0 END)# AS max_total, true AS is_feasible FROM mu"""))
def _(spark, sf):
    return r6(G.checked(mu(spark, sf), _LOW, _HIGH), "is_feasible")


@query("j9_frontier", sql(f"""WITH {_GRID}, x AS (SELECT min(er) AS lo, max(er) AS hi FROM sc),
    b AS (SELECT *, CAST(least(floor((er - lo) / (hi - lo) * 20), 19) AS BIGINT) AS k FROM sc, x)
    SELECT 'frontier' AS kind, CAST(k AS VARCHAR) AS name, cand AS candidate, #er# AS expected_return, #vol# AS volatility FROM b QUALIFY row_number() OVER (PARTITION BY k ORDER BY vol, cand) = 1
    UNION ALL SELECT 'asset', symbol, cand, #er#, #vol# FROM sc JOIN gw USING (cand) WHERE w = 1
    UNION ALL SELECT 'optimum', objective, cand, #er#, #vol# FROM bs JOIN sc USING (cand) WHERE objective IN ('max_sharpe', 'min_variance')
    UNION ALL SELECT 'capital_line', name, cand, #0.05 + sharpe * x#, #x# FROM (SELECT cand, sharpe, unnest(['start', 'end']) AS name,
      unnest([0.0::DOUBLE, (SELECT max(v) * 1.2::DOUBLE FROM (SELECT min(vol) AS v FROM b GROUP BY k))]) AS x FROM bs JOIN sc USING (cand) WHERE objective = 'max_sharpe')"""))
def _(spark, sf):
    return r6(G.frontier(grid(spark, sf)), "kind", "name", "candidate")


_WIN = f"win AS (SELECT unnest(range(0, (max(pos) - {TRAIN + TEST}) // {TEST} + 1)) AS window_id FROM silver)"
_DATED = "dts AS (SELECT DISTINCT ts, pos FROM silver)"


@query("k1_windows", sql(f"""WITH {_WIN}, {_DATED},
    a AS (SELECT window_id, min(ts) AS train_start, max(ts) AS train_end FROM dts JOIN win ON pos > window_id * {TEST} AND pos <= window_id * {TEST} + {TRAIN} GROUP BY 1),
    b AS (SELECT window_id, min(ts) AS test_start, max(ts) AS test_end FROM dts JOIN win ON pos > window_id * {TEST} + {TRAIN} AND pos <= window_id * {TEST} + {TRAIN + TEST} GROUP BY 1)
    SELECT * FROM a JOIN b USING (window_id)"""))
def _(spark, sf):
    return K.windows(P.silver(spark, sf).select("ts", "pos").distinct(), TRAIN, TEST)


_MOM = f"""{_WIN},
    wm AS (SELECT window_id, symbol, avg(r) * 365 AS mean, stddev_samp(r) * sqrt(365) AS vol FROM silver JOIN win ON pos > window_id * {TEST} + 1 AND pos <= window_id * {TEST} + {TRAIN} GROUP BY 1, 2),
    wc AS (SELECT window_id, a.symbol AS symbol_row, b.symbol AS symbol_col, covar_samp(a.r, b.r) * 365 AS value FROM silver a JOIN silver b ON a.ts = b.ts
      JOIN win ON a.pos > window_id * {TEST} + 1 AND a.pos <= window_id * {TEST} + {TRAIN} GROUP BY 1, 2, 3)"""


def moments(spark, sf, days=DAYS):
    p = P.silver(spark, sf)
    return (P.lake(spark, sf, f"window_mu_{days}", lambda sp, d: K.window_moments(p, TRAIN, TEST, days)[0]),
            P.lake(spark, sf, f"window_cov_{days}", lambda sp, d: K.window_moments(p, TRAIN, TEST, days)[1]))


@query("k2_window_means", sql(f"WITH {_MOM} SELECT window_id, symbol, #mean# AS mean_return, #vol# AS volatility FROM wm"))
def _(spark, sf):
    return r6(K.window_moments(P.silver(spark, sf), TRAIN, TEST, DAYS)[0], "window_id", "symbol")


@query("k2_window_covariance", sql(f"WITH {_MOM} SELECT window_id, symbol_row, symbol_col, #value# AS value FROM wc"))
def _(spark, sf):
    return r6(K.window_moments(P.silver(spark, sf), TRAIN, TEST, DAYS)[1], "window_id", "symbol_row", "symbol_col")


_WTS = f"""{_MOM}, {_parts('window_id', 'wm', 'wc')},
    wt AS (SELECT window_id, objective AS strategy, symbol, w AS weight FROM bs JOIN gw USING (cand)
      UNION ALL SELECT window_id, 'equal_weight', symbol, 1.0 / count(*) OVER (PARTITION BY window_id) FROM wm
      UNION ALL SELECT window_id, 'inverse_volatility', symbol, (1 / vol) / sum(1 / vol) OVER (PARTITION BY window_id) FROM wm
      UNION ALL SELECT window_id, 'benchmark', 'EUROPE', 1.0 FROM win)"""


def build_weights(spark, sf, days=DAYS):
    m, c = moments(spark, sf, days)
    out = K.grid_weights(m, c, len(P.symbols(spark, sf)), UNITS, STRATEGIES)
    for rule in ("equal_weight", "inverse_volatility"):
        out = out.unionByName(K.rule_weights(m, rule))
    return out.unionByName(K.benchmark_weights(m, "EURO"))


def weights(spark, sf, days=DAYS):
    """Weights chosen from moments of so many periods a year."""
    return P.lake(spark, sf, f"window_weights_{days}", lambda sp, d: build_weights(sp, d, days))


@query("k3_window_weights", sql(f"WITH {_WTS} SELECT window_id, strategy, symbol, #weight# AS weight FROM wt"))
def _(spark, sf):
    return r6(build_weights(spark, sf), "window_id", "strategy", "symbol")


_OOS = f"""{_WTS}, oos AS (SELECT strategy, window_id, ts, pos, sum(weight * r) AS r FROM silver JOIN win ON pos > window_id * {TEST} + {TRAIN} + 1
      AND pos <= window_id * {TEST} + {TRAIN + TEST} JOIN wt USING (window_id, symbol) GROUP BY 1, 2, 3, 4),
    wr AS (SELECT strategy, window_id, sum(r) AS test_return, count(*) AS n_days FROM oos GROUP BY 1, 2)"""


def build_daily(spark, sf, days=DAYS):
    return K.out_of_sample(P.silver(spark, sf), weights(spark, sf, days), TRAIN, TEST)


def daily(spark, sf, days=DAYS):
    return P.lake(spark, sf, f"out_of_sample_{days}", lambda sp, d: build_daily(sp, d, days))


@query("k4_k5_out_of_sample", sql(f"WITH {_OOS} SELECT strategy, window_id, ts, #r#8# AS r FROM oos"))
def _(spark, sf):
    return r6(build_daily(spark, sf).drop("pos"), "strategy", "window_id", "ts", places=8)


_CURVE = f"""{_OOS}, cv AS (SELECT strategy, ts, pos, r, exp(sum(r) OVER w) AS e FROM oos WINDOW w AS (PARTITION BY strategy ORDER BY ts)),
    ck AS (SELECT *, greatest(1, max(e) OVER (PARTITION BY strategy ORDER BY ts)) AS pk FROM cv),
    pf AS (SELECT strategy, count(*) AS n_days, sum(r) AS s, avg(r) AS m, stddev_samp(r) AS sd, sqrt(avg(least(r - 0.05 / 365, 0) ** 2)) AS dd, max((pk - e) / pk) AS mdd FROM ck GROUP BY 1)"""


_PERFORMANCE = f"""WITH {_CURVE} SELECT strategy, n_days, #exp(s) - 1# AS cumulative_return, #exp(s) ** (365.0 / n_days) - 1# AS annualized_return, #mdd# AS max_drawdown,
    #(m - 0.05 / 365) / sd * sqrt(365)# AS sharpe_ratio, #(m - 0.05 / 365) / dd * sqrt(365)# AS sortino_ratio, #(exp(s) ** (365.0 / n_days) - 1) / mdd# AS calmar_ratio FROM pf"""


@query("k6_performance", sql(_PERFORMANCE))
def _(spark, sf):
    return r6(K.performance(daily(spark, sf), 0.05, DAYS), "strategy", "n_days")


@query("k6_performance_trad", sql(_PERFORMANCE.replace("365", "252")))
def _(spark, sf):
    """252 periods a year throughout: in the moments the weights are chosen from, and in the measures."""
    return r6(K.performance(daily(spark, sf, 252), 0.05, 252), "strategy", "n_days")


@query("k7_equity_curve", sql(f"WITH {_CURVE} SELECT strategy, ts, #e# AS value FROM cv UNION ALL SELECT DISTINCT strategy, NULL, 1.0 FROM oos"))
def _(spark, sf):
    return r6(K.equity_curve(daily(spark, sf)), "strategy", "ts")


@query("k8_window_results", sql(f"WITH {_OOS} SELECT strategy, window_id, #test_return# AS test_return, n_days FROM wr"))
def _(spark, sf):
    return r6(K.window_results(daily(spark, sf)), "strategy", "window_id", "n_days")


@query("k9_h2_multi_strategy", sql(f"""WITH {_OOS}, a AS (SELECT strategy, product(1 + r) - 1 AS t, stddev_samp(r) * sqrt(365) AS v, count(*) AS n FROM oos GROUP BY 1),
    b AS (SELECT *, t * 365 / n AS an, (t * 365 / n) / v AS sh FROM a UNION ALL SELECT 'offline', NULL, NULL, 0, NULL, NULL)
    SELECT strategy, #t# AS total_return, #v# AS volatility, n AS n_periods, #an# AS annualized_return, #sh# AS sharpe_ratio, sh IS NULL AS failed,
      CAST(row_number() OVER (ORDER BY sh IS NULL, sh DESC, strategy) AS INT) AS rank FROM b"""))
def _(spark, sf):
    names = [*ALL, "offline"]
    expected = spark.createDataFrame([(n,) for n in names], "strategy string")
    return r6(K.multi_performance(daily(spark, sf), DAYS, expected), "strategy", "n_periods", "failed", "rank")


@K.strategy("reciprocal_spread")
def _reciprocal_spread(mu, cov, **_):
    """Divides by the spread of a volatility around itself: fails on every row."""
    return mu.select("window_id", "symbol", (1 / (F.col("volatility") - F.col("volatility"))).alias("weight"))


@K.strategy("crowded")
def _crowded(mu, cov, **_):
    """Bounds that no weights meet."""
    ok = G.checked(mu.select("symbol").distinct(), {}, {s["symbol"]: 0.05 for s in mu.select("symbol").distinct().collect()})
    return K.rule_weights(mu, "equal_weight").where(ok.select("is_feasible").scalar())


@K.strategy("late_start")
def _late_start(mu, cov, **_):
    """Twice the weights in the first window, equal ones from then on."""
    return K.rule_weights(mu, "equal_weight").withColumn("weight", F.when(F.col("window_id") == 0, 2 * F.col("weight")).otherwise(F.col("weight")))


_SOME = ["equal_weight", "inverse_volatility", "benchmark", "late_start"]


@query("k9_failing_strategies", sql(f"""WITH {_OOS}, o AS (SELECT * FROM oos UNION ALL SELECT 'late_start', window_id, ts, pos, r FROM oos WHERE strategy = 'equal_weight' AND window_id > 0),
    a AS (SELECT strategy, product(1 + r) - 1 AS t, stddev_samp(r) * sqrt(365) AS v, count(*) AS n FROM o WHERE strategy IN {tuple(_SOME)} GROUP BY 1),
    b AS (SELECT *, t * 365 / n AS an, (t * 365 / n) / v AS sh FROM a UNION ALL SELECT unnest(['crowded', 'reciprocal_spread']), NULL, NULL, 0, NULL, NULL)
    SELECT strategy, #t# AS total_return, #v# AS volatility, n AS n_periods, #an# AS annualized_return, #sh# AS sharpe_ratio, sh IS NULL AS failed,
      CAST(row_number() OVER (ORDER BY sh IS NULL, sh DESC, strategy) AS INT) AS rank, CASE strategy WHEN 'crowded' THEN 'infeasible bounds' WHEN 'reciprocal_spread' THEN 'divide by zero'
        WHEN 'late_start' THEN 'weights sum to 2.0' END AS error, CASE WHEN sh IS NULL THEN (SELECT count(*) FROM win) WHEN strategy = 'late_start' THEN 1 ELSE 0 END AS n_failed FROM b"""))
def _(spark, sf):
    """Two strategies that fail and one with a bad window beside three that do not."""
    m, c = moments(spark, sf)
    w, failures = K.strategy_weights(m, c, [*_SOME, "crowded", "reciprocal_spread"], benchmark="EURO")
    d = K.multi_performance(K.out_of_sample(P.silver(spark, sf), w, TRAIN, TEST), DAYS, failures=failures)
    said = F.when(F.col("error").contains("infeasible bounds"), "infeasible bounds").when(F.col("error").contains("DIVIDE_BY_ZERO"), "divide by zero").otherwise(F.col("error"))
    return r6(d.withColumn("error", said), "strategy", "n_periods", "failed", "rank", "error", "n_failed")


@query("k10_win_rate", sql(f"""WITH {_OOS} SELECT a.strategy, #avg(CASE WHEN a.test_return > b.test_return + 1e-12::DOUBLE THEN 1.0 ELSE 0.0 END)# AS win_rate, count(*) AS n_windows
    FROM wr a JOIN wr b ON a.window_id = b.window_id AND b.strategy = 'equal_weight' WHERE a.strategy <> 'equal_weight' GROUP BY 1"""))
def _(spark, sf):
    return r6(K.win_rate(K.window_results(daily(spark, sf))), "strategy", "n_windows")


@query("k10_contributions", sql(f"""WITH {_OOS} SELECT strategy, window_id, symbol, #weight / sum(weight) OVER (PARTITION BY strategy, window_id) * test_return# AS contribution
    FROM wt JOIN wr USING (strategy, window_id)"""))
def _(spark, sf):
    return r6(K.window_contributions(weights(spark, sf), K.window_results(daily(spark, sf))), "strategy", "window_id", "symbol")


ALL = [*STRATEGIES, "equal_weight", "inverse_volatility", "benchmark"]
_EACH = ", ".join(f"#coalesce(sum(CASE WHEN strategy = '{s}' THEN r END), 0)# AS {s}" for s in ALL)


@query("f14_monthly_strategy_returns", sql(f"""WITH {_OOS} SELECT strftime(ts, '%Y-%m') AS month, {_EACH} FROM oos GROUP BY 1"""))
def _(spark, sf):
    return r6(monthly_grid(daily(spark, sf), "strategy", ALL), "month")
