"""Queries: portfolio algebra, scenarios, drift and costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rounded
from ..operators import align as A
from ..operators import moments as M
from ..operators import portfolio as O
from ..operators.report import portfolio_report
from . import panels as P
from .oracle import sql
from .q_risk import _G1, _G2, _VAR, _WEALTH, r6
from .registry import query


def mu(spark, sf):
    return P.lake(spark, sf, "mu", lambda sp, d: M.mean_vol(P.returns(sp, d), 365))


def cov(spark, sf):
    return P.lake(spark, sf, "cov", lambda sp, d: M.covariance(P.returns(sp, d), 365))


def one(df, name="target"):
    return df.withColumn("portfolio", F.lit(name))


def stats(spark, sf, risk_free=0.05):
    return O.portfolio_stats(P.books(spark, sf), mu(spark, sf), cov(spark, sf), risk_free)


_STATS = """sw AS (SELECT portfolio, symbol_row AS symbol, sum(value * weight) AS sw FROM cov JOIN books ON symbol_col = symbol GROUP BY 1, 2),
    st AS (SELECT portfolio, sum(weight * mu) AS er, sum(weight * sw) AS var, abs(sum(weight) - 1) <= 0.01 AS ok
      FROM books JOIN mu USING (symbol) JOIN sw USING (portfolio, symbol) GROUP BY 1)"""


@query("j1_j3_portfolio_stats", sql(f"""WITH {_STATS} SELECT portfolio, #er# AS expected_return, #var# AS variance, ok AS weights_ok,
    #sqrt(var)# AS volatility, #(er - 0.05) / sqrt(var)# AS sharpe FROM st"""))
def _(spark, sf):
    return r6(stats(spark, sf), "portfolio", "weights_ok")


_RC = """rc AS (SELECT portfolio, symbol, weight, mu, sw / sqrt(var) AS mctr, weight * sw / sqrt(var) AS rc, weight * sw / var AS pct
    FROM books JOIN mu USING (symbol) JOIN sw USING (portfolio, symbol) JOIN st USING (portfolio))"""


@query("j4_risk_contribution", sql(f"""WITH {_STATS}, {_RC} SELECT portfolio, symbol, #weight# AS weight, #mctr# AS mctr, #rc# AS risk_contribution,
    #pct# AS pct_contribution, row_number() OVER (PARTITION BY portfolio ORDER BY abs(rc) DESC, symbol)::INT AS rank FROM rc"""))
def _(spark, sf):
    return r6(O.risk_contributions(P.books(spark, sf), cov(spark, sf)), "portfolio", "symbol", "rank")


@query("j5_rule_weights", sql("""
    SELECT 'equal' AS rule, symbol, #1 / (SELECT n FROM cnt)# AS weight FROM mu UNION ALL
    SELECT 'inverse_volatility', symbol, #(1 / vol) / (SELECT sum(1 / vol) FROM mu)# FROM mu"""))
def _(spark, sf):
    m = mu(spark, sf)
    rules = {"equal": O.equal_weights(m), "inverse_volatility": O.inverse_volatility_weights(m)}
    out = [w.select(F.lit(n).alias("rule"), "symbol", rounded("weight").alias("weight")) for n, w in rules.items()]
    return out[0].unionByName(out[1])


@query("j10_volatility_reduction", sql(f"""WITH {_STATS}, ew AS (SELECT sqrt(sum(value) / max(n * n)) AS v FROM cov, cnt)
    SELECT portfolio, #(1 - sqrt(var) / v) * 100#2# AS reduction_pct FROM st, ew"""))
def _(spark, sf):
    m, c = mu(spark, sf), cov(spark, sf)
    return O.volatility_reduction(stats(spark, sf), O.portfolio_stats(one(O.equal_weights(m)), m, c))


@query("j11_equilibrium_returns", sql(f"WITH {_STATS} SELECT portfolio, symbol, #2.5 * sw# AS equilibrium_return FROM sw"))
def _(spark, sf):
    return r6(O.equilibrium_returns(P.books(spark, sf), cov(spark, sf)), "portfolio", "symbol")


_NAMED = "CASE symbol WHEN 'ASIA' THEN 'BTCUSDT' WHEN 'EUROPE' THEN 'ETHUSDT' WHEN 'AFRICA' THEN 'GLD' ELSE symbol END"
_STRESS = f"""{_STATS}, nb AS (SELECT portfolio, {_NAMED} AS symbol, weight FROM books),
    sc AS (SELECT unnest(['crypto_crash', 'volatility_spike', 'flight_to_safety', 'btc_halving_rally', 'black_swan', 'custom']) AS scenario),
    sp AS (SELECT *, weight * shock AS impact, weight * (1 + shock) AS stressed FROM (SELECT *, CASE scenario
      WHEN 'crypto_crash' THEN CASE WHEN symbol LIKE '%USDT' THEN -0.3 ELSE -0.05 END WHEN 'volatility_spike' THEN 0.0
      WHEN 'flight_to_safety' THEN CASE WHEN symbol = 'GLD' THEN 0.1 ELSE -0.2 END
      WHEN 'btc_halving_rally' THEN CASE WHEN symbol LIKE 'BTC%' THEN 0.5 WHEN symbol LIKE '%USDT' THEN 0.25 ELSE -0.05 END
      WHEN 'black_swan' THEN -0.4 ELSE CASE symbol WHEN 'GLD' THEN -0.15 WHEN 'AMERICA' THEN 0.05 ELSE 0.0 END END::DOUBLE AS shock FROM nb, sc))"""


def _named_books(spark, sf):
    s = F.col("symbol")
    name = F.when(s == "ASIA", "BTCUSDT").when(s == "EUROPE", "ETHUSDT").when(s == "AFRICA", "GLD").otherwise(s)
    return P.books(spark, sf).withColumn("symbol", name)


_CUSTOM = {"GLD": -0.15, "AMERICA": 0.05}


@query("j12_stress_positions", sql(f"""WITH {_STRESS} SELECT portfolio, scenario, symbol, #weight# AS weight, #shock# AS shock, #impact# AS impact,
    #stressed# AS stressed_weight FROM sp"""))
def _(spark, sf):
    return r6(O.stress_positions(_named_books(spark, sf), _CUSTOM), "portfolio", "scenario", "symbol")


@query("j12_h5_stress_summary", sql(f"""WITH {_STRESS}, t AS (SELECT portfolio, scenario, sum(impact) AS ti, arg_min(symbol, (impact, symbol)) AS worst_hit,
      arg_max(symbol, (impact, symbol)) AS best_performer FROM sp GROUP BY 1, 2),
    x AS (SELECT *, sqrt(var) * CASE WHEN scenario = 'volatility_spike' THEN sqrt(2) ELSE 1 END AS sv FROM t JOIN st USING (portfolio))
    SELECT portfolio, scenario, #ti# AS total_impact, worst_hit, best_performer, #er + ti# AS stressed_return, #sv# AS stressed_volatility,
      #er + ti - 2.326 * sv# AS value_at_risk_1pct FROM x"""))
def _(spark, sf):
    d = O.stress_summary(O.stress_positions(_named_books(spark, sf), _CUSTOM), stats(spark, sf))
    return r6(d.drop("expected_return", "volatility"), "portfolio", "scenario", "worst_hit", "best_performer")


_ATTR = """att AS (SELECT portfolio, symbol, weight, ar, weight * ar AS c, sum(weight * ar) OVER (PARTITION BY portfolio) AS pr_
    FROM books JOIN (SELECT symbol, product(1 + r) - 1 AS ar FROM ret GROUP BY 1) USING (symbol))"""


def _attribution(spark, sf):
    return O.attribution(P.books(spark, sf), O.compounded_return(P.returns(spark, sf)))


@query("j13_attribution", sql(f"""WITH {_ATTR} SELECT portfolio, symbol, #weight# AS weight, #ar# AS asset_return, #c# AS contribution, #pr_# AS portfolio_return,
    #c / pr_# AS pct_contribution, row_number() OVER (PARTITION BY portfolio ORDER BY c DESC, symbol)::INT AS rank FROM att"""))
def _(spark, sf):
    return r6(_attribution(spark, sf).drop("rank_from_bottom"), "portfolio", "symbol", "rank")


@query("h1_top_contributors", sql(f"""WITH {_ATTR}
    SELECT portfolio, 'top' AS side, symbol, #c# AS contribution FROM att QUALIFY row_number() OVER (PARTITION BY portfolio ORDER BY c DESC, symbol) <= 3 UNION ALL
    SELECT portfolio, 'bottom', symbol, #c# FROM att QUALIFY row_number() OVER (PARTITION BY portfolio ORDER BY c, symbol) <= 3"""))
def _(spark, sf):
    return O.extreme_contributors(_attribution(spark, sf)).select("portfolio", "side", "symbol", rounded("contribution").alias("contribution"))


_DRIFT = """g AS (SELECT symbol, pos AS period, weight, weight * product(1 + r) OVER (PARTITION BY symbol ORDER BY pos) AS v FROM ret JOIN tw USING (symbol)
      UNION ALL SELECT symbol, 0, weight, weight FROM tw),
    dw AS (SELECT symbol, period, weight, CASE WHEN sum(v) OVER (PARTITION BY period) > 0 THEN v / sum(v) OVER (PARTITION BY period) ELSE 0 END AS w FROM g),
    dv AS (SELECT period, sqrt(sum((w - weight) ** 2)) AS te, max(abs(w - weight)) AS md FROM dw GROUP BY 1)"""


def _drift(spark, sf):
    return O.drifted_weights(P.target_weights(spark, sf), P.returns(spark, sf))


@query("j14_weight_drift", sql(f"WITH {_DRIFT} SELECT symbol, period, #weight# AS target_weight, #w# AS drifted_weight FROM dw"))
def _(spark, sf):
    return r6(_drift(spark, sf), "symbol", "period")


@query("j15_drift_deviation", sql(f"WITH {_DRIFT} SELECT period, #te#8# AS tracking_error, #md#8# AS max_deviation FROM dv"))
def _(spark, sf):
    return r6(O.drift_deviation(_drift(spark, sf)), "period", places=8)


@query("j16_periods_to_threshold", sql(f"""WITH {_DRIFT} SELECT coalesce(min(CASE WHEN md > 0.05 THEN period END), max(period)) AS periods_to_threshold,
    #coalesce(arg_min(CASE WHEN md > 0.05 THEN md END, period), arg_max(md, period))#8# AS max_drift_at_threshold FROM dv"""))
def _(spark, sf):
    return r6(O.periods_to_threshold(O.drift_deviation(_drift(spark, sf))), "periods_to_threshold", places=8)


_MOVE = """cu AS (SELECT symbol, volume / sum(volume) OVER () AS weight FROM (SELECT symbol, sum(volume) AS volume FROM panel
      WHERE ts >= TIMESTAMP '2000-01-01' AND symbol <> 'AFRICA' GROUP BY 1)),
    mv AS (SELECT symbol, coalesce(cu.weight, 0) AS cw, coalesce(t.weight, 0) AS tw FROM cu FULL JOIN (SELECT * FROM tw WHERE symbol <> 'EUROPE') t USING (symbol))"""


def _current(spark, sf):
    v = P.weekly_bars(spark, sf).filter("ts >= TIMESTAMP_NTZ'2000-01-01' and symbol <> 'AFRICA'").groupBy("symbol").agg(F.sum("volume").alias("v"))
    return v.select("symbol", (F.col("v") / v.agg(F.sum("v")).scalar()).alias("weight"))


def _target(spark, sf):
    return P.target_weights(spark, sf).filter("symbol <> 'EUROPE'")


@query("j17_rebalance_alerts", sql(f"""WITH {_MOVE} SELECT symbol, #cw# AS current_weight, #tw# AS target_weight, #cw - tw# AS drift, abs(cw - tw) >= 0.05 AS alert,
    CASE WHEN cw - tw > 0 THEN 'SELL' ELSE 'BUY' END AS action, #abs(cw - tw) * 10000#2# AS amount_usd FROM mv"""))
def _(spark, sf):
    d = O.rebalance_alerts(_current(spark, sf), _target(spark, sf), 0.05, 10000.0)
    return r6(d, "symbol", "alert", "action").withColumn("amount_usd", rounded("amount_usd", 2))


@query("j17_rebalance_summary", sql(f"""WITH {_MOVE} SELECT #sum(abs(cw - tw))# AS total_drift, #max(abs(cw - tw)) FILTER (WHERE abs(cw - tw) >= 0.05)# AS max_drift,
    count(*) FILTER (WHERE abs(cw - tw) >= 0.05) AS n_alerts, count(*) AS n_symbols, count(*) FILTER (WHERE abs(cw - tw) >= 0.05) > 0 AS needs_rebalance FROM mv"""))
def _(spark, sf):
    d = O.rebalance_summary(O.rebalance_alerts(_current(spark, sf), _target(spark, sf), 0.05, 10000.0))
    return r6(d, "n_alerts", "n_symbols", "needs_rebalance")


_COSTS = f"{_MOVE}, tc AS (SELECT symbol, tw - cw AS ch, abs(tw - cw) * 10000 AS v FROM mv WHERE abs(tw - cw) * 10000 >= 0.01)"


@query("j18_trade_costs", sql(f"""WITH {_COSTS} SELECT symbol, #ch# AS weight_change, #v#2# AS trade_value, CASE WHEN ch > 0 THEN 'BUY' ELSE 'SELL' END AS action,
    #v * 0.001#4# AS fee_cost, #v * 0.0005#4# AS slippage_cost, #v * 0.0015#4# AS total_cost FROM tc"""))
def _(spark, sf):
    d = O.trade_costs(_current(spark, sf), _target(spark, sf), 10000.0)
    return d.select("symbol", rounded("weight_change").alias("weight_change"), rounded("trade_value", 2).alias("trade_value"), "action",
                    *[rounded(c, 4).alias(c) for c in ("fee_cost", "slippage_cost", "total_cost")])


@query("j19_net_of_costs", sql(f"""WITH {_COSTS}, {_STATS}, k AS (SELECT sum(v * 0.0015) / 10000 AS k, count(*) AS n FROM tc)
    SELECT portfolio, #k * 12# AS annual_cost, #er - k * 12# AS net_return, #er / sqrt(var)# AS gross_sharpe, #(er - k * 12) / sqrt(var)# AS net_sharpe,
      #er / sqrt(var) - (er - k * 12) / sqrt(var)# AS sharpe_drag FROM st, k"""))
def _(spark, sf):
    cost = O.cost_summary(O.trade_costs(_current(spark, sf), _target(spark, sf), 10000.0), 10000.0).select("cost_pct_of_portfolio")
    d = O.net_of_costs(stats(spark, sf), cost.scalar(), 12)
    return r6(d.select("portfolio", "annual_cost", "net_return", "gross_sharpe", "net_sharpe", "sharpe_drag"), "portfolio")


@query("j20_position_sizes", sql("""
    WITH m AS (SELECT unnest(['weight', 'vol_target', 'fixed_fractional']) AS method),
    x AS (SELECT portfolio, symbol, weight, method, CASE method WHEN 'weight' THEN weight WHEN 'vol_target' THEN weight * (0.15 / vol) ELSE 0.02 / (vol * 0.1) END AS a
      FROM books JOIN mu USING (symbol), m)
    SELECT portfolio, symbol, method, #weight# AS weight, #a# AS adjusted_weight, #a * 10000#2# AS amount_usd FROM x"""))
def _(spark, sf):
    return r6(O.position_sizes(P.books(spark, sf), mu(spark, sf)), "portfolio", "symbol", "method")


@query("j21_kelly", sql("""
    WITH k AS (SELECT symbol, count(*) FILTER (WHERE r > 0) / count(*) AS p, avg(CASE WHEN r > 0 THEN r END) AS w, avg(CASE WHEN r < 0 THEN -r END) AS l FROM ret GROUP BY 1),
    f AS (SELECT *, greatest(0, least(1, (p * w / l - (1 - p)) / (w / l))) AS f FROM k)
    SELECT symbol, #p# AS win_rate, #w# AS avg_win, #l# AS avg_loss, #f# AS kelly, #f / 2# AS half_kelly FROM f"""))
def _(spark, sf):
    return r6(O.kelly(P.returns(spark, sf)), "symbol")


@query("i5_combined_weights", sql("""
    WITH a AS (SELECT * FROM books WHERE portfolio = 'A-F' AND symbol <> 'ASIA'), b AS (SELECT * FROM books WHERE portfolio = 'N-O' AND symbol IN ('ASIA', 'EUROPE'))
    SELECT symbol, #weight * 0.4# AS weight FROM b UNION ALL SELECT symbol, #weight * 0.6# FROM a WHERE symbol NOT IN (SELECT symbol FROM b)"""))
def _(spark, sf):
    b = P.books(spark, sf)
    d = O.combined_weights(b.filter("portfolio = 'A-F' and symbol <> 'ASIA'"), b.filter("portfolio = 'N-O' and symbol in ('ASIA', 'EUROPE')"), 0.6)
    return r6(d, "symbol")


@query("j22_blended_stats", sql(f"""WITH {_STATS}, b AS (SELECT sum(c * er) AS er, sqrt(sum(c * c * var)) AS v FROM (
      SELECT *, CASE portfolio WHEN 'A-F' THEN 0.6 ELSE 0.4 END AS c FROM st WHERE portfolio IN ('A-F', 'N-O')))
    SELECT #er# AS expected_return, #v# AS volatility, #er / v# AS sharpe FROM b"""))
def _(spark, sf):
    return r6(O.blended_stats(stats(spark, sf), "A-F", "N-O", 0.6))


@query("j23_evaluation_totals", sql(f"WITH {_STATS} SELECT portfolio, #er# AS expected_return, #sqrt(var)# AS volatility, #er / sqrt(var)# AS sharpe FROM st"))
def _(spark, sf):
    totals, _, _ = O.evaluate(P.books(spark, sf), mu(spark, sf), cov(spark, sf))
    return r6(totals.select("portfolio", "expected_return", "volatility", "sharpe"), "portfolio")


@query("j23_evaluation_positions", sql(f"WITH {_STATS}, {_RC} SELECT portfolio, symbol, #weight# AS weight, #mu# AS expected_return, #mctr# AS mctr, #rc# AS risk_contribution FROM rc"))
def _(spark, sf):
    _, parts, _ = O.evaluate(P.books(spark, sf), mu(spark, sf), cov(spark, sf))
    return r6(parts.select("portfolio", "symbol", "weight", F.col("mean_return").alias("expected_return"), "mctr", "risk_contribution"), "portfolio", "symbol")


_SERIES = "pfe AS (SELECT portfolio AS symbol, ts, pos, sum(weight * r) AS r FROM ret JOIN books USING (symbol) GROUP BY 1, 2, 3)"
_RANKED = """prk AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY r) AS k, count(*) OVER (PARTITION BY symbol) AS n, avg(r) OVER (PARTITION BY symbol) AS m,
    stddev_samp(r) OVER (PARTITION BY symbol) AS sd, stddev_pop(r) OVER (PARTITION BY symbol) AS sp FROM pfe)"""


@query("j24_portfolio_report", sql(f"""WITH {_SERIES}, {_RANKED}, {_VAR.replace("FROM ranked", "FROM prk").replace("JOIN ent e", "JOIN pfe e")},
    {_WEALTH.replace("FROM ent", "FROM pfe")}, dd AS (SELECT symbol, max((pw - w) / pw) AS mdd FROM pk GROUP BY 1),
    sh AS (SELECT symbol, {_G1} AS g1, {_G2} AS g2 FROM prk GROUP BY symbol, n),
    al AS (SELECT symbol, count(*) AS n_market, covar_samp(r, m) / var_samp(m) AS beta, corr(r, m) ** 2 AS r2, avg(r) - 0.05 / 365 AS mp, avg(m) - 0.05 / 365 AS mb,
      stddev_samp(r - m) * sqrt(365) AS te, avg(CASE WHEN m > 0 THEN r END) / avg(CASE WHEN m > 0 THEN m END) AS uc,
      avg(CASE WHEN m < 0 THEN r END) / avg(CASE WHEN m < 0 THEN m END) AS dc FROM pfe JOIN mkt USING (ts) GROUP BY 1),
    ds AS (SELECT symbol, sqrt(avg(greatest(0, 0.05 / 365 - r) ** 2)) * sqrt(365) AS dn, sqrt(avg(greatest(0, r - 0.05 / 365) ** 2)) * sqrt(365) AS up,
      sum(r) / abs(sum(least(r, 0))) AS gp, sum(greatest(r, 0)) / sum(greatest(-r, 0)) AS om, count(*) AS n_periods, count(*) FILTER (WHERE r < 0) AS n_negative,
      count(*) FILTER (WHERE r > 0) AS n_positive, min(r) AS lo, max(r) AS hi, avg(r) * 365 AS an FROM pfe GROUP BY 1)
    SELECT symbol AS portfolio, n_periods, n_market, n_negative, n_positive, #dn# AS downside_deviation, #up# AS upside_deviation, #gp# AS gain_to_pain, #lo# AS worst_return,
      #hi# AS best_return, #(an - 0.05) / dn# AS sortino_ratio, #beta# AS beta, #(mp - beta * mb) * 365# AS alpha_annual, #r2# AS r_squared, #te# AS tracking_error,
      #(mp - beta * mb) * 365 / te# AS information_ratio, #uc# AS upside_capture, #dc# AS downside_capture, #om# AS omega, #g1# AS skewness, #g2# AS excess_kurtosis,
      #n_periods / 6 * (g1 ** 2 + g2 ** 2 / 4)#4# AS jarque_bera, n_periods / 6 * (g1 ** 2 + g2 ** 2 / 4) <= 5.991 AS is_normal, #hv# AS historical_var, #hc# AS historical_cvar,
      #pv# AS parametric_var, #pc# AS parametric_cvar, #cv# AS cornish_fisher_var, #coalesce(cc, cv)# AS cornish_fisher_cvar, #mdd# AS max_drawdown, #an# AS annual_return,
      #an / mdd# AS calmar FROM ds JOIN al USING (symbol) JOIN sh USING (symbol) JOIN c USING (symbol) JOIN dd USING (symbol) LEFT JOIN t USING (symbol)"""))
def _(spark, sf):
    d = portfolio_report(A.portfolio_series(P.returns(spark, sf), P.books(spark, sf)), P.market(spark, sf), 0.05, 365)
    exact = ["portfolio", "n_periods", "n_market", "n_negative", "n_positive", "is_normal"]
    return r6(d.withColumn("jarque_bera", F.round("jarque_bera", 4)), *exact)
