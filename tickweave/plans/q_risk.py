"""Queries: returns, moments, matrices, distribution and tail risk, drawdowns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rounded
from ..operators import drawdown as D
from ..operators import moments as M
from ..operators import risk as K
from . import panels as P
from .oracle import sql
from .registry import query


def r6(df, *keep, places=6):
    """Round all columns but ``keep``."""
    return df.select(*keep, *[rounded(c, places).alias(c) for c in df.columns if c not in keep])


@query("f8_annual_mean", sql("SELECT symbol, #mu# AS mean_return FROM mu"))
def _(spark, sf):
    return r6(M.mean_vol(P.returns(spark, sf), 365).drop("volatility"), "symbol")


@query("f9_annual_volatility", sql("SELECT symbol, #vol# AS volatility FROM mu"))
def _(spark, sf):
    return r6(M.mean_vol(P.returns(spark, sf), 365).drop("mean_return"), "symbol")


@query("f39_risk_return", sql("SELECT symbol, #mu# AS mean_return, #vol# AS volatility, #CASE WHEN vol > 1e-10 THEN mu / vol ELSE 0 END# AS sharpe FROM mu"))
def _(spark, sf):
    return r6(M.risk_return(P.returns(spark, sf), 365), "symbol")


@query("f10_covariance", sql("SELECT symbol_row, symbol_col, #value# AS value FROM cov"))
def _(spark, sf):
    return r6(M.covariance(P.returns(spark, sf), 365), "symbol_row", "symbol_col")


_COR = """SELECT symbol_a AS symbol_row, symbol_b AS symbol_col, CASE WHEN symbol_a = symbol_b THEN 1.0 ELSE corr(x_a, x_b) END AS value
    FROM prs GROUP BY 1, 2"""


@query("f11_correlation", sql(f"WITH c AS ({_COR}) SELECT symbol_row, symbol_col, #value# AS value FROM c"))
def _(spark, sf):
    return r6(M.correlation(P.returns(spark, sf)), "symbol_row", "symbol_col")


@query("f12_silver_bundle", sql(f"""
    WITH c AS ({_COR}), d AS (SELECT unnest([365, 252]) AS days)
    SELECT days, 'mean' AS metric, symbol AS symbol_row, '' AS symbol_col, #avg(r) * days# AS value FROM ret, d GROUP BY 1, 3
    UNION ALL SELECT days, 'volatility', symbol, '', #stddev_samp(r) * sqrt(days)# FROM ret, d GROUP BY 1, 3
    UNION ALL SELECT days, 'covariance', symbol_a, symbol_b, #covar_samp(x_a, x_b) * days# FROM prs, d GROUP BY 1, 3, 4
    UNION ALL SELECT days, 'correlation', symbol_row, symbol_col, #value# FROM c, d"""))
def _(spark, sf):
    from .silver import silver_bundle
    out = None
    for days in (365, 252):
        b = silver_bundle(P.returns(spark, sf), days).withColumn("days", F.lit(days))
        out = b if out is None else out.unionByName(b)
    return out.withColumn("value", rounded("value"))


@query("f13_monthly_returns", sql("""
    SELECT strftime(ts, '%Y-%m') AS month, #coalesce(sum(CASE WHEN symbol = 'AFRICA' THEN r END), 0)# AS AFRICA,
      #coalesce(sum(CASE WHEN symbol = 'AMERICA' THEN r END), 0)# AS AMERICA, #coalesce(sum(CASE WHEN symbol = 'ASIA' THEN r END), 0)# AS ASIA,
      #coalesce(sum(CASE WHEN symbol = 'EUROPE' THEN r END), 0)# AS EUROPE,
      #coalesce(sum(CASE WHEN symbol = 'MIDDLE EAST' THEN r END), 0)# AS "MIDDLE EAST" FROM ret GROUP BY 1"""))
def _(spark, sf):
    from .silver import monthly_grid
    return r6(monthly_grid(P.returns(spark, sf), "symbol", P.symbols(spark, sf)), "month")


@query("f15_market_factor", sql("SELECT ts, #m# AS market FROM mkt"))
def _(spark, sf):
    return P.market(spark, sf).select("ts", rounded("m").alias("market"))


_ROLL = "OVER (PARTITION BY symbol_a, symbol_b ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"
_PAIRED = "(SELECT * FROM prs WHERE symbol_a < symbol_b)"


@query("f16_mean_pair_correlation", sql(f"""
    WITH x AS (SELECT ts, pos, covar_pop(x_a, x_b) {_ROLL} AS c, sqrt(var_pop(x_a) {_ROLL} * var_pop(x_b) {_ROLL}) AS d FROM {_PAIRED} AS p)
    SELECT ts, #avg(CASE WHEN pos >= 30 AND d > 1e-10 THEN c / d END)# AS mean_correlation FROM x GROUP BY 1"""))
def _(spark, sf):
    return r6(M.mean_pair_correlation(P.returns(spark, sf), 30), "ts")


_G1 = "n / ((n - 1.0) * (n - 2)) * sum(((r - m) / sd) ** 3)"
_G2 = "(n * (n + 1.0)) / ((n - 1.0) * (n - 2) * (n - 3)) * sum(((r - m) / sd) ** 4) - 3.0 * (n - 1) ** 2 / ((n - 2.0) * (n - 3))"


@query("f19_f22_sample_shape", sql(f"""
    WITH s AS (SELECT symbol, n, {_G1} AS g1, {_G2} AS g2 FROM ranked GROUP BY symbol, n)
    SELECT symbol, n, #g1# AS skewness, #g2# AS excess_kurtosis, #n / 6 * (g1 ** 2 + g2 ** 2 / 4)#4# AS jarque_bera,
      n / 6 * (g1 ** 2 + g2 ** 2 / 4) <= 5.991 AS is_normal FROM s"""))
def _(spark, sf):
    d = K.sample_shape(P.entities(spark, sf))
    return d.select("symbol", "n", rounded("skewness").alias("skewness"), rounded("excess_kurtosis").alias("excess_kurtosis"),
                    rounded("jarque_bera", 4).alias("jarque_bera"), "is_normal")


@query("f21_population_shape", sql("""
    SELECT symbol, #avg((r - m) ** 3) / max(sp) ** 3# AS skewness, #avg((r - m) ** 4) / max(sp) ** 4 - 3# AS excess_kurtosis
    FROM ranked GROUP BY 1"""))
def _(spark, sf):
    return r6(K.population_shape(P.entities(spark, sf)), "symbol")


@query("f23_omega", sql("""
    SELECT symbol, #sum(greatest(r - 0.01, 0)) / sum(greatest(0.01 - r, 0))# AS omega FROM ent GROUP BY 1"""))
def _(spark, sf):
    return r6(K.omega(P.entities(spark, sf), 0.01), "symbol")


@query("f24_f28_downside", sql("""
    WITH x AS (SELECT symbol, r, 0.05 / 365 AS f FROM ent)
    SELECT symbol, #sqrt(avg(greatest(0, f - r) ** 2)) * sqrt(365)# AS downside_deviation,
      #sqrt(avg(greatest(0, r - f) ** 2)) * sqrt(365)# AS upside_deviation,
      #sum(r) / abs(sum(CASE WHEN r < 0 THEN r ELSE 0 END))# AS gain_to_pain, count(*) AS n_periods,
      count(*) FILTER (WHERE r < 0) AS n_negative, count(*) FILTER (WHERE r > 0) AS n_positive, #min(r)# AS worst_return,
      #max(r)# AS best_return, #(avg(r) * 365 - 0.05) / (sqrt(avg(greatest(0, f - r) ** 2)) * sqrt(365))# AS sortino_ratio
    FROM x GROUP BY 1"""))
def _(spark, sf):
    return r6(K.downside(P.entities(spark, sf), 0.05, 365), "symbol", "n_periods", "n_negative", "n_positive")


def against_market(spark, sf):
    m = P.market(spark, sf).select("ts", F.col("m").alias("b"))
    return P.entities(spark, sf).select("symbol", "ts", F.col("r").alias("p")).join(m, "ts")


_BOTH = "both_ AS (SELECT symbol, r AS p, m AS b FROM ent JOIN mkt USING (ts))"


@query("f26_capture", sql(f"""WITH {_BOTH}
    SELECT symbol, #avg(CASE WHEN b > 0 THEN p END) / avg(CASE WHEN b > 0 THEN b END)# AS upside_capture,
      #avg(CASE WHEN b < 0 THEN p END) / avg(CASE WHEN b < 0 THEN b END)# AS downside_capture FROM both_ GROUP BY 1"""))
def _(spark, sf):
    return r6(K.capture(against_market(spark, sf), ["symbol"]), "symbol")


@query("f29_alpha_beta", sql(f"""WITH {_BOTH},
    a AS (SELECT symbol, count(*) AS n_periods, covar_samp(p, b) / var_samp(b) AS beta, corr(p, b) ** 2 AS r2, avg(p) - 0.05 / 365 AS mp,
          avg(b) - 0.05 / 365 AS mb, stddev_samp(p - b) * sqrt(365) AS te FROM both_ GROUP BY 1)
    SELECT symbol, n_periods, #beta# AS beta, #(mp - beta * mb) * 365# AS alpha_annual, #r2# AS r_squared, #te# AS tracking_error,
      #(mp - beta * mb) * 365 / te# AS information_ratio FROM a"""))
def _(spark, sf):
    return r6(K.alpha_beta(against_market(spark, sf), 0.05, 365, ["symbol"]), "symbol", "n_periods")


@query("f30_market_beta", sql("SELECT symbol, #covar_pop(r, m) / var_pop(m)# AS beta FROM ret JOIN mkt USING (ts) GROUP BY 1"))
def _(spark, sf):
    return r6(K.market_beta(P.returns(spark, sf), P.market(spark, sf)), "symbol")


_Z = "(sqrt(-2 * ln(1 - 0.95::DOUBLE)) - (2.515517 + 0.802853 * sqrt(-2 * ln(1 - 0.95::DOUBLE)) + 0.010328 * -2 * ln(1 - 0.95::DOUBLE)) / " \
     "(1 + 1.432788 * sqrt(-2 * ln(1 - 0.95::DOUBLE)) + 0.189269 * -2 * ln(1 - 0.95::DOUBLE) + 0.001308 * sqrt(-2 * ln(1 - 0.95::DOUBLE)) ** 3))"
_VAR = f"""h AS (SELECT *, CAST(floor((1 - 0.95::DOUBLE) * n) AS BIGINT) AS i, {_Z} AS z FROM ranked),
    m AS (SELECT symbol, max(n) AS n_observations, -max(CASE WHEN k = least(i, n - 1) + 1 THEN r END) AS hv,
      -avg(CASE WHEN k <= greatest(i, 1) THEN r END) AS hc, -(max(m) - max(z) * max(sd)) AS pv,
      -(max(m) - max(sd) * exp(-0.5 * max(z) ** 2) / sqrt(2 * pi()) / (1 - 0.95::DOUBLE)) AS pc, max(m) AS mean, max(sd) AS sd, max(z) AS z,
      avg((r - m) ** 3) / max(sp) ** 3 AS s, avg((r - m) ** 4) / max(sp) ** 4 - 3 AS k FROM h GROUP BY 1),
    c AS (SELECT *, -(mean - (z + (z * z - 1) * s / 6 + (z ** 3 - 3 * z) * k / 24 - (2 * z ** 3 - 5 * z) * s * s / 36) * sd) AS cv FROM m),
    t AS (SELECT c.symbol, -avg(e.r) AS cc FROM c JOIN ent e ON e.symbol = c.symbol AND e.r <= -c.cv GROUP BY 1)"""


@query("f33_f35_value_at_risk", sql(f"""WITH {_VAR}
    SELECT c.symbol, n_observations, #hv# AS historical_var, #hc# AS historical_cvar, #pv# AS parametric_var, #pc# AS parametric_cvar,
      #cv# AS cornish_fisher_var, #coalesce(cc, cv)# AS cornish_fisher_cvar FROM c LEFT JOIN t USING (symbol)"""))
def _(spark, sf):
    return r6(K.value_at_risk(P.entities(spark, sf)), "symbol", "n_observations")


@query("f36_var_comparison", sql(f"""WITH {_VAR}
    SELECT symbol, #coalesce(weight, 1)# AS weight, #hv# AS historical_var, #pv# AS parametric_var, #cv# AS cornish_fisher_var
    FROM c LEFT JOIN tw USING (symbol)"""))
def _(spark, sf):
    v = K.value_at_risk(P.entities(spark, sf)).join(P.target_weights(spark, sf), "symbol", "left").na.fill(1.0, ["weight"])
    return r6(v.select("symbol", "weight", "historical_var", "parametric_var", "cornish_fisher_var"), "symbol")


@query("f37_charted_var", sql("""
    WITH x AS (SELECT *, greatest(0, CAST(floor(n * (1 - 0.95::DOUBLE)) AS BIGINT) - 1) AS i FROM ranked)
    SELECT symbol, #max(CASE WHEN k = i + 1 THEN r END)# AS var, #avg(CASE WHEN k <= i + 1 THEN r END)# AS cvar FROM x GROUP BY 1"""))
def _(spark, sf):
    return r6(K.charted_var(P.entities(spark, sf)), "symbol")


@query("f38_histogram", sql("""
    WITH x AS (SELECT symbol, s, min(s) OVER (PARTITION BY symbol) AS lo, max(s) OVER (PARTITION BY symbol) AS hi FROM ret)
    SELECT symbol, CAST(least(floor((s - lo) / (hi - lo) * 40), 39) AS BIGINT) AS bin, count(*) AS n FROM x GROUP BY 1, 2"""))
def _(spark, sf):
    return K.histogram(P.returns(spark, sf))


_SHRINK = """c AS (SELECT symbol, r - avg(r) OVER (PARTITION BY symbol) AS d, ts FROM ret),
    p AS (SELECT a.symbol AS i, b.symbol AS j, a.d * b.d AS x FROM c a JOIN c b USING (ts)),
    s AS (SELECT i, j, count(*) AS n, sum(x) / (count(*) - 1) AS s FROM p GROUP BY 1, 2),
    v AS (SELECT s.*, sqrt(a.s * b.s) AS sd FROM s JOIN s a ON a.i = s.i AND a.j = s.i JOIN s b ON b.i = s.j AND b.j = s.j),
    g AS (SELECT *, CASE WHEN i = j THEN s ELSE sd * (SELECT avg(s / sd) FROM v WHERE i < j) END AS t FROM v),
    pi AS (SELECT sum(q) AS pi FROM (SELECT i, j, avg((x - s) ** 2) AS q FROM p JOIN s USING (i, j) GROUP BY 1, 2)),
    delta AS (SELECT greatest(0, least(1, max(pi) / (max(n) * sum((t - s) ** 2)))) AS d, max(n) AS n FROM g, pi)"""


@query("f41_shrunk_covariance", sql(f"""WITH {_SHRINK}
    SELECT i AS symbol_row, j AS symbol_col, #s#8# AS sample, #t#8# AS target, #d * t + (1 - d) * s#8# AS value FROM g, delta"""))
def _(spark, sf):
    return r6(M.shrunk_covariance(P.returns(spark, sf))[0], "symbol_row", "symbol_col", places=8)


@query("f41_shrinkage_intensity", sql(f"WITH {_SHRINK} SELECT #d# AS shrinkage, n AS n_observations FROM delta"))
def _(spark, sf):
    return r6(M.shrunk_covariance(P.returns(spark, sf))[1], "n_observations")


@query("j25_correlation_network", sql(f"""
    WITH c AS ({_COR}) SELECT symbol_row, symbol_col, #value# AS value, CASE WHEN value > 0 THEN 'positive' ELSE 'negative' END AS sign
    FROM c WHERE symbol_row < symbol_col AND abs(value) >= 0.05"""))
def _(spark, sf):
    return r6(M.correlation_edges(M.correlation(P.returns(spark, sf)), 0.05), "symbol_row", "symbol_col", "sign")


@query("j26_correlation_distance", sql(f"WITH c AS ({_COR}) SELECT symbol_row, symbol_col, #sqrt(0.5 * (1 - greatest(-1, least(1, value))))# AS value FROM c"))
def _(spark, sf):
    return r6(M.correlation_distance(M.correlation(P.returns(spark, sf))), "symbol_row", "symbol_col")


@query("g1_log_returns", sql("SELECT symbol, ts, #r# AS r FROM ret"))
def _(spark, sf):
    return r6(P.returns(spark, sf).select("symbol", "ts", "r"), "symbol", "ts")


@query("g3_simple_returns", sql("SELECT symbol, ts, #s# AS s FROM ret"))
def _(spark, sf):
    return r6(P.returns(spark, sf).select("symbol", "ts", "s"), "symbol", "ts")


@query("g5_rolling_correlation", sql(f"""
    SELECT symbol_a, symbol_b, ts, CASE WHEN pos >= 30 THEN #corr(x_a, x_b) {_ROLL}#4# END AS correlation FROM {_PAIRED} AS p"""))
def _(spark, sf):
    return r6(M.rolling_correlation(P.returns(spark, sf), 30), "symbol_a", "symbol_b", "ts", places=4)


@query("g6_rolling_correlation_pop", sql(f"""
    WITH x AS (SELECT symbol_a, symbol_b, ts, pos, covar_pop(x_a, x_b) {_ROLL} AS c, sqrt(var_pop(x_a) {_ROLL} * var_pop(x_b) {_ROLL}) AS d FROM {_PAIRED} AS p)
    SELECT symbol_a, symbol_b, ts, CASE WHEN pos >= 30 THEN #CASE WHEN d > 1e-10 THEN c / d ELSE 0 END# END AS correlation FROM x"""))
def _(spark, sf):
    return r6(M.rolling_correlation_pop(P.returns(spark, sf), 30).drop("pos"), "symbol_a", "symbol_b", "ts")


@query("g7_rolling_correlation_drifting", sql(f"""
    WITH x AS (SELECT symbol_a, symbol_b, ts, x_a - avg(x_a) {_ROLL} AS da, x_b - avg(x_b) {_ROLL} AS db FROM {_PAIRED} AS p),
    y AS (SELECT symbol_a, symbol_b, ts, avg(da * db) {_ROLL} AS c, sqrt(avg(da * da) {_ROLL}) AS sa, sqrt(avg(db * db) {_ROLL}) AS sb FROM x)
    SELECT symbol_a, symbol_b, ts, CASE WHEN sa > 0 AND sb > 0 THEN #c / (sa * sb)# END AS correlation FROM y"""))
def _(spark, sf):
    return r6(M.rolling_correlation_drifting(P.returns(spark, sf), 30), "symbol_a", "symbol_b", "ts")


_DD = """dd AS (SELECT symbol, ts, pos, round((close - peak) / peak, 8) + 0.0 AS drawdown, peak FROM (
      SELECT *, max(close) OVER (PARTITION BY symbol ORDER BY ts) AS peak FROM raw))"""


def _dd(spark, sf):
    return D.drawdown(P.numbered(spark, sf))


@query("g24_drawdown", sql(f"WITH {_DD} SELECT symbol, ts, #peak# AS peak, drawdown FROM dd"))
def _(spark, sf):
    return _dd(spark, sf).select("symbol", "ts", rounded("peak").alias("peak"), "drawdown")


_PERIODS = f"""{_DD}, i AS (SELECT *, count(*) FILTER (WHERE drawdown >= 0) OVER (PARTITION BY symbol ORDER BY ts) AS g FROM dd),
    per AS (SELECT symbol, g, min(pos) - 1 AS start_idx, max(pos) - 1 AS end_idx, min(ts) AS start_ts, max(ts) AS end_ts,
      min(drawdown) AS max_drawdown, arg_min(pos, (drawdown, pos)) - 1 AS trough_idx, arg_min(ts, (drawdown, pos)) AS trough_ts,
      count(*) AS duration FROM i WHERE drawdown < 0 GROUP BY 1, 2)"""


@query("g25_drawdown_periods", sql(f"""WITH {_PERIODS}
    SELECT per.symbol, start_idx, end_idx, trough_idx, start_ts, end_ts, trough_ts, round(max_drawdown, 6) AS max_drawdown, duration,
      raw.ts IS NOT NULL AS recovered, raw.ts AS recovery_ts, CAST(raw.pos - 1 AS DOUBLE) AS recovery_idx,
      CAST(raw.pos - 1 - trough_idx AS DOUBLE) AS recovery_duration
    FROM per LEFT JOIN raw ON raw.symbol = per.symbol AND raw.pos = end_idx + 2"""))
def _(spark, sf):
    d = D.drawdown_periods(_dd(spark, sf))
    return d.withColumns({"max_drawdown": rounded("max_drawdown"), "recovery_idx": F.col("recovery_idx").cast("double"),
                          "recovery_duration": F.col("recovery_duration").cast("double")})


@query("g26_drawdown_summary", sql(f"""WITH {_PERIODS}
    SELECT symbol, #min(drawdown)# AS max_drawdown, #avg(CASE WHEN drawdown < 0 THEN drawdown END)# AS avg_drawdown,
      (SELECT count(*) FROM per WHERE per.symbol = dd.symbol) AS n_periods,
      (SELECT max(duration) FROM per WHERE per.symbol = dd.symbol) AS longest_duration,
      #arg_max(drawdown, pos)# AS current_drawdown, #count(*) FILTER (WHERE drawdown < 0) / count(*)#4# AS time_in_drawdown FROM dd GROUP BY 1"""))
def _(spark, sf):
    d = r6(D.drawdown_summary(_dd(spark, sf)), "symbol", "n_periods", "longest_duration")
    return d.withColumn("time_in_drawdown", rounded("time_in_drawdown", 4))


_WEALTH = """w AS (SELECT symbol, pos, product(1 + r) OVER (PARTITION BY symbol ORDER BY pos) AS w, exp(sum(r) OVER (PARTITION BY symbol ORDER BY pos)) AS e FROM ent),
    pk AS (SELECT *, greatest(1, max(w) OVER (PARTITION BY symbol ORDER BY pos)) AS pw, greatest(1, max(e) OVER (PARTITION BY symbol ORDER BY pos)) AS pe FROM w)"""


@query("g27_compounded_drawdown", sql(f"WITH {_WEALTH} SELECT symbol, #max((pw - w) / pw)# AS max_drawdown FROM pk GROUP BY 1"))
def _(spark, sf):
    return r6(K.compounded_drawdown(P.entities(spark, sf)), "symbol")


@query("g28_log_drawdown", sql(f"WITH {_WEALTH} SELECT symbol, #max((pe - e) / pe)# AS max_drawdown FROM pk GROUP BY 1"))
def _(spark, sf):
    return r6(K.log_drawdown(P.entities(spark, sf)), "symbol")


@query("g29_calmar", sql(f"""WITH {_WEALTH}, d AS (SELECT symbol, max((pw - w) / pw) AS max_drawdown FROM pk GROUP BY 1)
    SELECT symbol, #max_drawdown# AS max_drawdown, #avg(r) * 365# AS annual_return, #avg(r) * 365 / max_drawdown# AS calmar
    FROM d JOIN ent USING (symbol) GROUP BY symbol, max_drawdown"""))
def _(spark, sf):
    return r6(K.calmar(P.entities(spark, sf), 365), "symbol")


@query("g30_cumulative_curve", sql("SELECT symbol, ts, #exp(sum(r) OVER (PARTITION BY symbol ORDER BY ts)) - 1# AS cumulative FROM ret"))
def _(spark, sf):
    return r6(K.cumulative_curve(P.returns(spark, sf)).select("symbol", "ts", "cumulative"), "symbol", "ts")


@query("g31_rebased", sql("SELECT symbol, ts, #close / first_value(close) OVER (PARTITION BY symbol ORDER BY ts)# AS rebased FROM panel"))
def _(spark, sf):
    return r6(K.rebased(P.weekly_bars(spark, sf)).select("symbol", "ts", "rebased"), "symbol", "ts")
