"""Queries: rolling measures, signals, regimes, factors and pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rounded
from ..operators import factors as X
from ..operators import moments as M
from ..operators import pairs as C
from ..operators import signals as S
from . import panels as P
from .oracle import sql
from .q_risk import r6
from .registry import query


def _w(n, by="symbol"):
    return f"OVER (PARTITION BY {by} ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@query("g8_volatility_surface", sql("""
    WITH x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM ret), w AS (SELECT unnest([7, 14, 30, 60, 90]) AS n)
    SELECT symbol, n AS window, #stddev_samp(r)# AS volatility FROM x, w WHERE k <= n GROUP BY 1, 2"""))
def _(spark, sf):
    return r6(S.volatility_surface(P.returns(spark, sf)), "symbol", "window")


@query("g9_rolling_volatility", sql(f"SELECT symbol, ts, CASE WHEN pos >= 30 THEN #stddev_pop(r) {_w(30)} * sqrt(365)# END AS volatility FROM ret"))
def _(spark, sf):
    return r6(S.rolling_volatility(P.returns(spark, sf), 30, 365), "symbol", "ts")


@query("g10_realised_volatility", sql("""
    SELECT symbol, #stddev_samp(r) * sqrt(365)# AS volatility FROM (
      SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM ret) WHERE k <= 20 GROUP BY 1"""))
def _(spark, sf):
    return r6(S.realised_volatility(P.returns(spark, sf)), "symbol")


@query("g11_rolling_sharpe", sql("""
    SELECT ts, #CASE WHEN sd > 1e-10 THEN (m - 0.05 / 365) / sd * sqrt(365) ELSE 0 END# AS rolling_sharpe FROM (
      SELECT ts, pos, avg(r) OVER w AS m, stddev_pop(r) OVER w AS sd FROM pr
      WINDOW w AS (ORDER BY ts ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)) WHERE pos > 30"""))
def _(spark, sf):
    return r6(S.rolling_sharpe(P.portfolio_returns(spark, sf), 30, 0.05, 365), "ts")


@query("g12_sma", sql(f"SELECT symbol, ts, CASE WHEN pos >= 20 THEN #avg(close) {_w(20)}# END AS sma FROM raw"))
def _(spark, sf):
    return r6(S.moving_average(P.numbered(spark, sf), 20).select("symbol", "ts", "sma"), "symbol", "ts")


@query("g13_moving_average_7", sql(f"SELECT symbol, ts, #avg(close) {_w(7)}# AS sma FROM raw"))
def _(spark, sf):
    return r6(S.moving_average(P.numbered(spark, sf), 7, full=False).select("symbol", "ts", "sma"), "symbol", "ts")


_BANDS = f"""bands AS (SELECT symbol, ts, pos, close, CASE WHEN pos >= 20 THEN avg(close) {_w(20)} END AS middle,
    CASE WHEN pos >= 20 THEN avg(close) {_w(20)} + 2 * stddev_pop(close) {_w(20)} END AS upper,
    CASE WHEN pos >= 20 THEN avg(close) {_w(20)} - 2 * stddev_pop(close) {_w(20)} END AS lower FROM raw)"""


@query("g14_bollinger", sql(f"WITH {_BANDS} SELECT symbol, ts, #middle# AS middle, #upper# AS upper, #lower# AS lower FROM bands"))
def _(spark, sf):
    return r6(S.bollinger(P.numbered(spark, sf)).select("symbol", "ts", "middle", "upper", "lower"), "symbol", "ts")


def _ema_sql(name, source, value, window, pos="pos"):
    """Recursive fold over row numbers."""
    return f"""{name}_seed AS (SELECT symbol, avg({value}) AS e FROM {source} WHERE {pos} BETWEEN 1 AND {window} GROUP BY 1),
    {name} AS (SELECT symbol, CAST({window} AS BIGINT) AS p, e FROM {name}_seed UNION ALL
      SELECT x.symbol, x.{pos}, ({value} - {name}.e) * (2.0::DOUBLE / {window + 1}) + {name}.e FROM {name} JOIN {source} x ON x.symbol = {name}.symbol AND x.{pos} = {name}.p + 1)"""


def _wilder_sql(name, value, window=14):
    return f"""{name} AS (SELECT symbol, CAST({window} AS BIGINT) AS p, (SELECT avg({value}) FROM dl y WHERE y.symbol = x.symbol AND y.k BETWEEN 1 AND {window}) AS e
      FROM (SELECT DISTINCT symbol FROM dl) x UNION ALL
      SELECT x.symbol, x.k, ({name}.e * {window - 1} + x.{value}) / {window} FROM {name} JOIN dl x ON x.symbol = {name}.symbol AND x.k = {name}.p + 1)"""


_RSI = f"""dl AS (SELECT symbol, pos - 1 AS k, greatest(d, 0) AS up, greatest(-d, 0) AS down FROM (
      SELECT *, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS d FROM raw) WHERE d IS NOT NULL),
    {_wilder_sql('gain', 'up')}, {_wilder_sql('loss', 'down')},
    rsi AS (SELECT symbol, g.p + 1 AS pos, CASE WHEN l.e = 0 THEN 100 ELSE 100 - 100 / (1 + g.e / l.e) END AS rsi
      FROM gain g JOIN loss l USING (symbol, p))"""
_MACD = f"""{_ema_sql('ef', 'raw', 'close', 12)}, {_ema_sql('es', 'raw', 'close', 26)},
    macd AS (SELECT symbol, p - 25 AS k, p AS pos, ef.e - es.e AS m FROM ef JOIN es USING (symbol, p)),
    {_ema_sql('sg', 'macd', 'm', 9, 'k')},
    hist AS (SELECT macd.symbol, macd.pos, m, m - sg.e AS h FROM macd LEFT JOIN sg ON sg.symbol = macd.symbol AND sg.p = macd.k)"""


@query("g15_ema", sql(f"WITH {_ema_sql('e', 'raw', 'close', 12)} SELECT raw.symbol, raw.ts, #e.e# AS ema FROM raw LEFT JOIN e ON e.symbol = raw.symbol AND e.p = raw.pos", recursive=True))
def _(spark, sf):
    return r6(S.ema(P.numbered(spark, sf), 12).select("symbol", "ts", "ema"), "symbol", "ts")


@query("g16_rsi", sql(f"WITH {_RSI} SELECT raw.symbol, raw.ts, #rsi# AS rsi FROM raw LEFT JOIN rsi ON rsi.symbol = raw.symbol AND rsi.pos = raw.pos", recursive=True))
def _(spark, sf):
    return r6(S.rsi(P.numbered(spark, sf)).select("symbol", "ts", "rsi"), "symbol", "ts")


@query("g17_macd", sql(f"""WITH {_MACD} SELECT raw.symbol, raw.ts, #m# AS macd, #h# AS histogram,
    CASE WHEN h > 0 THEN 'BUY' WHEN h < 0 THEN 'SELL' WHEN h = 0 THEN 'HOLD' END AS macd_signal
    FROM raw LEFT JOIN hist ON hist.symbol = raw.symbol AND hist.pos = raw.pos""", recursive=True))
def _(spark, sf):
    return r6(S.macd_signal(P.numbered(spark, sf)).select("symbol", "ts", "macd", "histogram", "macd_signal"), "symbol", "ts", "macd_signal")


_CROSS = f"""crs AS (SELECT symbol, ts, pos, CASE WHEN pos < 30 THEN NULL WHEN avg(close) {_w(10)} > avg(close) {_w(30)} THEN 'BUY'
    WHEN avg(close) {_w(10)} < avg(close) {_w(30)} THEN 'SELL' ELSE 'HOLD' END AS sma_signal FROM raw)"""
_BOLL = "bol AS (SELECT symbol, ts, pos, CASE WHEN upper IS NULL THEN NULL WHEN close > upper THEN 'BUY' WHEN close < lower THEN 'SELL' ELSE 'HOLD' END AS bollinger_signal FROM bands)"


@query("g18_crossing_signal", sql(f"WITH {_CROSS} SELECT symbol, ts, sma_signal FROM crs"))
def _(spark, sf):
    return S.crossing_signal(P.numbered(spark, sf)).select("symbol", "ts", "sma_signal")


@query("g19_rsi_signal", sql(f"""WITH {_RSI} SELECT raw.symbol, raw.ts, CASE WHEN rsi >= 70 THEN 'SELL' WHEN rsi <= 30 THEN 'BUY' WHEN rsi IS NOT NULL THEN 'HOLD' END AS rsi_signal
    FROM raw LEFT JOIN rsi ON rsi.symbol = raw.symbol AND rsi.pos = raw.pos""", recursive=True))
def _(spark, sf):
    return S.rsi_signal(P.numbered(spark, sf)).select("symbol", "ts", "rsi_signal")


@query("g20_bollinger_signal", sql(f"WITH {_BANDS}, {_BOLL} SELECT symbol, ts, bollinger_signal FROM bol"))
def _(spark, sf):
    return S.bollinger_signal(P.numbered(spark, sf)).select("symbol", "ts", "bollinger_signal")


_LATEST = f"""{_CROSS}, {_BANDS}, {_BOLL}, {_RSI}, {_MACD},
    latest AS (SELECT crs.symbol, arg_max(sma_signal, crs.pos) AS sma_signal, arg_max(bollinger_signal, crs.pos) AS bollinger_signal,
      arg_max(CASE WHEN rsi >= 70 THEN 'SELL' WHEN rsi <= 30 THEN 'BUY' WHEN rsi IS NOT NULL THEN 'HOLD' END, crs.pos) AS rsi_signal,
      arg_max(CASE WHEN h > 0 THEN 'BUY' WHEN h < 0 THEN 'SELL' WHEN h = 0 THEN 'HOLD' END, crs.pos) AS macd_signal,
      arg_max(rsi, crs.pos) AS rsi_value, max(crs.pos) AS n_periods
      FROM crs JOIN bol USING (symbol, pos) LEFT JOIN rsi USING (symbol, pos) LEFT JOIN hist USING (symbol, pos) GROUP BY 1),
    votes AS (SELECT *, list_sum(list_transform([sma_signal, bollinger_signal, rsi_signal, macd_signal],
      lambda v: CASE v WHEN 'BUY' THEN 1 WHEN 'SELL' THEN -1 ELSE 0 END)) AS score FROM latest),
    board AS (SELECT *, CASE WHEN score > 0 THEN 'BUY' WHEN score < 0 THEN 'SELL' ELSE 'HOLD' END AS combined FROM votes)"""


@query("g21_latest_signals", sql(f"""WITH {_LATEST} SELECT symbol, sma_signal, bollinger_signal, rsi_signal, macd_signal, #rsi_value#2# AS rsi_value,
    n_periods, combined FROM board""", recursive=True))
def _(spark, sf):
    return S.latest_signals(P.numbered(spark, sf)).withColumn("rsi_value", rounded("rsi_value", 2))


@query("g22_signal_board", sql(f"""WITH {_LATEST} SELECT symbol, combined, CAST(CASE combined WHEN 'BUY' THEN 0 WHEN 'HOLD' THEN 1 ELSE 2 END AS INT) AS board_order
    FROM board WHERE n_periods >= 30 ORDER BY board_order, symbol""", recursive=True))
def _(spark, sf):
    return S.signal_board(P.numbered(spark, sf)).select("symbol", "combined", "board_order")


@query("f40_signal_counts", sql(f"""WITH {_LATEST} SELECT count(*) FILTER (WHERE combined = 'BUY') AS buy_count,
    count(*) FILTER (WHERE combined = 'SELL') AS sell_count, count(*) FILTER (WHERE combined = 'HOLD') AS hold_count, count(*) AS total
    FROM board WHERE n_periods >= 30""", recursive=True))
def _(spark, sf):
    return S.signal_counts(S.signal_board(P.numbered(spark, sf)))


_REGIME = f"""rr AS (SELECT symbol, ts, pos - 1 AS pos, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS r FROM raw),
    v AS (SELECT symbol, ts, pos, stddev_samp(r) {_w(20)} * sqrt(365) AS v FROM rr),
    mv AS (SELECT symbol, median(v) AS median_vol, arg_max(v, pos) AS current_vol FROM v WHERE pos >= 20 GROUP BY 1),
    tr AS (SELECT symbol, max(pos) AS n_periods, arg_max(close, pos) AS price, arg_max(s20, pos) AS s20, arg_max(s50, pos) AS s50 FROM (
      SELECT *, avg(close) {_w(20)} AS s20, avg(close) {_w(50)} AS s50 FROM raw) GROUP BY 1),
    st AS (SELECT *, s20 > s50 AS up, price > s50 AS above, current_vol > median_vol * 1.2 AS high FROM tr JOIN mv USING (symbol)),
    reg AS (SELECT symbol, CASE WHEN up AND above THEN 'BULL' WHEN NOT up AND NOT above THEN 'BEAR' ELSE 'SIDEWAYS' END AS regime,
      CASE WHEN up = above THEN CASE WHEN high THEN 0.7 ELSE 1.0 END ELSE 0.5 END::DOUBLE AS confidence,
      CASE WHEN up THEN 'BULLISH' WHEN s20 < s50 THEN 'BEARISH' ELSE 'NEUTRAL' END AS trend_signal,
      CASE WHEN high THEN 'HIGH' ELSE 'LOW' END AS vol_regime, s20 AS short_sma, s50 AS long_sma, current_vol, median_vol, n_periods FROM st)"""


@query("g23_regimes", sql(f"""WITH {_REGIME} SELECT symbol, regime, confidence, trend_signal, vol_regime, #short_sma#4# AS short_sma,
    #long_sma#4# AS long_sma, #current_vol# AS current_vol, #median_vol# AS median_vol, n_periods FROM reg"""))
def _(spark, sf):
    d = S.regimes(P.numbered(spark, sf))
    return d.withColumns({c: rounded(c, k) for c, k in (("short_sma", 4), ("long_sma", 4), ("current_vol", 6), ("median_vol", 6))})


@query("f40_market_state", sql(f"""WITH {_REGIME}, c AS (SELECT count(*) FILTER (WHERE regime = 'BULL') AS bull_count,
      count(*) FILTER (WHERE regime = 'BEAR') AS bear_count, count(*) FILTER (WHERE regime = 'SIDEWAYS') AS sideways_count, count(*) AS n_assets FROM reg)
    SELECT *, CASE WHEN bull_count > bear_count AND bull_count > sideways_count THEN 'BULL' WHEN bear_count > bull_count AND bear_count > sideways_count
      THEN 'BEAR' ELSE 'SIDEWAYS' END AS market_regime FROM c"""))
def _(spark, sf):
    return S.market_state(S.regimes(P.numbered(spark, sf)))


_FACTORS = """sc AS (SELECT symbol, ts, pos, s, product(1 + s) OVER w - 1 AS mo, stddev_samp(s) OVER w AS vo FROM ret
      WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
    rk AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY mo DESC, symbol) AS km, row_number() OVER (PARTITION BY ts ORDER BY vo, symbol) AS kv,
      count(*) OVER (PARTITION BY ts) // 2 AS half FROM sc WHERE pos > 20),
    fac AS (SELECT ts, avg(s) AS market, avg(CASE WHEN km <= half THEN s END) - avg(CASE WHEN km > half THEN s END) AS momentum,
      avg(CASE WHEN kv <= half THEN s END) - avg(CASE WHEN kv > half THEN s END) AS volatility FROM rk GROUP BY 1)"""


@query("g32_momentum_factor", sql(f"WITH {_FACTORS} SELECT ts, #momentum# AS momentum FROM fac"))
def _(spark, sf):
    return r6(X.momentum_factor(P.returns(spark, sf)).drop("pos"), "ts")


@query("g33_volatility_factor", sql(f"WITH {_FACTORS} SELECT ts, #volatility# AS volatility FROM fac"))
def _(spark, sf):
    return r6(X.volatility_factor(P.returns(spark, sf)).drop("pos"), "ts")


# The check solves the regression another way: each factor is cleared of the earlier ones, one after another.
_FWL = f"""{_FACTORS}, d AS (SELECT symbol, ts, s AS y, market AS f1, momentum AS f2, volatility AS f3 FROM rk JOIN fac USING (ts)),
    a1 AS (SELECT symbol, regr_slope(f2, f1) AS b21, avg(f1) AS m1, avg(f2) AS m2, avg(f3) AS m3, avg(y) AS my, regr_slope(f3, f1) AS b31, regr_slope(y, f1) AS by1, count(*) AS n, var_pop(y) AS vy FROM d GROUP BY 1),
    e1 AS (SELECT d.symbol, n, vy, m1, m2, m3, my, b21, b31, by1, f2 - m2 - b21 * (f1 - m1) AS u2, f3 - m3 - b31 * (f1 - m1) AS u3, y - my - by1 * (f1 - m1) AS uy FROM d JOIN a1 USING (symbol)),
    a2 AS (SELECT symbol, regr_slope(u3, u2) AS b32, regr_slope(uy, u2) AS by2 FROM e1 GROUP BY 1),
    e2 AS (SELECT e1.*, b32, by2, u3 - b32 * u2 AS v3, uy - by2 * u2 AS vy2 FROM e1 JOIN a2 USING (symbol)),
    a3 AS (SELECT symbol, max(n) AS n, max(vy) AS vy, max(m1) AS m1, max(m2) AS m2, max(m3) AS m3, max(my) AS my, max(b21) AS b21, max(b31) AS b31,
      max(by1) AS by1, max(b32) AS b32, max(by2) AS by2, regr_slope(vy2, v3) AS c3, regr_syy(vy2, v3) - regr_slope(vy2, v3) * regr_sxy(vy2, v3) AS ssr FROM e2 GROUP BY 1),
    c AS (SELECT *, by2 - c3 * b32 AS c2 FROM a3), k AS (SELECT *, by1 - c2 * b21 - c3 * b31 AS c1 FROM c)"""


@query("f32_g34_factor_model", sql(f"""WITH {_FWL} SELECT symbol, #my - c1 * m1 - c2 * m2 - c3 * m3# AS alpha, #c1# AS beta_market, #c2# AS beta_momentum,
    #c3# AS beta_volatility, #greatest(0, least(1, 1 - ssr / (vy * n)))# AS r_squared, #sqrt(ssr / (n - 4))# AS residual_std, n FROM k"""))
def _(spark, sf):
    return r6(X.factor_model(P.returns(spark, sf)), "symbol", "n")


_COINT = """px AS (SELECT symbol, ts, pos, close, 100 * product(1 + coalesce(r, 0)) OVER (PARTITION BY symbol ORDER BY ts) AS price FROM silver),
    pp AS (SELECT a.symbol AS symbol_a, b.symbol AS symbol_b, a.ts, a.pos, a.price AS x_a, b.price AS x_b, a.close AS c_a, b.close AS c_b
      FROM px a JOIN px b ON a.ts = b.ts AND a.symbol < b.symbol),
    ft AS (SELECT symbol_a, symbol_b, regr_slope(x_a, x_b) AS slope, regr_intercept(x_a, x_b) AS intercept, count(*) AS n FROM pp GROUP BY 1, 2),
    rs AS (SELECT symbol_a, symbol_b, ts, pos, x_a - intercept - slope * x_b AS e FROM pp JOIN ft USING (symbol_a, symbol_b)),
    lg AS (SELECT *, lag(e) OVER (PARTITION BY symbol_a, symbol_b ORDER BY ts) AS l FROM rs),
    ad AS (SELECT symbol_a, symbol_b, regr_slope(e - l, l) AS b, sqrt((regr_syy(e - l, l) - regr_slope(e - l, l) * regr_sxy(e - l, l)) / (count(l) - 2) / regr_sxx(e - l, l)) AS se
      FROM lg WHERE l IS NOT NULL GROUP BY 1, 2)"""


@query("f31_pair_regression", sql(f"WITH {_COINT} SELECT symbol_a, symbol_b, ts, #e# AS residual, #slope# AS slope, #intercept# AS intercept FROM rs JOIN ft USING (symbol_a, symbol_b)"))
def _(spark, sf):
    from ..operators.align import symbol_pairs
    pairs = symbol_pairs(C.price_index(P.silver(spark, sf)), "price")
    d = C.residuals(pairs, C.fitted_pairs(pairs))
    return r6(d.select("symbol_a", "symbol_b", "ts", "residual", "slope", "intercept"), "symbol_a", "symbol_b", "ts")


@query("g35_spread", sql(f"WITH {_COINT} SELECT symbol_a, symbol_b, ts, #c_a - slope * c_b# AS spread FROM pp JOIN ft USING (symbol_a, symbol_b)"))
def _(spark, sf):
    silver = P.silver(spark, sf)
    d = C.spreads(silver, C.cointegrated_pairs(silver))
    return r6(d.select("symbol_a", "symbol_b", "ts", "spread"), "symbol_a", "symbol_b", "ts")


_ZW = "OVER (PARTITION BY symbol_a, symbol_b ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@query("g36_spread_signals", sql(f"""WITH {_COINT}, sp AS (SELECT symbol_a, symbol_b, ts, pos, c_a - slope * c_b AS s FROM pp JOIN ft USING (symbol_a, symbol_b)),
    z AS (SELECT *, CASE WHEN pos >= 20 THEN (s - avg(s) {_ZW}) / stddev_samp(s) {_ZW} ELSE 0 END AS z FROM sp)
    SELECT symbol_a, symbol_b, ts, pos - 1 AS period, #z#4# AS z_score, CASE WHEN z < -2 THEN 'long' WHEN z > 2 THEN 'short' ELSE 'neutral' END AS signal
    FROM z QUALIFY row_number() OVER (PARTITION BY symbol_a, symbol_b ORDER BY ts DESC) <= 10"""))
def _(spark, sf):
    silver = P.silver(spark, sf)
    d = C.spread_signals(C.spreads(silver, C.cointegrated_pairs(silver)))
    return d.withColumn("z_score", rounded("z_score", 4))


@query("g37_unit_root", sql("""
    WITH l AS (SELECT symbol, close, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS l FROM silver)
    SELECT symbol, #regr_slope(close - l, l) / sqrt((regr_syy(close - l, l) - regr_slope(close - l, l) * regr_sxy(close - l, l)) / (count(l) - 2) / regr_sxx(close - l, l))# AS statistic
    FROM l WHERE l IS NOT NULL GROUP BY 1"""))
def _(spark, sf):
    return r6(C.unit_root_statistic(P.silver(spark, sf), "close", ("symbol",)), "symbol")


@query("g38_cointegration_scan", sql(f"""WITH {_COINT} SELECT symbol_a, symbol_b, #b / se#4# AS adf_statistic, #slope# AS hedge_ratio, b / se < -3.34 AS is_cointegrated
    FROM ad JOIN ft USING (symbol_a, symbol_b) WHERE n >= 50"""))
def _(spark, sf):
    d = C.cointegrated_pairs(P.silver(spark, sf))
    return d.withColumns({"adf_statistic": rounded("adf_statistic", 4), "hedge_ratio": rounded("hedge_ratio")})


@query("i3_rolling_latest", sql(f"""SELECT symbol_a, symbol_b, #corr(x_a, x_b)#4# AS correlation FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol_a, symbol_b ORDER BY ts DESC) AS k FROM prs WHERE symbol_a < symbol_b) WHERE k <= 30 GROUP BY 1, 2"""))
def _(spark, sf):
    d = M.rolling_correlation(P.returns(spark, sf), 30)
    return r6(d.groupBy("symbol_a", "symbol_b").agg(F.max_by("correlation", "ts").alias("correlation")), "symbol_a", "symbol_b", places=4)
