"""Queries: data contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rounded
from ..operators import moments as M
from ..operators import quality as Q
from . import panels as P
from .oracle import sql
from ..session import shared_dir
from .registry import query

_FLAWED = """SELECT symbol, CASE WHEN close >= 1 THEN ts END AS ts, CASE WHEN volume <> 17 THEN open END AS open, high,
    CASE WHEN volume > 11 THEN low ELSE high + 1 END AS low, CASE WHEN open < 150 THEN close ELSE -close END AS close,
    CASE WHEN open > 120 THEN -volume ELSE volume END AS volume FROM bars_h6"""


def flawed(spark, sf):
    """Six-hour bars with broken rows of every kind the contract knows."""
    b = P.event_bars(spark, sf, "6 hours")
    return b.select(
        "symbol", F.when(F.col("close") >= 1, F.col("ts")).alias("ts"), F.when(F.col("volume") != 17, F.col("open")).alias("open"),
        "high", F.when(F.col("volume") > 11, F.col("low")).otherwise(F.col("high") + 1).alias("low"),
        F.when(F.col("open") < 150, F.col("close")).otherwise(-F.col("close")).alias("close"),
        F.when(F.col("open") > 120, -F.col("volume")).otherwise(F.col("volume")).alias("volume"))


def _rule(name, count, source):
    return f"SELECT '{name}' AS rule, CAST({count} AS BIGINT) AS violations, ({count}) = 0 AS passed FROM {source}"


@query("l1_bronze_contract", sql(f"WITH f AS ({_FLAWED}) " + " UNION ALL ".join([
    _rule("ohlcv_schema", "0 * max(1)", "f"),
    _rule("no_null_ohlcv", "count(*) FILTER (WHERE open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL)", "f"),
    _rule("positive_close", "count(*) FILTER (WHERE close <= 0)", "f"),
    _rule("non_negative_volume", "count(*) FILTER (WHERE volume < 0)", "f"),
    _rule("high_gte_low", "count(*) FILTER (WHERE high < low)", "f"),
    _rule("timestamp_not_empty", "count(*) FILTER (WHERE ts IS NULL)", "f"),
    _rule("min_records", "count(*) FILTER (WHERE n < 110)", "(SELECT symbol, count(*) AS n FROM f GROUP BY 1)"),
])))
def _(spark, sf):
    return Q.bronze_contract(flawed(spark, sf), min_rows=110)


@query("l2_returns_range", sql("""
    WITH x AS (SELECT ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS r FROM bars_h6)
    SELECT 'returns_in_range' AS rule, count(*) FILTER (WHERE abs(r) > 1) AS violations, count(*) FILTER (WHERE abs(r) > 1) = 0 AS passed FROM x"""))
def _(spark, sf):
    from ..operators.align import with_returns
    return Q.returns_in_range(with_returns(P.event_bars(spark, sf, "6 hours")))


@query("l3_positive_volatility", sql(_rule("volatility_positive", "count(*) FILTER (WHERE vol IS NULL OR vol <= 0)", "mu")))
def _(spark, sf):
    return Q.positive_volatility(M.mean_vol(P.returns(spark, sf), 365).withColumnRenamed("volatility", "vol"))


_COR = """SELECT symbol_a AS symbol_row, symbol_b AS symbol_col, CASE WHEN symbol_a = symbol_b THEN 1.0 ELSE corr(x_a, x_b) END AS value
    FROM prs GROUP BY 1, 2"""
_MIRROR = "(SELECT a.*, b.value AS mirror FROM c a LEFT JOIN c b ON a.symbol_row = b.symbol_col AND a.symbol_col = b.symbol_row)"


@query("l4_correlation_rules", sql(f"WITH c AS ({_COR}) " + " UNION ALL ".join([
    _rule("correlation_symmetric", "count(*) FILTER (WHERE mirror IS NULL OR abs(value - mirror) > 1e-9)", _MIRROR),
    _rule("correlation_diagonal_one", "count(*) FILTER (WHERE symbol_row = symbol_col AND abs(value - 1) > 1e-9)", "c"),
    _rule("correlation_in_range", "count(*) FILTER (WHERE abs(value) > 1 + 1e-9)", "c")])))
def _(spark, sf):
    return Q.correlation_rules(M.correlation(P.returns(spark, sf)))


@query("l5_covariance_rules", sql(f"WITH c AS (SELECT * FROM cov WHERE symbol_row <> 'ASIA' OR symbol_col <> 'EUROPE') " + _rule(
    "covariance_symmetric", "count(*) FILTER (WHERE mirror IS NULL OR abs(value - mirror) > 1e-9)", _MIRROR)))
def _(spark, sf):
    return Q.covariance_rules(M.covariance(P.returns(spark, sf), 365).filter("symbol_row <> 'ASIA' or symbol_col <> 'EUROPE'"))


@query("l6_gold_contract", sql("WITH w AS (SELECT CASE WHEN symbol = 'ASIA' THEN -weight ELSE weight END AS weight FROM tw) " + " UNION ALL ".join([
    _rule("weights_sum_to_one", "CASE WHEN abs(sum(weight) - 1) > 1e-6 THEN 1 ELSE 0 END", "w"),
    _rule("weights_non_negative", "count(*) FILTER (WHERE weight < 0)", "w"),
    _rule("weights_bounded", "count(*) FILTER (WHERE weight < 0 OR weight > 1)", "w"),
    _rule("has_expected_return", "count(*) FILTER (WHERE mu IS NULL)", "mu"), _rule("has_volatility", "count(*) FILTER (WHERE vol IS NULL)", "mu"),
    _rule("has_sharpe_ratio", "count(*) FILTER (WHERE symbol = 'ASIA')", "mu")])))
def _(spark, sf):
    w = P.target_weights(spark, sf).withColumn("weight", F.when(F.col("symbol") == "ASIA", -F.col("weight")).otherwise(F.col("weight")))
    path = shared_dir(spark, "gold")
    ratio = F.when(F.col("symbol") != "ASIA", F.try_divide("mean_return", "volatility"))
    M.mean_vol(P.returns(spark, sf), 365).select(F.col("mean_return").alias("expected_return"), "volatility", ratio.alias("sharpe_ratio")).write.parquet(path)
    return Q.gold_contract(w, spark.read.parquet(path))


@query("l7_stage_summary", sql(f"""
    WITH f AS ({_FLAWED}), c AS ({_COR}), x AS (
      SELECT (SELECT count(*) = 0 FROM f WHERE open IS NULL) AS a, (SELECT count(*) = 0 FROM f WHERE close <= 0) AS b,
        (SELECT count(*) = 0 FROM f WHERE volume < 0) AS d, (SELECT count(*) = 0 FROM f WHERE high < low) AS e,
        (SELECT count(*) = 0 FROM f WHERE ts IS NULL) AS g, (SELECT min(n) >= 2 FROM (SELECT count(*) AS n FROM f GROUP BY symbol)) AS h)
    SELECT 'bronze' AS stage, a AND b AND d AND e AND g AND h AS passed,
      CAST(1 + a::INT + b::INT + d::INT + e::INT + g::INT + h::INT AS VARCHAR) || '/7 checks passed' AS summary FROM x
    UNION ALL SELECT 'silver', false, CAST(4 + (SELECT (count(*) FILTER (WHERE abs(r) > 1) = 0)::INT FROM ret) AS VARCHAR) || '/6 checks passed'
    UNION ALL SELECT 'gold', true, '3/3 checks passed'"""))
def _(spark, sf):
    r = P.returns(spark, sf)
    rules = Q.check_stage("bronze", {"bars": flawed(spark, sf)}).unionByName(
        Q.check_stage("silver", {"returns": r, "correlation": M.correlation(r), "covariance": M.covariance(r, 365), "beta": r})
    ).unionByName(Q.check_stage("gold", {"weights": P.target_weights(spark, sf)}))
    return Q.check_summary(rules)


@query("l8_column_tests", " UNION ALL ".join([
    _rule("not_null_o_orderkey", "count(*) FILTER (WHERE o_orderkey IS NULL)", "orders"),
    _rule("not_null_o_custkey", "count(*) FILTER (WHERE o_custkey IS NULL)", "orders"),
    _rule("unique_o_orderkey", "count(*) FILTER (WHERE n > 1)", "(SELECT o_orderkey, count(*) AS n FROM orders GROUP BY 1)"),
    _rule("unique_o_custkey", "count(*) FILTER (WHERE n > 1)", "(SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")]))
def _(spark, sf):
    return Q.column_tests(P.table(spark, sf, "orders"), ["o_orderkey", "o_custkey"], ["o_orderkey", "o_custkey"])


@query("l9_negative_volume", sql(f"WITH f AS ({_FLAWED}) SELECT symbol, ts, volume FROM f WHERE volume < 0"))
def _(spark, sf):
    return Q.negative_volumes(flawed(spark, sf)).select("symbol", "ts", "volume")


@query("l10_completeness", sql("""
    WITH b AS (SELECT * FROM bars_h6 WHERE close > 5), e AS (SELECT date_diff('day', min(CAST(ts AS DATE)), max(CAST(ts AS DATE))) + 1 AS d FROM b)
    SELECT symbol, date_diff('second', max(ts), TIMESTAMP '2024-01-31 12:00:00') / 3600 < 24 AS is_fresh,
      #count(DISTINCT CAST(ts AS DATE)) / max(d)# AS completeness, count(*) >= 100 AS enough_rows FROM b, e GROUP BY 1"""))
def _(spark, sf):
    out = Q.completeness(P.event_bars(spark, sf, "6 hours").filter("close > 5"), "2024-01-31 12:00:00", 100)
    return out.withColumn("completeness", rounded("completeness"))


@query("l11_quarantine", sql(f"""
    WITH f AS ({_FLAWED}) SELECT symbol, ts, close, coalesce(ts IS NOT NULL AND open IS NOT NULL AND close > 0 AND volume >= 0 AND high >= low, false)
      AS accepted FROM f"""))
def _(spark, sf):
    good, bad = shared_dir(spark, "accepted"), shared_dir(spark, "quarantine")
    Q.write_quarantine(flawed(spark, sf), good, bad)
    both = [spark.read.parquet(path).withColumn("accepted", F.lit(ok)) for path, ok in ((good, True), (bad, False))]
    return both[0].unionByName(both[1]).select("symbol", "ts", "close", "accepted")
