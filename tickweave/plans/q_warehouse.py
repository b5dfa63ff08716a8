"""Queries: scalar columns, calendar, marts, summaries, joins to dimensions, sorts and set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import (
    RANGES, asset_class, calendar, calendar_extended, finite, invested, is_crypto, log_return, normal_density,
    normal_quantile, null_safe_return, range_cutoff, rounded,
)
from ..operators import align as A
from ..operators import warehouse as H
from ..sources.readers import month_files, zone_size
from ..sources.writers import write_bars
from ..session import shared_dir
from ..timeline import number_rows, trailing
from . import panels as P
from .oracle import sql
from .q_sources import _DAILY_SQL, _INDEX_SQL, segment_daily, segment_index
from .registry import query


@query("c1_free_sql", sql("""
    SELECT symbol, count(*) AS n_rows, max(close) AS max_close FROM bars_d WHERE volume > 60 GROUP BY 1"""))
def _(spark, sf):
    return spark.sql(
        "SELECT symbol, count(*) AS n_rows, max(close) AS max_close FROM {bars} WHERE volume > :floor GROUP BY symbol",
        args={"floor": 60}, bars=P.event_bars(spark, sf))


@query("c2_safe_log_return", sql("""
    SELECT symbol, ts, CASE WHEN p > 0 THEN #ln(close / p)# END AS log_return FROM (
      SELECT symbol, ts, close, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM bars_d)"""))
def _(spark, sf):
    d = H.previous_close(P.event_bars(spark, sf))
    return d.select("symbol", "ts", rounded(log_return("close", "prev_close")).alias("log_return"))


_CUTS = {
    "1D": "m - INTERVAL 1 DAY", "3D": "m - INTERVAL 3 DAY", "5D": "m - INTERVAL 5 DAY", "1W": "m - INTERVAL 7 DAY",
    "MTD": "date_trunc('month', m) + (m - date_trunc('day', m))", "1M": "m - INTERVAL 1 MONTH",
    "3M": "m - INTERVAL 3 MONTH", "6M": "m - INTERVAL 6 MONTH",
    "YTD": "date_trunc('year', m) + (m - date_trunc('day', m))", "1Y": "m - INTERVAL 12 MONTH", "All": "TIMESTAMP '1900-01-01'",
}


@query("c3_range_selector", "WITH x AS (SELECT max(o_orderdate) AS m FROM orders)\n" + " UNION ALL ".join(
    f"SELECT '{n}' AS range, count(*) AS n_rows, min(o_orderdate) AS first_ts FROM orders, x WHERE o_orderdate >= {c}"
    for n, c in _CUTS.items()))
def _(spark, sf):
    days = P.table(spark, sf, "orders").groupBy(F.col("o_orderdate").alias("ts")).agg(F.count(F.lit(1)).alias("n"))
    latest = days.agg(F.max("ts")).scalar()
    wide = []
    for name in RANGES:
        cut = range_cutoff(name, latest)
        kept = F.lit(True) if cut is None else F.col("ts") >= cut
        wide += [F.sum(F.when(kept, F.col("n"))).alias(f"n_{name}"), F.min(F.when(kept, F.col("ts"))).alias(f"t_{name}")]
    one = days.agg(*wide)
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("range"), F.col(f"n_{n}").alias("n_rows"), F.col(f"t_{n}").alias("first_ts")) for n in RANGES
    ])).alias("x")).select("x.*")


_TICKERS = """SELECT 'C' || c_custkey || CASE c_mktsegment WHEN 'BUILDING' THEN 'USDT' WHEN 'MACHINERY' THEN 'BUSD' ELSE '' END
    AS symbol FROM customer"""


@query("c4_asset_class", f"""
    SELECT symbol, CASE WHEN symbol LIKE '%USDT' THEN 'crypto' ELSE 'traditional' END AS asset_class,
      symbol LIKE '%USDT' OR symbol LIKE '%BUSD' AS is_crypto FROM ({_TICKERS})""")
def _(spark, sf):
    c = P.table(spark, sf, "customer")
    suffix = F.when(F.col("c_mktsegment") == "BUILDING", "USDT").when(F.col("c_mktsegment") == "MACHINERY", "BUSD").otherwise("")
    s = c.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string"), suffix).alias("symbol"))
    return s.select("symbol", asset_class("symbol").alias("asset_class"), is_crypto("symbol").alias("is_crypto"))


@query("c5_calendar", """
    SELECT DISTINCT o_orderdate AS ts, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, day(o_orderdate)::INT AS day,
      dayofweek(o_orderdate)::INT AS day_of_week, dayofweek(o_orderdate) IN (0, 6) AS is_weekend FROM orders""")
def _(spark, sf):
    d = P.table(spark, sf, "orders").select(F.col("o_orderdate").alias("ts")).distinct()
    return d.select("ts", *[c.alias(n) for n, c in calendar("ts").items()])


@query("c6_calendar_extended", """
    SELECT DISTINCT o_orderdate AS ts, quarter(o_orderdate)::INT AS quarter, week(o_orderdate)::INT AS week,
      dayname(o_orderdate) AS day_name, last_day(o_orderdate) = CAST(o_orderdate AS DATE) AS is_month_end,
      last_day(o_orderdate) = CAST(o_orderdate AS DATE) AND month(o_orderdate) % 3 = 0 AS is_quarter_end FROM orders""")
def _(spark, sf):
    d = P.table(spark, sf, "orders").select(F.col("o_orderdate").alias("ts")).distinct()
    return d.select("ts", *[c.alias(n) for n, c in calendar_extended("ts").items()])


@query("c7_finite", "SELECT event_id, CASE WHEN value < 50 THEN 0.0 WHEN value > 200 THEN -1.0 ELSE round(sqrt(value - 50), 6) END AS v FROM events")
def _(spark, sf):
    e = P.table(spark, sf, "events")
    root = F.sqrt(F.col("value") - 50)
    odd = F.when(F.col("value") > 200, F.lit(float("inf"))).otherwise(root)
    return e.select("event_id", rounded(F.when(F.col("value") > 200, finite(odd, -1.0)).otherwise(finite(odd))).alias("v"))


@query("c8_normal", """
    WITH p AS (SELECT event_id, (value + 1) / 600 AS p FROM events),
    t AS (SELECT *, sqrt(-2 * ln(least(p, 1 - p))) AS t FROM p WHERE p > 0 AND p < 1),
    z AS (SELECT *, (t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t))
       * CASE WHEN p < 0.5 THEN -1 ELSE 1 END AS z FROM t)
    SELECT event_id, round(z, 6) + 0.0 AS z, round(exp(-0.5 * z * z) / sqrt(2 * pi()), 6) AS density FROM z""")
def _(spark, sf):
    e = P.table(spark, sf, "events").select("event_id", normal_quantile((F.col("value") + 1) / 600).alias("z"))
    return e.select("event_id", rounded("z").alias("z"), rounded(normal_density("z")).alias("density"))


@query("c9_rounding", sql("SELECT symbol, ts, #close / 7#2# AS p2, #close / 7#4# AS p4, #close / 7#6# AS p6, #1 / close#8# AS p8 FROM panel"))
def _(spark, sf):
    return P.weekly_bars(spark, sf).select(
        "symbol", "ts", *[rounded(F.col("close") / 7, k).alias(f"p{k}") for k in (2, 4, 6)], rounded(1 / F.col("close"), 8).alias("p8"))


@query("c10_positions", sql("""
    SELECT portfolio, count(*) FILTER (WHERE abs(w) >= 1e-4) AS n_invested, count(*) FILTER (WHERE w >= 1e-4) AS n_long,
      count(*) FILTER (WHERE w <= -1e-4) AS n_short, #sum(CASE WHEN w > 0 THEN w ELSE 0 END)# AS long_total,
      #sum(CASE WHEN w < 0 THEN w ELSE 0 END)# AS short_total
    FROM (SELECT portfolio, weight - 0.2 AS w FROM books) GROUP BY 1"""))
def _(spark, sf):
    w = P.books(spark, sf).select("portfolio", (F.col("weight") - 0.2).alias("w"))
    held = invested("w")
    return w.groupBy("portfolio").agg(
        F.count_if(held).alias("n_invested"), F.count_if(held & (F.col("w") > 0)).alias("n_long"),
        F.count_if(held & (F.col("w") < 0)).alias("n_short"),
        rounded(F.sum(F.when(F.col("w") > 0, F.col("w")).otherwise(0.0))).alias("long_total"),
        rounded(F.sum(F.when(F.col("w") < 0, F.col("w")).otherwise(0.0))).alias("short_total"))


@query("c11_concentration", sql("SELECT portfolio, #sum(weight * weight)# AS hhi FROM books GROUP BY 1"))
def _(spark, sf):
    return P.books(spark, sf).groupBy("portfolio").agg(rounded(F.sum(F.col("weight") * F.col("weight"))).alias("hhi"))


@query("n1_macro_column", sql("SELECT symbol, ts, #r# AS log_return FROM ret"))
def _(spark, sf):
    """The function has a name of its own and goes again; the plan that is returned has its body in it."""
    name = f"log_return_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE TEMPORARY FUNCTION {name}(c DOUBLE, p DOUBLE) RETURNS DOUBLE RETURN CASE WHEN p > 0 THEN ln(c / p) END")
    try:
        bars = H.previous_close(P.silver(spark, sf)).select("symbol", "ts", "close", F.col("prev_close").alias("prev"))
        return spark.sql(f"SELECT symbol, ts, round({name}(close, prev), 6) AS log_return FROM {{bars}} WHERE prev IS NOT NULL", bars=bars)
    finally:
        spark.sql(f"DROP TEMPORARY FUNCTION {name}")


@query("e1_common_dates", sql("SELECT symbol, ts, #close# AS close FROM aligned"))
def _(spark, sf):
    return A.common_dates(P.weekly_bars(spark, sf)).select("symbol", "ts", rounded("close").alias("close"))


@query("e2_fact_dim_date", sql("""
    WITH d AS (SELECT CAST(unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS DATE) AS date FROM panel)
    SELECT symbol, ts, #close# AS close, year(date)::INT AS year, month(date)::INT AS month, dayofweek(date)::INT AS day_of_week
    FROM panel JOIN d ON CAST(ts AS DATE) = date WHERE symbol = 'EUROPE'"""))
def _(spark, sf):
    bars = P.weekly_bars(spark, sf)
    dim = H.dim_date(bars).select("date", "year", "month", "day_of_week")
    fact = bars.filter("symbol = 'EUROPE'").withColumn("date", F.to_date("ts"))
    return fact.join(dim, "date").select("symbol", "ts", rounded("close").alias("close"), "year", "month", "day_of_week").orderBy("ts")


@query("e3_top_by_price", """
    SELECT n_name AS symbol, r_name AS sector, count(*) AS n_rows, round(avg(close), 6) AS avg_close, round(max(high), 6) AS max_high
    FROM (SELECT s_nationkey, date_trunc('week', l_shipdate) AS ts, sum(l_extendedprice) / sum(l_quantity) AS close,
          max(l_extendedprice / l_quantity) AS high FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)
      JOIN nation ON n_nationkey = s_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY 1, 2 ORDER BY avg_close DESC, symbol LIMIT 10""")
def _(spark, sf):
    li, s, n, r = (P.table(spark, sf, t) for t in ("lineitem", "supplier", "nation", "region"))
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    bars = li.join(s, li.l_suppkey == s.s_suppkey).groupBy(
        F.col("s_nationkey").alias("symbol"), P.bucket_start("l_shipdate", "week").alias("ts")).agg(
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), F.max(unit).alias("high"))
    dim = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("symbol"), "n_name", F.col("r_name").alias("sector"))
    return H.top_by_price(bars, dim).select(
        F.col("n_name").alias("symbol"), "sector", "n_rows", rounded("avg_close").alias("avg_close"), rounded("max_high").alias("max_high"))


@query("e4_index_range_join", f"""WITH d AS ({_DAILY_SQL}), i AS ({_INDEX_SQL})
    SELECT index_id, index_name, ts, round(close, 6) AS close FROM d JOIN i USING (index_id)
    WHERE ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31' ORDER BY index_name, ts""")
def _(spark, sf):
    from ..sources.readers import index_history
    out = index_history(segment_index(spark, sf), segment_daily(spark, sf), "1996-01-01 00:00:00", "1996-12-31 00:00:00")
    return out.select("index_id", "index_name", "ts", rounded("close").alias("close")).orderBy("index_name", "ts")


@query("e5_recent_comparison", f"""WITH d AS ({_DAILY_SQL})
    SELECT index_id, ts, round(close, 6) AS close FROM d WHERE ts <= TIMESTAMP '2000-06-30' ORDER BY ts DESC, index_id LIMIT 100""")
def _(spark, sf):
    d = segment_daily(spark, sf).filter("ts <= TIMESTAMP_NTZ'2000-06-30'")
    return d.select("index_id", "ts", rounded("close").alias("close")).orderBy(F.col("ts").desc(), "index_id").limit(100)


@query("e6_symbol_pairs", sql("SELECT ts, symbol_a, symbol_b, #x_a# AS r_a, #x_b# AS r_b FROM prs WHERE symbol_a < symbol_b"))
def _(spark, sf):
    return A.symbol_pairs(P.returns(spark, sf)).select("ts", "symbol_a", "symbol_b", rounded("x_a").alias("r_a"), rounded("x_b").alias("r_b"))


@query("e7_weighted_returns", sql("SELECT ts, #sum(weight * r)# AS r FROM ret JOIN tw USING (symbol) WHERE symbol <> 'ASIA' GROUP BY 1"))
def _(spark, sf):
    w = P.target_weights(spark, sf).filter("symbol <> 'ASIA'")
    return A.portfolio_series(P.returns(spark, sf), w).select("ts", rounded("r").alias("r"))


@query("e8_outer_weights", sql("""
    WITH c AS (SELECT * FROM tw WHERE symbol <> 'AFRICA'), t AS (SELECT * FROM tw WHERE symbol <> 'MIDDLE EAST')
    SELECT symbol, #coalesce(c.weight, 0)# AS current_weight, #coalesce(t.weight, 0)# AS target_weight
    FROM c FULL JOIN t USING (symbol)"""))
def _(spark, sf):
    w = P.target_weights(spark, sf)
    out = A.outer_weights(w.filter("symbol <> 'AFRICA'"), w.filter("symbol <> 'MIDDLE EAST'"))
    return out.select("symbol", rounded("current_weight").alias("current_weight"), rounded("target_weight").alias("target_weight"))


@query("e9_portfolio_benchmark", sql("SELECT ts, #pr.r# AS portfolio_r, #b.r# AS benchmark_r FROM pr JOIN ret b USING (ts) WHERE b.symbol = 'EUROPE'"))
def _(spark, sf):
    r = P.returns(spark, sf)
    p = A.portfolio_series(r, P.target_weights(spark, sf)).select("ts", rounded("r").alias("portfolio_r"))
    return p.join(r.filter("symbol = 'EUROPE'").select("ts", rounded("r").alias("benchmark_r")), "ts")


@query("e10_unknown_symbols", """
    SELECT n_name AS symbol FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)""")
def _(spark, sf):
    n, c = P.table(spark, sf, "nation"), P.table(spark, sf, "customer").filter("c_acctbal > 9900")
    return n.join(c, n.n_nationkey == c.c_nationkey, "left_anti").select(F.col("n_name").alias("symbol"))


@query("e11_renormalised", sql("""
    SELECT symbol, #weight / (SELECT sum(weight) FROM tw WHERE symbol <> 'ASIA')# AS weight FROM tw WHERE symbol <> 'ASIA'"""))
def _(spark, sf):
    universe = P.returns(spark, sf).filter("symbol <> 'ASIA'")
    return A.renormalised(P.target_weights(spark, sf), universe).select("symbol", rounded("weight").alias("weight"))


@query("f1_symbol_summary", sql("""
    SELECT symbol, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts, #avg(close)# AS avg_close,
      #min(close)# AS min_close, #max(close)# AS max_close, #avg(volume)# AS avg_volume FROM panel GROUP BY 1"""))
def _(spark, sf):
    return H.symbol_summary(P.weekly_bars(spark, sf)).select(
        "symbol", "n_rows", "first_ts", "last_ts", *[rounded(c).alias(c) for c in ("avg_close", "min_close", "max_close", "avg_volume")])


@query("f2_symbol_span", sql("SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_rows FROM bars_h6 GROUP BY 1"))
def _(spark, sf):
    return H.symbol_span(P.event_bars(spark, sf, "6 hours"))


@query("f3_dataset_summary", sql("""
    SELECT count(DISTINCT symbol) AS n_symbols, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts,
      #sum(volume)# AS total_volume FROM panel"""))
def _(spark, sf):
    return H.dataset_summary(P.weekly_bars(spark, sf)).withColumn("total_volume", rounded("total_volume"))


@query("f4_volume_analysis", sql("""
    SELECT symbol, #sum(volume)# AS total_volume, #avg(volume)# AS avg_volume, #max(volume)# AS max_volume,
      #min(volume)# AS min_volume, count(*) AS n_rows, #sum(close * volume) / sum(volume)# AS vwap FROM bars_h6 GROUP BY 1"""))
def _(spark, sf):
    d = H.volume_analysis(P.event_bars(spark, sf, "6 hours"))
    return d.select("symbol", "n_rows", *[rounded(c).alias(c) for c in ("total_volume", "avg_volume", "max_volume", "min_volume", "vwap")])


@query("f5_price_ranking", sql("SELECT symbol, #avg(close)# AS avg_close, count(*) AS n_rows FROM panel GROUP BY 1"))
def _(spark, sf):
    return H.price_ranking(P.weekly_bars(spark, sf)).withColumn("avg_close", rounded("avg_close")).orderBy(F.col("avg_close").desc())


@query("f6_index_stats", f"""WITH d AS ({_DAILY_SQL})
    SELECT index_id, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts, round(min(close), 4) AS min_close,
      round(max(close), 4) AS max_close, round(avg(close), 4) AS avg_close, round(stddev_samp(close), 4) AS std_close FROM d GROUP BY 1""")
def _(spark, sf):
    d = H.index_stats(segment_daily(spark, sf))
    return d.select("index_id", "n_rows", "first_ts", "last_ts", *[rounded(c, 4).alias(c) for c in ("min_close", "max_close", "avg_close", "std_close")])


@query("f7_stat_card", sql("""
    SELECT symbol, #min(close)# AS min_close, #max(close)# AS max_close, #avg(close)# AS avg_close,
      #stddev_samp(close / p - 1)# AS std_change, #arg_max(close, ts) / arg_min(close, ts) - 1# AS total_return
    FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM raw) GROUP BY 1"""))
def _(spark, sf):
    d = H.stat_card(P.numbered(spark, sf))
    return d.select("symbol", *[rounded(c).alias(c) for c in d.columns[1:]])


@query("f17_volume_metrics", sql("""
    SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_rows,
      round(date_diff('second', max(ts), TIMESTAMP '2024-02-01 06:30:00') / 3600, 2) AS freshness_hours FROM bars_h6 GROUP BY 1"""))
def _(spark, sf):
    return H.volume_metrics(P.event_bars(spark, sf, "6 hours"), "2024-02-01 06:30:00")


@query("f17_file_sizes")
def _(spark, sf):
    """SQL cannot state sizes of files; tests/test_operators.py has a listing of the folder."""
    path = shared_dir(spark, "lake")
    write_bars(P.event_bars(spark, sf), path)
    return month_files(spark, path)


@query("f18_zone_bytes")
def _(spark, sf):
    """SQL cannot state sizes of files; tests/test_operators.py has a listing of the folder."""
    path = shared_dir(spark, "lake")
    write_bars(P.event_bars(spark, sf), path)
    return zone_size(spark, path)


@query("g2_daily_return", sql("""
    SELECT symbol, ts, #(close - p) / p# AS daily_return FROM (
      SELECT symbol, ts, close, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM bars_h6)"""))
def _(spark, sf):
    d = H.previous_close(P.event_bars(spark, sf, "6 hours"))
    return d.select("symbol", "ts", rounded(F.try_divide(F.col("close") - F.col("prev_close"), F.col("prev_close"))).alias("daily_return"))


@query("g4_index_return", f"""WITH d AS ({_DAILY_SQL})
    SELECT index_id, ts, round((close - p) / nullif(p, 0), 6) + 0.0 AS daily_return FROM (
      SELECT index_id, ts, close, lag(close) OVER (PARTITION BY index_id ORDER BY ts) AS p FROM d)""")
def _(spark, sf):
    d = H.previous_close(segment_daily(spark, sf), key=("index_id",))
    return d.select("index_id", "ts", rounded(null_safe_return("close", "prev_close")).alias("daily_return"))


@query("g39_dedupe", sql("""
    SELECT symbol, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, open, high, low, close, volume FROM bars_h6
    QUALIFY row_number() OVER (PARTITION BY symbol, date_trunc('day', bars_h6.ts) ORDER BY open, high, low, close, volume) = 1"""))
def _(spark, sf):
    bars = P.event_bars(spark, sf, "6 hours")
    return H.dedupe(bars.withColumn("ts", P.bucket_start("ts", "day")))


@query("g40_date_ids", "SELECT o_orderdate AS ts, row_number() OVER (ORDER BY o_orderdate) AS date_id FROM (SELECT DISTINCT o_orderdate FROM orders)")
def _(spark, sf):
    return H.dim_date_ids(P.table(spark, sf, "orders").select(F.col("o_orderdate").alias("ts")))


@query("dim_symbol", sql("""
    SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_rows,
      CASE WHEN symbol LIKE '%USDT' THEN 'crypto' ELSE 'traditional' END AS asset_class FROM panel GROUP BY 1"""))
def _(spark, sf):
    return H.dim_symbol(P.weekly_bars(spark, sf))


@query("h3_last_per_symbol", sql("SELECT symbol, ts, #close# AS close FROM raw QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 10"))
def _(spark, sf):
    bars = P.numbered(spark, sf)
    last = bars.groupBy("symbol").agg(F.max("pos").alias("n"))
    return bars.join(last, "symbol").filter("pos > n - 10").select("symbol", "ts", rounded("close").alias("close"))


@query("h4_symbol_history", sql("SELECT symbol, ts, #close# AS close, #volume# AS volume FROM panel WHERE symbol = 'ASIA' ORDER BY ts"))
def _(spark, sf):
    return P.weekly_bars(spark, sf).filter("symbol = 'ASIA'").select(
        "symbol", "ts", rounded("close").alias("close"), rounded("volume").alias("volume")).orderBy("ts")


@query("i1_union_symbols", sql("SELECT symbol, count(*) AS n_rows, #sum(close)# AS total FROM panel GROUP BY 1"))
def _(spark, sf):
    bars = P.weekly_bars(spark, sf)
    return bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), rounded(F.sum("close")).alias("total"))


@query("i2_key_sets", sql("""
    WITH a AS (SELECT ts FROM panel WHERE symbol = 'ASIA' AND close > 1500), b AS (SELECT ts FROM panel WHERE symbol = 'EUROPE' AND close > 1500)
    SELECT 'intersect' AS op, ts FROM (SELECT ts FROM a INTERSECT SELECT ts FROM b) UNION ALL
    SELECT 'union', ts FROM (SELECT ts FROM a UNION SELECT ts FROM b)"""))
def _(spark, sf):
    bars = P.weekly_bars(spark, sf).filter("close > 1500")
    a, b = (bars.filter(F.col("symbol") == s).select("ts") for s in ("ASIA", "EUROPE"))
    return a.intersect(b).select(F.lit("intersect").alias("op"), "ts").unionByName(a.union(b).distinct().select(F.lit("union").alias("op"), "ts"))


@query("i3_date_pivot", sql("""
    SELECT ts, #max(CASE WHEN symbol = 'AFRICA' THEN r END)# AS AFRICA, #max(CASE WHEN symbol = 'AMERICA' THEN r END)# AS AMERICA,
      #max(CASE WHEN symbol = 'ASIA' THEN r END)# AS ASIA, #max(CASE WHEN symbol = 'EUROPE' THEN r END)# AS EUROPE,
      #max(CASE WHEN symbol = 'MIDDLE EAST' THEN r END)# AS "MIDDLE EAST" FROM ret GROUP BY 1"""))
def _(spark, sf):
    wide = P.returns(spark, sf).groupBy("ts").pivot("symbol", P.symbols(spark, sf)).agg(F.first("r"))
    return wide.select("ts", *[rounded(F.col(f"`{c}`")).alias(c) for c in wide.columns[1:]])


@query("i4_date_spine", sql("SELECT strftime(d, '%Y-%m-%d') AS date FROM (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS d FROM panel)"))
def _(spark, sf):
    return H.date_spine(P.weekly_bars(spark, sf)).select(F.col("date").cast("string").alias("date"))
