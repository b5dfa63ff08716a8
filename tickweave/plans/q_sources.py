"""Queries: sources, sinks, ingestion, enrichment and lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import magnitude_number, percent_number, rounded
from ..operators import bars as B
from ..operators import lifecycle as L
from ..operators import moments as M
from ..session import shared_dir
from ..sources import readers as R
from ..sources import writers as W
from . import panels as P
from .oracle import sql
from .registry import query

BAR_COLUMNS = ("open", "high", "low", "close", "volume")


def _lake(spark, sf):
    path = shared_dir(spark, "lake")
    W.write_bars(P.event_bars(spark, sf), path)
    return path


@query("a1_read_bars", sql("""
    SELECT symbol, ts, open, high, low, close, volume FROM bars_d WHERE symbol IN ('click', 'view')"""))
def _(spark, sf):
    return R.read_bars(spark, _lake(spark, sf), ["click", "view", "absent"])


@query("a2_write_bars", sql("""SELECT symbol, count(*) AS n_rows, sum(volume) * CASE WHEN symbol = 'click' THEN 2 ELSE 1 END AS volume
    FROM bars_d GROUP BY 1"""))
def _(spark, sf):
    path = _lake(spark, sf)
    doubled = R.read_bars(spark, path).filter("symbol = 'click'").withColumn("volume", F.col("volume") * 2)
    replacement = shared_dir(spark, "month")
    doubled.write.parquet(replacement)
    W.write_bars(spark.read.parquet(replacement), path)
    return R.read_bars(spark, path).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("volume").alias("volume"))


@query("a3_flat_or_partitioned", sql("""
    SELECT symbol, count(*) AS n_rows, #sum(close)# AS total_close FROM bars_d GROUP BY 1"""))
def _(spark, sf):
    bars = P.event_bars(spark, sf)
    lake, flat = shared_dir(spark, "lake"), shared_dir(spark, "flat")
    W.write_bars(bars.filter("symbol <> 'view'"), lake)
    bars.filter("symbol = 'view'").drop("symbol").write.parquet(f"{flat}/view.parquet")
    return R.read_any_bars(spark, lake, flat).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"), rounded(F.sum("close")).alias("total_close"))


@query("a4_stage_bars", sql("""
    SELECT symbol, ts, open, high, low, close, CASE WHEN volume >= 60 THEN volume END AS volume
    FROM bars_d WHERE close >= 10"""))
def _(spark, sf):
    bars = P.event_bars(spark, sf)
    path = shared_dir(spark, "raw")
    undated = F.when(F.col("close") >= 10, F.col("ts"))
    bars.filter("volume >= 60").withColumn("ts", undated).write.parquet(f"{path}/part=a")
    bars.filter("volume < 60").withColumn("ts", undated).drop("volume").write.parquet(f"{path}/part=b")
    return R.stage_bars(spark, path)


_META_SQL = """SELECT n_name AS symbol, r_name AS name, 'S' || n_regionkey AS sector,
    CASE WHEN n_nationkey < 10 THEN 'major' ELSE 'minor' END AS category, CAST(1990 + n_nationkey AS INT) AS launch_year,
    CAST(n_nationkey + 1 AS INT) AS market_cap_rank, n_regionkey = 2 AS is_stablecoin, 'none' AS consensus
    FROM nation JOIN region ON n_regionkey = r_regionkey"""


def _meta(spark, sf):
    n, r = P.table(spark, sf, "nation"), P.table(spark, sf, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_name").alias("symbol"), F.col("r_name").alias("name"), F.concat(F.lit("S"), "n_regionkey").alias("sector"),
        F.when(F.col("n_nationkey") < 10, "major").otherwise("minor").alias("category"),
        (F.lit(1990) + F.col("n_nationkey")).alias("launch_year"), (F.col("n_nationkey") + 1).alias("market_cap_rank"),
        F.when(F.col("n_regionkey") == 2, "True").otherwise("false").alias("is_stablecoin"), F.lit("none").alias("consensus"),
    )


@query("a5_csv_metadata", _META_SQL)
def _(spark, sf):
    path = shared_dir(spark, "meta")
    W.write_csv(_meta(spark, sf), path)
    return R.read_symbol_meta(spark, path)


@query("a6_json_sector_map", """
    SELECT DISTINCT r_name AS sector, n_name AS symbol FROM nation JOIN region ON n_regionkey = r_regionkey""")
def _(spark, sf):
    path = shared_dir(spark, "config")
    m = _meta(spark, sf).groupBy("name").agg(F.collect_set("symbol").alias("symbols"))
    m.select(F.create_map("name", "symbols").alias("sector_classification")).write.json(path)
    return R.read_sector_map(spark, path, multi_line=False)


_DAILY_SQL = """SELECT c_mktsegment AS index_id, o_orderdate AS ts, sum(o_totalprice) / count(*) AS close,
    CAST(count(*) AS DOUBLE) AS volume FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"""
_INDEX_SQL = "SELECT c_mktsegment AS index_id, 'index ' || lower(c_mktsegment) AS index_name FROM customer GROUP BY 1"


def segment_daily(spark, sf):
    """Daily order value per market segment: the stand-in for stored index histories."""
    o, c = P.table(spark, sf, "orders"), P.table(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy(
        F.col("c_mktsegment").alias("index_id"), F.col("o_orderdate").alias("ts")
    ).agg((F.sum("o_totalprice") / F.count(F.lit(1))).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))


def segment_index(spark, sf):
    c = P.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("index_id")).distinct()
    return c.withColumn("index_name", F.concat(F.lit("index "), F.lower("index_id")))


@query("a7_relational_source", f"""WITH d AS ({_DAILY_SQL}), i AS ({_INDEX_SQL})
    SELECT index_id, index_name, ts, round(close, 6) AS close, volume FROM d JOIN i USING (index_id)
    WHERE ts >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 90 DAY""")
def _(spark, sf):
    latest = P.table(spark, sf, "orders").select(F.col("o_orderdate").alias("ts"))
    out = R.index_history(segment_index(spark, sf), segment_daily(spark, sf), latest=latest)
    return out.select("index_id", "index_name", "ts", rounded("close").alias("close"), "volume")


@query("a8_upsert", f"""WITH d AS ({_DAILY_SQL}),
    u AS (SELECT index_id, CASE WHEN volume > 1 THEN ts ELSE ts + INTERVAL 3650 DAY END AS ts, close + 1 AS close,
          volume * 10 AS volume FROM d WHERE ts >= TIMESTAMP '2001-01-01')
    SELECT index_id, ts, round(close, 6) AS close, volume FROM (
      SELECT * FROM u UNION ALL SELECT d.* FROM d WHERE NOT EXISTS (
        SELECT 1 FROM u WHERE u.index_id = d.index_id AND u.ts = d.ts))""")
def _(spark, sf):
    daily = segment_daily(spark, sf)
    moved = F.when(F.col("volume") > 1, F.col("ts")).otherwise(F.col("ts") + F.expr("INTERVAL 3650 DAY"))
    new = daily.filter("ts >= TIMESTAMP_NTZ'2001-01-01'").select(
        "index_id", moved.alias("ts"), (F.col("close") + 1).alias("close"), (F.col("volume") * 10).alias("volume"))
    path = shared_dir(spark, "table")
    daily.select("index_id", "ts", "close", "volume").write.partitionBy("index_id").parquet(path)
    W.upsert_table(new, path, ["index_id", "ts"], "volume", "index_id", shared_dir(spark, "staging"))
    out = spark.read.schema(new.schema).parquet(path)
    return out.select("index_id", "ts", rounded("close").alias("close"), "volume")


@query("a9_matrix_wide", sql("""
    SELECT symbol_row, #max(CASE WHEN symbol_col = 'AFRICA' THEN value END)# AS AFRICA, #max(CASE WHEN symbol_col = 'AMERICA' THEN value END)# AS AMERICA,
      #max(CASE WHEN symbol_col = 'ASIA' THEN value END)# AS ASIA, #max(CASE WHEN symbol_col = 'EUROPE' THEN value END)# AS EUROPE,
      #max(CASE WHEN symbol_col = 'MIDDLE EAST' THEN value END)# AS "MIDDLE EAST" FROM cov GROUP BY 1"""))
def _(spark, sf):
    path = shared_dir(spark, "matrix")
    M.covariance(P.returns(spark, sf), 365).write.parquet(path)
    wide = W.matrix_wide(spark.read.parquet(path), P.symbols(spark, sf))
    return wide.select("symbol_row", *[rounded(F.col(f"`{c}`")).alias(c) for c in wide.columns[1:]])


@query("a10_series_wide", sql("""
    SELECT ts AS date, #coalesce(max(CASE WHEN symbol = 'AFRICA' THEN r END), 0)# AS AFRICA, #coalesce(max(CASE WHEN symbol = 'AMERICA' THEN r END), 0)# AS AMERICA,
      #coalesce(max(CASE WHEN symbol = 'ASIA' THEN r END), 0)# AS ASIA, #coalesce(max(CASE WHEN symbol = 'EUROPE' THEN r END), 0)# AS EUROPE,
      #coalesce(max(CASE WHEN symbol = 'MIDDLE EAST' THEN r END), 0)# AS "MIDDLE EAST" FROM ret GROUP BY 1"""))
def _(spark, sf):
    long = P.returns(spark, sf).select(F.col("ts").alias("date"), "symbol", F.col("r").alias("value"))
    wide = W.series_wide(long, P.symbols(spark, sf))
    return wide.select("date", *[rounded(F.col(f"`{c}`")).alias(c) for c in wide.columns[1:]])


@query("a10_series_long", sql("SELECT ts AS date, symbol, #r# AS value FROM ret"))
def _(spark, sf):
    long = P.returns(spark, sf).select(F.col("ts").alias("date"), "symbol", F.col("r").alias("value"))
    return W.series_long(W.series_wide(long, P.symbols(spark, sf))).withColumn("value", rounded("value"))


@query("a11_result_document", sql("SELECT symbol, #weight# AS weight FROM tw"))
def _(spark, sf):
    path = shared_dir(spark, "document")
    W.write_document(P.target_weights(spark, sf), path, "weights", "2024-01-01T00:00:00")
    return R.read_document(spark, path).withColumn("weight", rounded("weight"))


@query("a12_replace_table", sql("SELECT symbol, count(*) AS n_rows FROM bars_d WHERE symbol <> 'view' GROUP BY 1"))
def _(spark, sf):
    path = shared_dir(spark, "table")
    bars = P.event_bars(spark, sf)
    W.replace_table(bars, path)
    W.replace_table(bars.filter("symbol <> 'view'"), path)
    return spark.read.parquet(path).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"))


@query("a14_stored_symbols", "SELECT DISTINCT event_type AS symbol FROM events")
def _(spark, sf):
    return R.stored_symbols(spark, _lake(spark, sf))


@query("a14_stored_names", """SELECT DISTINCT 'metrics' AS zone, 'volatility_' || lower(event_type) AS name FROM events
    UNION ALL SELECT 'outputs', 'report_' || strftime(ts, '%Y_%m') FROM events GROUP BY 2""")
def _(spark, sf):
    """A metrics table for each event type and a document for each month, found by listing their folders."""
    root, events = shared_dir(spark, "catalog"), P.table(spark, sf, "events")
    for (kind,) in events.select("event_type").distinct().collect():
        events.where(F.col("event_type") == kind).agg(F.stddev("value").alias("volatility")).write.parquet(f"{root}/processed/volatility_{kind.lower()}.parquet")
    for (month,) in events.select(F.date_format("ts", "yyyy_MM")).distinct().collect():
        W.write_document(events.where(F.date_format("ts", "yyyy_MM") == month).groupBy("event_type").count(), f"{root}/output/report_{month}.json", "counts", "2024-01-01T00:00:00")
    return R.stored_names(spark, root, {"metrics": "processed", "outputs": "output"})


@query("a15_csv_export", sql("SELECT symbol, ts, #close# AS close FROM panel"))
def _(spark, sf):
    path = shared_dir(spark, "csv")
    W.write_csv(P.weekly_bars(spark, sf).select("symbol", "ts", rounded("close").alias("close")), path)
    return spark.read.schema("symbol STRING, ts TIMESTAMP_NTZ, close DOUBLE").option("header", "true").csv(path)


@query("b1_candle_array", sql("""
    SELECT symbol, strftime(ts, '%Y-%m-%d') AS timestamp, open, high, low, close, volume FROM bars_d"""))
def _(spark, sf):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    arr = F.array(ms.cast("string"), *[F.col(c).cast("string") for c in BAR_COLUMNS], (ms + 86_399_999).cast("string"))
    return B.parse_candle_array(P.event_bars(spark, sf).select("symbol", F.to_json(arr).alias("payload")))


@query("b2_bars_daily", sql("SELECT symbol, ts, open, high, low, close, volume FROM bars_d"))
def _(spark, sf):
    return P.event_bars(spark, sf)


@query("b2_bars_6h", sql("SELECT symbol, ts, open, high, low, close, volume FROM bars_h6"))
def _(spark, sf):
    return P.event_bars(spark, sf, "6 hours")


@query("b3_next_fetch", """
    WITH s AS (SELECT DISTINCT event_type AS symbol FROM events UNION ALL SELECT 'refund'),
    m AS (SELECT event_type AS symbol, max(CAST(date_trunc('day', ts) AS TIMESTAMP)) AS last_ts FROM events
          WHERE event_type = 'view' OR ts < TIMESTAMP '2024-01-20' GROUP BY 1)
    SELECT symbol, last_ts, coalesce(last_ts + INTERVAL 1 DAY, TIMESTAMP '2024-01-30' - INTERVAL 10 DAY) AS start_ts,
      coalesce(last_ts + INTERVAL 1 DAY, TIMESTAMP '2024-01-30' - INTERVAL 10 DAY) < TIMESTAMP '2024-01-30' AS needs_fetch
    FROM s LEFT JOIN m USING (symbol)""")
def _(spark, sf):
    ev = P.table(spark, sf, "events").select(F.col("event_type").alias("symbol"), B.bucket_start("ts", "day").alias("ts"))
    wanted = ev.select("symbol").distinct().unionByName(spark.createDataFrame([("refund",)], "symbol string"))
    return L.next_fetch(wanted, ev.filter("symbol = 'view' or ts < TIMESTAMP_NTZ'2024-01-20'"), "2024-01-30 00:00:00", 10)


@query("b4_merge_existing_wins", sql("""
    SELECT symbol, ts, CASE WHEN volume > 65 THEN close + 1000 ELSE close END AS close, volume FROM (
      SELECT symbol, ts, close, volume FROM bars_d)"""))
def _(spark, sf):
    bars = P.event_bars(spark, sf).select("symbol", "ts", "close", "volume").withColumn("seq", F.lit(0))
    stored = bars.filter("volume > 65").withColumn("close", F.col("close") + 1000)
    again = bars.unionByName(bars.withColumn("seq", F.lit(1)).withColumn("close", F.lit(-1.0)))
    return L.merge_keep_existing(stored, again)


@query("b5_overlap_reread", sql("""
    WITH st AS (SELECT * FROM bars_d WHERE ts < TIMESTAMP '2024-01-20' OR symbol = 'view'),
    m AS (SELECT symbol, date_diff('day', max(ts), TIMESTAMP '2024-01-30') AS age FROM st GROUP BY 1)
    SELECT b.symbol, b.ts, b.close FROM bars_d b JOIN m ON b.symbol = m.symbol AND m.age > 1
    WHERE b.ts >= TIMESTAMP '2024-01-30' - to_days(CAST(age + 5 AS INT))"""))
def _(spark, sf):
    bars = P.event_bars(spark, sf).select("symbol", "ts", "close")
    return L.reread_overlap(bars.filter("ts < TIMESTAMP_NTZ'2024-01-20' or symbol = 'view'"), bars, "2024-01-30 00:00:00")


@query("b6_enrich", sql(f"""
    WITH m AS ({_META_SQL} WHERE n_nationkey < 20)
    SELECT o.symbol, n_orders, coalesce(name, 'Unknown') AS name, coalesce(sector, 'Unknown') AS sector,
      coalesce(category, 'Unknown') AS category
    FROM (SELECT n_name AS symbol, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey
          JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) o LEFT JOIN m USING (symbol)"""))
def _(spark, sf):
    o, c, n = (P.table(spark, sf, t) for t in ("orders", "customer", "nation"))
    per = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    counts = per.join(c, per.o_custkey == c.c_custkey).groupBy("c_nationkey").agg(F.sum("n").alias("n_orders"))
    facts = counts.join(n, counts.c_nationkey == n.n_nationkey).select(F.col("n_name").alias("symbol"), "n_orders")
    return L.enrich(facts, _meta(spark, sf).filter("launch_year < 2010"))


@query("b7_market_ranking", """
    SELECT c.symbol, CAST(r.rank AS DOUBLE) AS market_rank, r.cap AS market_cap FROM
      (SELECT 'C' || c_custkey || CASE c_mktsegment WHEN 'BUILDING' THEN 'USDT' WHEN 'MACHINERY' THEN 'USD' ELSE '' END AS symbol,
         'C' || c_custkey AS code FROM customer) c
      LEFT JOIN (SELECT 'C' || c_custkey AS code, c_custkey + 1 AS rank, c_acctbal AS cap FROM customer WHERE c_acctbal > 0) r USING (code)""")
def _(spark, sf):
    c = P.table(spark, sf, "customer")
    suffix = F.when(F.col("c_mktsegment") == "BUILDING", "USDT").when(F.col("c_mktsegment") == "MACHINERY", "USD").otherwise("")
    code = F.concat(F.lit("C"), F.col("c_custkey").cast("string"))
    ranking = c.filter("c_acctbal > 0").select(code.alias("code"), (F.col("c_custkey") + 1).cast("double").alias("rank"), F.col("c_acctbal").alias("market_cap"))
    return L.add_ranking(c.select(F.concat(code, suffix).alias("symbol")), ranking)


@query("b8_magnitude_text", """
    SELECT c_custkey, round(CASE c_mktsegment WHEN 'BUILDING' THEN c_acctbal * 1e3 WHEN 'MACHINERY' THEN c_acctbal * 1e6
      WHEN 'HOUSEHOLD' THEN c_acctbal * 1e9 WHEN 'FURNITURE' THEN 0 ELSE c_acctbal END, 2) + 0.0 AS amount FROM customer""")
def _(spark, sf):
    seg, bal = F.col("c_mktsegment"), F.col("c_acctbal").cast("string")
    text = (
        F.when(seg == "BUILDING", F.concat(F.lit("$ "), bal, F.lit("K")))
        .when(seg == "MACHINERY", F.concat(F.lit("$"), F.substring(bal, 1, 1), F.lit(","), F.expr("substring(cast(c_acctbal as string), 2)"), F.lit("M")))
        .when(seg == "HOUSEHOLD", F.concat(bal, F.lit("B"))).when(seg == "FURNITURE", F.lit("n/a")).otherwise(bal)
    )
    return P.table(spark, sf, "customer").select("c_custkey", rounded(magnitude_number(text), 2).alias("amount"))


@query("b9_percent_text", """
    SELECT c_custkey, CASE WHEN c_mktsegment = 'FURNITURE' THEN 0.0 ELSE c_acctbal END AS pct FROM customer""")
def _(spark, sf):
    size = F.abs("c_acctbal").cast("string")
    text = F.when(F.col("c_mktsegment") == "FURNITURE", "--").when(
        F.col("c_acctbal") < 0, F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("▼ "), size, F.lit("%"))).otherwise(
            F.concat(F.lit("-"), size, F.lit(" %")))).otherwise(F.concat(F.lit("▲"), size, F.lit("%")))
    return P.table(spark, sf, "customer").select("c_custkey", percent_number(text).alias("pct"))


@query("b10_page_lists", r"""
    SELECT page_id, CAST(i AS INT) AS rank, hrefs[i] AS href, labels[i] AS label FROM (
      SELECT page_id, hrefs, labels, unnest(range(1, len(hrefs) + 1)) AS i FROM (
        SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) AS hrefs,
          regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) AS labels FROM pages))""")
def _(spark, sf):
    return L.link_list(P.table(spark, sf, "pages"))


@query("b10_ranking", """
    SELECT page_id, CAST(k AS INT) AS rank, 'Site ' || page_id AS name, CASE WHEN k = 1 THEN 'P' || page_id ELSE 'UNK' END AS symbol, page_id + 0.5::DOUBLE AS price,
      -1.5::DOUBLE * k AS change_pct, page_id * 1000000.0::DOUBLE AS market_cap, CASE WHEN k = 1 THEN 2000.0::DOUBLE ELSE 0.0 END AS volume FROM pages, (VALUES (1), (2)) AS t(k)""")
def _(spark, sf):
    n = F.col("page_id").cast("string")

    def row(k: int, symbol, volume: str):
        return F.concat(F.lit(f'<tr><td>{k}</td><td><span class="coin-name">Site '), n, F.lit("</span>"), symbol, F.lit("</td><td>$"), n, F.lit(".5</td><td>"),
                        F.lit(f"{-1.5 * k}%</td><td>$"), n, F.lit(f"M</td>{volume}</tr>"))
    tables = F.concat(F.lit("<div><table><tr><th>#</th></tr>"), row(1, F.concat(F.lit("<i class='symbol'>p"), n, F.lit("</i>")), "<td>$2K</td>"),
                      row(2, F.lit(""), ""), F.lit("</table>"), "html")
    return L.ranking_table(P.table(spark, sf, "pages").select("page_id", tables.alias("html")))


def _two_sources(spark, sf):
    return L.union_sources({
        "events": P.event_bars(spark, sf), "trades": P.weekly_bars(spark, sf),
        "empty": P.event_bars(spark, sf).filter("volume < 0")})


_EXPECTED = "(VALUES ('events'), ('trades'), ('empty'), ('offline')) AS e(source)"


@query("b11_source_report", sql(f"""
    WITH u AS (SELECT 'events' AS source, symbol FROM bars_d UNION ALL SELECT 'trades', symbol FROM panel),
    g AS (SELECT source, count(*) AS n_rows, count(DISTINCT symbol) AS n_symbols FROM u GROUP BY 1)
    SELECT source, coalesce(n_rows, 0) AS n_rows, coalesce(n_symbols, 0) AS n_symbols, coalesce(n_rows, 0) > 0 AS loaded
    FROM {_EXPECTED} LEFT JOIN g USING (source)"""))
def _(spark, sf):
    expected = spark.createDataFrame([(s,) for s in ("events", "trades", "empty", "offline")], "source string")
    return L.source_report(_two_sources(spark, sf), expected)


@query("b11_union_sources", sql("""
    SELECT 'events' AS source, symbol, ts, open, #close# AS close FROM bars_d UNION ALL
    SELECT 'trades', symbol, ts, NULL, #close# FROM panel"""))
def _(spark, sf):
    return _two_sources(spark, sf).select("source", "symbol", "ts", "open", rounded("close").alias("close"))


@query("b12_filter_sector", f"""
    SELECT symbol, sector, category FROM ({_META_SQL}) WHERE sector = 'S1' AND category = 'minor'""")
def _(spark, sf):
    return _meta(spark, sf).filter("sector = 'S1' and category = 'minor'").select("symbol", "sector", "category")


@query("b13_ticker_snapshot", """
    WITH t AS (SELECT event_type, ts, value, CAST(json_extract(props, '$.k') AS DOUBLE) AS prev, user_id FROM events),
    l AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) = 1)
    SELECT event_type AS symbol, value AS price,
      CASE WHEN prev > 0 THEN round((value / prev - 1) * 100, 2) + 0.0 ELSE 0.0 END AS change_pct,
      value + 1 AS high, prev AS low, CAST(user_id AS DOUBLE) AS volume FROM l WHERE event_type IN ('click', 'error', 'view')""")
def _(spark, sf):
    ticker = F.struct(
        F.col("event_type").alias("symbol"), F.col("value").cast("string").alias("last"),
        F.get_json_object("props", "$.k").alias("prev"), (F.col("value") + 1).cast("string").alias("high"),
        F.get_json_object("props", "$.k").alias("low"), F.col("user_id").cast("string").alias("vol"))
    return B.ticker_snapshot(
        P.table(spark, sf, "events").select("ts", F.to_json(ticker).alias("payload")), ["click", "error", "view"])


@query("b14_retention", sql("""
    SELECT 'bronze' AS zone, symbol, ts FROM bars_d WHERE ts > (SELECT max(ts) FROM bars_d) - INTERVAL 20 DAY UNION ALL
    SELECT 'streaming', symbol, ts FROM bars_h6 WHERE ts > (SELECT max(ts) FROM bars_h6) - INTERVAL 7 DAY"""))
def _(spark, sf):
    zones = {"bronze": ("day", 20), "streaming": ("6 hours", 7)}
    out = [L.retained(P.event_bars(spark, sf, b), n).select(F.lit(z).alias("zone"), "symbol", "ts") for z, (b, n) in zones.items()]
    return out[0].unionByName(out[1])


@query("b14_retention_rewrite", sql("""SELECT symbol, ts, #close# AS close, volume FROM panel WHERE ts > (SELECT max(ts) FROM panel) - INTERVAL 1000 DAY"""))
def _(spark, sf):
    """Years of weekly bars: old months go, the month of the limit is written anew, the rest stays; twice, which changes nothing."""
    path = shared_dir(spark, "zone")
    W.write_bars(P.weekly_bars(spark, sf), path)
    for _ in range(2):
        W.retain(spark, path, "ts TIMESTAMP_NTZ, close DOUBLE, high DOUBLE, low DOUBLE, volume DOUBLE", 1000, shared_dir(spark, "staging"))
    return spark.read.parquet(path).select(F.col("symbol").cast("string").alias("symbol"), "ts", rounded("close").alias("close"), "volume")


@query("b15_dimension_type1", """
    SELECT symbol, row_number() OVER (ORDER BY symbol) AS symbol_id FROM (SELECT DISTINCT c_name AS symbol FROM customer)""")
def _(spark, sf):
    return L.dimension_type1(P.table(spark, sf, "customer").select(F.col("c_name").alias("symbol")))


@query("b16_dimension_type2", """
    WITH cur AS (SELECT c_name AS symbol, c_mktsegment AS name FROM customer WHERE c_acctbal < 9000),
    inc AS (SELECT c_name AS symbol, CASE WHEN c_acctbal > 5000 THEN c_mktsegment || ' NEW' ELSE c_mktsegment END AS name
            FROM customer WHERE c_acctbal >= 0),
    j AS (SELECT c.symbol AS cs, c.name AS cn, i.symbol AS s, i.name AS n FROM cur c FULL JOIN inc i ON c.symbol = i.symbol)
    SELECT cs AS symbol, cn AS name, '2023-01-01' AS valid_from,
      CASE WHEN s IS NOT NULL AND cn <> n THEN '2023-12-31' END AS valid_to,
      s IS NULL OR cn = n AS is_current, s IS NOT NULL AS is_active FROM j WHERE cs IS NOT NULL
    UNION ALL SELECT s, n, '2024-01-01', NULL, true, true FROM j WHERE s IS NOT NULL AND (cs IS NULL OR cn <> n)""")
def _(spark, sf):
    c = P.table(spark, sf, "customer")
    current = c.filter("c_acctbal < 9000").select(
        F.col("c_name").alias("symbol"), F.col("c_mktsegment").alias("name"), F.lit("2023-01-01").cast("date").alias("valid_from"),
        F.lit(None).cast("date").alias("valid_to"), F.lit(True).alias("is_current"), F.lit(True).alias("is_active"))
    name = F.when(F.col("c_acctbal") > 5000, F.concat("c_mktsegment", F.lit(" NEW"))).otherwise(F.col("c_mktsegment"))
    incoming = c.filter("c_acctbal >= 0").select(F.col("c_name").alias("symbol"), name.alias("name"))
    out = L.dimension_type2(current, incoming, "2024-01-01")
    return out.withColumns({c: F.col(c).cast("string") for c in ("valid_from", "valid_to")})


_BARS_SQL = "SELECT symbol, ts, #close# AS close, #high# AS high, #low# AS low, #volume# AS volume FROM panel"


@query("build_weekly_bars", sql(_BARS_SQL))
def _(spark, sf):
    d = P.build_weekly_bars(spark, sf)
    return d.select("symbol", "ts", *[rounded(c).alias(c) for c in ("close", "high", "low", "volume")])


@query("build_silver", sql("SELECT symbol, ts, pos, #close# AS close, #r# AS r, #s# AS s FROM silver"))
def _(spark, sf):
    return P.build_silver(spark, sf).select("symbol", "ts", F.col("pos").cast("long").alias("pos"), *[rounded(c).alias(c) for c in ("close", "r", "s")])
