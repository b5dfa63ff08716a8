"""Incremental ingestion, enrichment and slowly changing dimensions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import magnitude_number, percent_number
from ..session import shared_dir
from ..timeline import number_rows


def next_fetch(symbols: DataFrame, bars: DataFrame, now: str, period_days: int, intraday: bool = False) -> DataFrame:
    """Per wanted symbol: newest stored bar, where the next fetch starts, and whether one is needed."""
    moment = F.lit(now).cast("timestamp_ntz")
    newest = bars.groupBy("symbol").agg(F.max("ts").alias("last_ts"))
    step = F.expr("INTERVAL 1 MINUTE" if intraday else "INTERVAL 1 DAY")
    start = F.coalesce(F.col("last_ts") + step, moment - F.expr(f"INTERVAL {period_days} DAY"))
    return (
        symbols.join(newest, "symbol", "left")
        .withColumn("start_ts", start)
        .withColumn("needs_fetch", F.col("start_ts") < moment)
    )


def merge_keep_existing(existing: DataFrame, new: DataFrame, order: str = "seq") -> DataFrame:
    """Stored bars win over fetched ones, and earlier rows (by ``order``) over later ones of the same kind.

    Copies of one bar are folded by a hash aggregation with map-side partials, so a bar that was sent a
    million times does not reach one task. ``order`` must be unique within a side, and values are doubles.
    """
    values = [c for c in existing.columns if c not in ("symbol", "ts", order)]
    side = F.lit(Decimal(10**19))
    rank = (F.col("_side") * side + F.col(order).cast("decimal(19,0)")).cast("decimal(38,0)")
    both = existing.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1))).withColumn("_rank", rank)
    return both.groupBy("symbol", "ts").agg(*[F.min_by(v, "_rank").alias(v) for v in values])


def reread_overlap(stored: DataFrame, source: DataFrame, now: str, overlap_days: int = 5) -> DataFrame:
    """Rows to fetch again: from ``overlap_days`` before the newest stored bar; none when it is a day old or less."""
    moment = F.lit(now).cast("timestamp_ntz")
    marks = stored.groupBy("symbol").agg(F.max("ts").alias("_last")).withColumn("_age", F.date_diff(moment, "_last"))
    due = marks.filter(F.col("_age") > 1)
    return (
        source.join(due, "symbol")
        .filter(F.col("ts") >= F.date_trunc("day", moment).cast("timestamp_ntz")
                - F.make_dt_interval(F.col("_age") + overlap_days))
        .drop("_last", "_age")
    )


def enrich(bars: DataFrame, meta: DataFrame, fields: tuple[str, ...] = ("name", "sector", "category")) -> DataFrame:
    out = bars.join(meta.select("symbol", *fields), "symbol", "left")
    return out.na.fill("Unknown", list(fields))


def base_code(symbol: str | Column) -> Column:
    s = F.col(symbol) if isinstance(symbol, str) else symbol
    return F.replace(F.replace(s, F.lit("USDT"), F.lit("")), F.lit("USD"), F.lit(""))


def add_ranking(df: DataFrame, ranking: DataFrame) -> DataFrame:
    """Market rank and capitalisation by base code; null where the code is not ranked."""
    r = ranking.select("code", F.col("rank").alias("market_rank"), "market_cap")
    return df.withColumn("code", base_code("symbol")).join(r, "code", "left").drop("code")


def ranking_table(pages: DataFrame, limit: int | None = None, html: str = "html") -> DataFrame:
    """Rows of the first table of each page: rank, name, symbol, price, change, capitalisation, volume.

    Cell 1 holds name and symbol, in elements whose class says so; price, change, capitalisation and volume follow.
    """
    first = F.regexp_extract(html, r"(?is)<table[^>]*>(.*?)</table>", 1)
    trs = F.regexp_extract_all(first, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)
    rows = pages.select("page_id", F.posexplode(trs).alias("p", "tr")).filter("p > 0")
    rows = rows.withColumn("raw", F.regexp_extract_all("tr", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), 1)).filter(F.size("raw") >= 5)
    if limit is not None:
        rows = rows.filter(F.col("p") <= limit)
    rows = rows.withColumn("c", F.transform("raw", lambda c: F.trim(F.regexp_replace(c, "<[^>]+>", ""))))

    def part(word: str, unknown: str) -> Column:
        found = F.regexp_extract(F.get("raw", F.lit(1)), rf"(?is)<[^>]*class=[^>]*{word}[^>]*>(.*?)<", 1)
        return F.when(F.trim(found) != "", F.trim(found)).otherwise(unknown)

    return rows.select(
        "page_id", F.col("p").alias("rank"), part("name", "Unknown").alias("name"), F.upper(part("symbol", "UNK")).alias("symbol"),
        magnitude_number(F.get("c", F.lit(2))).alias("price"), percent_number(F.get("c", F.lit(3))).alias("change_pct"),
        magnitude_number(F.get("c", F.lit(4))).alias("market_cap"),
        F.coalesce(magnitude_number(F.get("c", F.lit(5))), F.lit(0.0)).alias("volume"),
    )


def link_list(pages: DataFrame, html: str = "html") -> DataFrame:
    """The same extraction for list markup: position, target and label of every list link of a page."""
    item = F.lit(r'<li><a href="([^"]*)">([^<]*)</a></li>')
    both = F.arrays_zip(
        F.regexp_extract_all(html, item, 1).alias("href"), F.regexp_extract_all(html, item, 2).alias("label")
    )
    return pages.select("page_id", F.posexplode(both).alias("p", "x")).select(
        "page_id", (F.col("p") + 1).alias("rank"), F.col("x.href").alias("href"), F.col("x.label").alias("label")
    )


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in sources.items():
        part = df.withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def source_report(bars: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows and symbols per expected source; sources without rows are reported as failed."""
    got = bars.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("symbol").alias("n_symbols"))
    return (
        expected.join(got, "source", "left").na.fill(0, ["n_rows", "n_symbols"])
        .withColumn("loaded", F.col("n_rows") > 0)
    )


def retained(df: DataFrame, days: int) -> DataFrame:
    newest = df.agg(F.max("ts"))
    return df.filter(F.col("ts") > newest.scalar() - F.expr(f"INTERVAL {days} DAY"))


def dimension_type1(rows: DataFrame, column: str = "symbol") -> DataFrame:
    """Rebuilt dimension: ids follow the sorted distinct values.

    The values are cut into even ranges by a sample of them, whatever they look like, and numbered inside the ranges.
    The ranges are written once, since the numbering reads them twice.
    """
    cut = rows.select(F.col(column).alias("symbol")).distinct().repartitionByRange("symbol").withColumn("range", F.spark_partition_id())
    path = shared_dir(rows.sparkSession, "dimension")
    cut.write.parquet(path)
    ranged = rows.sparkSession.read.schema(cut.schema).parquet(path)
    return number_rows(ranged, key=(), order=("symbol",), slice_by=F.col("range"), out="symbol_id").drop("range")


def dimension_type2(current: DataFrame, incoming: DataFrame, today: str) -> DataFrame:
    """Merge a snapshot into a history (symbol, name, valid_from, valid_to, is_current, is_active).

    New symbols are inserted; a changed name closes the open row the day before and opens a new one; a symbol
    that is missing stays open but inactive. Closed rows pass through unchanged.
    """
    day = F.lit(today).cast("date")
    open_rows, closed = current.filter("is_current"), current.filter("not is_current")
    both = open_rows.alias("c").join(incoming.alias("n"), F.col("c.symbol") == F.col("n.symbol"), "full_outer")

    def row(symbol, name, start, end, cur, act):
        return F.struct(
            symbol.alias("symbol"), name.alias("name"), start.alias("valid_from"), end.alias("valid_to"),
            F.lit(cur).alias("is_current"), F.lit(act).alias("is_active"),
        )

    no_end = F.lit(None).cast("date")
    kept = row(F.col("c.symbol"), F.col("c.name"), F.col("c.valid_from"), no_end, True, True)
    gone = row(F.col("c.symbol"), F.col("c.name"), F.col("c.valid_from"), no_end, True, False)
    ended = row(F.col("c.symbol"), F.col("c.name"), F.col("c.valid_from"), F.date_sub(day, 1), False, True)
    fresh = row(F.col("n.symbol"), F.col("n.name"), day, no_end, True, True)
    versions = (
        F.when(F.col("c.symbol").isNull(), F.array(fresh))
        .when(F.col("n.symbol").isNull(), F.array(gone))
        .when(F.col("c.name") == F.col("n.name"), F.array(kept))
        .otherwise(F.array(ended, fresh))
    )
    return both.select(F.explode(versions).alias("v")).select("v.*").unionByName(closed)
