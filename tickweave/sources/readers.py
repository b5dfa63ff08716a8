"""Table sources. Filters on symbol and time reach the partition listing or the file scan."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas


def listed_symbols(spark: SparkSession, path: str) -> list[str]:
    """The partition values of a lake, sorted: one listing of its top folder, no file is opened."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = top.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(top)
    names = [f.getPath().getName() for f in found if f.isDirectory()]
    return sorted(unquote(n.removeprefix("symbol=")) for n in names if n.startswith("symbol="))


def listed_partitions(spark: SparkSession, path: str) -> list[tuple[str, int, int, str]]:
    """(symbol, year, month, folder) of the months a lake holds, from listings of its folders."""
    glob = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/symbol=*/year=*/month=*")
    found = glob.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(glob) or []
    out = []
    for f in found:
        folder = f.getPath().toString()
        symbol, year, month = (part.split("=", 1)[1] for part in folder.rsplit("/", 3)[1:])
        out.append((unquote(symbol), int(year), int(month), folder))
    return sorted(out)


def read_bars(spark: SparkSession, path: str, symbols: Sequence[str] | None = None) -> DataFrame:
    """Bars of a lake laid out by symbol/year/month; symbols that are not there are skipped.

    Asking for symbols of which none exists is an error, found from the directory listing's partition
    values, not from the data.
    """
    df = spark.read.schema(f"{schemas.BARS}, symbol STRING, year INT, month INT").parquet(path)
    if symbols is not None:
        df = df.filter(F.col("symbol").isin(*symbols))
        if not set(symbols) & set(listed_symbols(spark, path)):
            raise FileNotFoundError(f"no bars for {', '.join(symbols)} under {path}")
    return df.drop("year", "month")


def read_flat_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars of one file or folder per symbol, named ``SYMBOL.parquet``; the symbol comes from the path."""
    df = spark.read.schema(schemas.BARS).option("recursiveFileLookup", "true").parquet(path)
    return df.withColumn("symbol", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.parquet(?:/|$)", 1))


def read_any_bars(spark: SparkSession, partitioned: str, flat: str) -> DataFrame:
    """The partitioned lake, plus flat files of those symbols the lake does not hold."""
    rest = read_flat_bars(spark, flat).filter(~F.col("symbol").isin(listed_symbols(spark, partitioned)))
    return read_bars(spark, partitioned).unionByName(rest)


def stage_bars(spark: SparkSession, path: str) -> DataFrame:
    """Typed bars from files whose columns may differ; rows without a time are dropped."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    return df.select(
        F.col("symbol").cast("string").alias("symbol"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")],
    ).filter(F.col("ts").isNotNull())


def read_symbol_meta(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(schemas.SYMBOL_META).option("header", "true").csv(path)
    return df.withColumn("is_stablecoin", F.lower("is_stablecoin") == "true")


def read_sector_map(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(sector, symbol) rows of nested portfolio documents: one per file, or one per line."""
    doc = spark.read.schema(schemas.PORTFOLIO_CONFIG).option("multiLine", str(multi_line).lower()).json(path)
    return flatten_sector_map(doc.select("sector_classification"))


def flatten_sector_map(doc: DataFrame, column: str = "sector_classification") -> DataFrame:
    return (
        doc.select(F.explode(column).alias("sector", "symbols"))
        .select("sector", F.explode("symbols").alias("symbol"))
        .distinct()
    )


def read_jdbc(
    spark: SparkSession, url: str, table: str, key: str, lower: str, upper: str, parts: int, **options: str
) -> DataFrame:
    """A relational table read in ``parts`` ranges of ``key``; later filters are pushed to the server."""
    return spark.read.jdbc(url, table, column=key, lowerBound=lower, upperBound=upper, numPartitions=parts,
                           properties=options)


def index_history(indices: DataFrame, daily: DataFrame, start: str | None = None, end: str | None = None,
                  latest: DataFrame | None = None, days: int = 90) -> DataFrame:
    """Daily rows joined to their index in a date range; by default the last ``days`` days of the data."""
    if start is None:
        newest = (daily if latest is None else latest).agg(F.max("ts").alias("ts"))
        daily = daily.filter(F.col("ts") >= newest.scalar() - F.expr(f"INTERVAL {days} DAY"))
    else:
        daily = daily.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        daily = daily.filter(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    return daily.join(indices, "index_id")


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """A stored result without its ``_metadata``."""
    return spark.read.json(path).drop("_metadata")


def stored_symbols(spark: SparkSession, path: str) -> DataFrame:
    """Sorted symbols of a lake, from its directory listing."""
    return spark.createDataFrame([(s,) for s in listed_symbols(spark, path)], "symbol string")


def stored_names(spark: SparkSession, root: str, zones: dict[str, str]) -> DataFrame:
    """zone, name: the tables and documents in the folders of the zones, without their endings, from their listings.

    zones: name of a zone and its folder under ``root``, such as metrics in ``processed`` and outputs in ``output``. A folder that is not there is
    empty; hidden files and Spark's own are left out.
    """
    rows = set()
    for zone, folder in zones.items():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{folder}")
        fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        rows |= {(zone, n.rsplit(".", 1)[0] if "." in n else n) for n in names if n[0] not in "._"}
    return spark.createDataFrame(sorted(rows), "zone string, name string")


def stored_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per stored file with its size; file contents are not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .select("path", "length", "modificationTime")
    )


def month_files(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes of each stored month of a symbol."""
    month = [F.regexp_extract("path", rf"{k}=([^/]+)", 1).cast(t).alias(k) for k, t in (("symbol", "string"), ("year", "int"), ("month", "int"))]
    return stored_files(spark, path).groupBy(*month).agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes"))


def zone_size(spark: SparkSession, path: str) -> DataFrame:
    return stored_files(spark, path).agg(
        F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes")
    )
