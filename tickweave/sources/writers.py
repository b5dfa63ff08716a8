"""Table sinks."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_bars(bars: DataFrame, path: str) -> None:
    """Write bars by symbol/year/month, replacing only the months that ``bars`` holds.

    Feed whole months (see ``lifecycle.merge_keep_existing``): a touched month is replaced by what is given.
    Rows are spread by symbol, month and a day salt so that one hot symbol-month is not one task.
    """
    (
        bars.withColumn("year", F.year("ts"))
        .withColumn("month", F.month("ts"))
        .repartition("symbol", "year", "month", F.dayofmonth("ts") % 4)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "snappy")
        .partitionBy("symbol", "year", "month")
        .parquet(path)
    )


def replace_table(df: DataFrame, path: str) -> None:
    """Replace a table whole, one directory per symbol."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy("symbol")
        .parquet(path)
    )


def upsert_table(updates: DataFrame, path: str, key: list[str], tie: str, part: str, staging: str) -> None:
    """Apply updates to a table stored by ``part``: only the partitions they touch are read, merged and replaced.

    The merge is written to ``staging`` first, as a table cannot be read and replaced in one job.
    """
    spark = updates.sparkSession
    stored = spark.read.parquet(path)
    touched = stored.join(updates.select(part).distinct(), part, "left_semi")
    upserted(touched.select(*updates.columns), updates, key, tie).write.parquet(staging)
    spark.read.parquet(staging).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def upserted(target: DataFrame, updates: DataFrame, key: list[str], tie: str) -> DataFrame:
    """Target rows with updates applied: an update replaces all other columns of its key.

    Two anti-joined halves, so a hot key needs no window; several updates of one key are settled by the
    highest ``tie``.
    """
    values = [c for c in updates.columns if c not in key]
    newest = updates.groupBy(*key).agg(F.max_by(F.struct(*values), tie).alias("_u")).select(*key, "_u.*")
    return target.join(newest.select(*key), key, "left_anti").unionByName(newest.select(*target.columns))


def write_document(df: DataFrame, path: str, name: str, saved_at: str) -> None:
    meta = F.struct(F.lit(name).alias("name"), F.lit(saved_at).alias("saved_at"))
    df.withColumn("_metadata", meta).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def matrix_wide(long: DataFrame, symbols: list[str] | None = None) -> DataFrame:
    """A long matrix as one column per symbol (for export); the long form is what operators use."""
    return long.groupBy("symbol_row").pivot("symbol_col", symbols).agg(F.first("value"))


def series_wide(long: DataFrame, symbols: list[str] | None = None) -> DataFrame:
    return long.groupBy("date").pivot("symbol", symbols).agg(F.first("value")).na.fill(0.0)


def series_long(wide: DataFrame) -> DataFrame:
    return wide.unpivot(["date"], [c for c in wide.columns if c != "date"], "symbol", "value")


def retain(spark: SparkSession, path: str, schema: str, days: int, staging: str) -> int:
    """Remove the bars older than ``days`` before the newest one from a lake written by `write_bars`; gives the months removed whole.

    Months before the limit are dropped by their folders, only the month it falls in is read and written anew (through ``staging``, a new folder, as
    a table is not overwritten while it is read), later ones are not touched. Running it again changes nothing.
    """
    from .readers import listed_partitions

    found = listed_partitions(spark, path)
    if not found:
        return 0
    lake = spark.read.schema(f"{schema}, symbol STRING, year INT, month INT").parquet(path)
    last = max((y, m) for _, y, m, _ in found)
    newest = lake.where((F.col("year") == last[0]) & (F.col("month") == last[1])).agg(F.max("ts").alias("t")).first()["t"]
    limit = newest - timedelta(days=days)
    at = limit.year, limit.month
    edge = lake.where((F.col("year") == at[0]) & (F.col("month") == at[1]) & (F.col("ts") > F.lit(limit)))
    edge.write.mode("overwrite").parquet(staging)
    kept = spark.read.schema(edge.schema).parquet(staging)
    left = {r["symbol"] for r in kept.select("symbol").distinct().collect()}
    if left:
        write_bars(kept.drop("year", "month"), path)
    gone = [folder for s, y, m, folder in found if (y, m) < at or (y, m) == at and s not in left]
    for folder in gone:
        old = spark._jvm.org.apache.hadoop.fs.Path(folder)
        old.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(old, True)
    return len(gone)
