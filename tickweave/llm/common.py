"""Helpers the operators share: tables cut to the shared folder, blocks of a global order, batches of whole texts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickweave.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame written once to the shared folder and read again: short lineage, and a lost executor costs a re-read."""
    path = shared_dir(df.sparkSession, name)
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_scopes: list[list[str]] = []


@contextmanager
def scope() -> Iterator[list[str]]:
    """The folders that `written` makes inside, for `dropped` once the result that reads them is written."""
    folders: list[str] = []
    _scopes.append(folders)
    try:
        yield folders
    finally:
        _scopes.remove(folders)


def dropped(spark: SparkSession, folders: list[str]) -> None:
    """Delete intermediate tables and forget them."""
    while folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folders.pop())
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query go as soon as it has ended, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def free(df: DataFrame, name: str) -> str:
    """The name, with underscores in front of it while the frame has such a column (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def smallest(df: DataFrame, hashed: str, rows: int, k: int, *ties: str) -> DataFrame:
    """The k rows with the smallest 64-bit hash. rows: how many there are; hashes that can't be among them are left out before the sort.

    Twice as many as asked for pass on the average, so no more than that are gathered, however many tasks there are.
    """
    share = (2 * k + 100) / max(1, rows)
    low = F.col(hashed) < int(-(2**63) + min(1.0, share) * 2**64 * (1 - 2**-53)) if share < 1 else F.lit(True)
    return df.where(low).orderBy(hashed, *ties).limit(k)


def in_order(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows in global order, cut into even ranges: `block` numbers the range a row is in.

    The ranges come from a sample of the keys and hold about equally many rows whatever the keys' values, so long
    as the last key tells rows apart. The table is written, so that every reader sees the same blocks.
    """
    cut = df.repartitionByRange(partitions(df.sparkSession), *order).withColumn("block", F.spark_partition_id())
    return written(cut, name)


def with_running(df: DataFrame, order: list[Column], sums: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Exclusive running sums over blocks made by `in_order`, of all rows or for each value of `by`.

    A block is summed for itself and takes over the totals of the blocks before it from a table with one row for
    each block and key, so no task sees more than a block. `by` must lead the order or have few values per block.
    """
    by = by or []
    names = list(sums)
    total = df.groupBy("block", *by).agg(*(F.sum(v).alias(f"_{n}") for n, v in sums.items()))
    before = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select("block", *by, *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in names))
    inside = Window.partitionBy("block", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.select("*", *(F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_in_{n}") for n, v in sums.items()))
    on = rows["block"] == total["block"]
    for b in by:
        on = on & rows[b].eqNullSafe(total[b])
    return rows.join(total, on).select(
        *(rows[c] for c in df.columns), *((rows[f"_in_{n}"] + total[f"_{n}"]).alias(n) for n in names))


def small_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that `column` holds about `limit` bytes in each; one longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, ends = text_bytes(batch.column(column))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + limit, side="right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of an Arrow column as one array, and the offsets of the texts in it; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]
