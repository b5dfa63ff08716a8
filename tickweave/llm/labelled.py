"""Which labelled rows may be learnt from, and which are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id as text leaves 1 when divided by 3; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training(labels: DataFrame, label: str) -> DataFrame:
    """doc_id and label (0 or 1) of the rows to learn from; a doc_id labelled several times counts as 1 if one of them says so."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out())
    return rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
