"""Operator 10, sharding: a consistent-hash ring with virtual nodes and bounded loads.

A text's hash is its place on the ring, so equal texts stand together. Each shard has `vnodes` points on the ring; a key
belongs to the next point clockwise. A shard takes `(1 + slack)` of the mean bytes; what finds it full goes on to the next
shard clockwise. Keys between two points share their way round, so the overflow is worked out on the bytes of the
`shards * vnodes` arcs and gives each arc a few intervals of bytes, one for each shard it reaches. A row finds its interval
by its running bytes in the arc, which come from blocks of the ring's order: a text with a third of all rows runs over many
blocks and, where it must, over several shards. Equal texts of at most `together` of the mean are never parted by an
interval's end, so a shard may pass its bound by that much at each of its few ends.

A null text counts as empty. Ties of place and doc_id are broken by the hash of doc_id, doc_id (null first) and size;
rows equal in all of these are alike.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_order, with_running, written

CIRCLE = 1 << 32


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(place, shard) in clockwise order."""
    at = {}
    for s in range(shards):
        for v in range(vnodes):
            at[int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=4).digest(), "big")] = s
    return sorted(at.items())


def clockwise(points: list[tuple[int, int]], arc: int) -> list[int]:
    """The shards an arc's keys reach, in order."""
    return list(dict.fromkeys(points[(arc + i) % len(points)][1] for i in range(len(points))))


def intervals(points: list[tuple[int, int]], loads: dict[int, int], shards: int, slack: float) -> list[tuple[int, int, int, int]]:
    """(arc, from byte, to byte, shard): each round offers what is left of every arc to its next shard, in ring order."""
    room = dict.fromkeys(range(shards), math.ceil((1 + slack) * sum(loads.values()) / shards))
    placed, left = dict.fromkeys(loads, 0), [a for a in sorted(loads) if loads[a]]
    ways, out = {a: clockwise(points, a) for a in left}, []
    for step in range(shards):
        for a in left:
            if step < len(ways[a]) and (take := min(room[ways[a][step]], loads[a] - placed[a])):
                out.append((a, placed[a], placed[a] + take, ways[a][step]))
                placed[a] += take
                room[ways[a][step]] -= take
        left = [a for a in left if placed[a] < loads[a]]
    return out


def shard(docs: DataFrame, shards: int = 8, vnodes: int = 128, slack: float = 0.005,
          together: float = 0.01) -> DataFrame:
    """doc_id, size (bytes and 1), text_crc32, ring_place, shard, slot (gapless in its shard) of each row; other columns are ignored."""
    spark, points = docs.sparkSession, ring(shards, vnodes)
    places = np.array([p for p, _ in points])

    @F.pandas_udf("int")
    def arc(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(places, place.to_numpy()) % len(places))

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(CIRCLE)).alias("ring_place"), F.xxhash64("doc_id").alias("tie"))
    rows = written(rows.withColumn("arc", arc("ring_place")), "ring")
    order = [F.col(c) for c in ("arc", "ring_place", "tie", "doc_id", "size")]
    rows = with_running(in_order(rows, order, "ring-order"), order, {"at": F.col("size")}, ["arc"])
    group = Window.partitionBy("block", "arc", "ring_place")
    loads = {r[0]: r[1] for r in rows.groupBy("arc").agg(F.sum("size")).collect()}
    mean = sum(loads.values()) / shards
    start = F.when(F.sum("size").over(group) <= together * mean, F.min("at").over(group)).otherwise(F.col("at"))
    cut = spark.createDataFrame(intervals(points, loads, shards, slack), "arc int, lo long, hi long, shard int")
    # one row for each arc and shard it reaches: at most shards * vnodes and a few
    rows = rows.withColumn("start", start).join(F.broadcast(cut), "arc").where("start >= lo and start < hi")
    return with_running(written(rows, "ring-shards"), order, {"slot": F.lit(1)}, ["shard"]).select(
        "doc_id", "size", "text_crc32", "ring_place", "shard", F.col("slot").cast("long").alias("slot"))
