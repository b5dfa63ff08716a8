"""Operator 13, hard negatives: exact integer inner products by subset-sum tables ("Four Russians").

A component x becomes floor(scale * x). An anchor's components are cut into groups of eight, and for each group a table of 256
entries holds the sums of all subsets of the eight. A candidate's components are two's complement numbers of `planes` bits
(as many as the largest needs); the bits of one plane and one group make a byte. The score of a plane is the sum over groups of
the table's entry at that byte, and the planes' scores are added with their weights 2**b, the highest one negative: shift
and add. No multiplication of components takes place, and the score is the exact inner product.

The anchors are a stated query set against all rows. They are taken in batches of at most `batch` bytes of components, so
what is broadcast does not grow with the data; in each batch every task scores its candidates block by block and keeps, for
each anchor, the best few, which are shuffled and ranked. A first pass finds the positives, a second one the negatives of
each positive between its two bounds.

Rows with a null label, a null vector or a null or non-finite component take no part. Missing components at the end of a shorter
vector count as 0. Rows with a null id come last in ties and are no anchors; rows that repeat an id are rows of their
own. Where 64 bits do not hold the scores (components of some 2**28 and more), it raises ValueError. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickweave.session import shared_dir

from .common import partitions, written

GROUP, BLOCK, TABLES = 8, 2048, 1 << 17
TOP = "anchor long, positive long, positive_id long, positive_score long, row long, vec_id long, score long"


def tables(anchors: np.ndarray) -> np.ndarray:
    """Subset sums of each group of eight components: (groups, 256, anchors). The columns of anchors fill whole groups."""
    n, d = anchors.shape
    out = np.zeros((d // GROUP, 256, n), anchors.dtype)
    for bit in range(GROUP):
        half = 1 << bit
        out[:, half : 2 * half] = out[:, :half] + anchors[:, bit::GROUP].T[:, None, :]
    return out


def packed(rows: np.ndarray, planes: int) -> np.ndarray:
    """Bit planes of the rows' two's complement components, eight of a group in a byte: (planes, groups, rows)."""
    bits = (rows[None] >> np.arange(planes)[:, None, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").transpose(0, 2, 1)


def scores(table: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(rows, anchors): Horner's rule over the planes, the highest of which counts negative."""
    total = None
    for b in range(len(planes) - 1, -1, -1):
        here = table[0][planes[b, 0]]
        for g in range(1, len(table)):
            here += table[g][planes[b, g]]
        total = -here if total is None else 2 * total + here
    return total


def whole(components: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """Rows of `width` components, shorter ones filled with 0."""
    out = np.zeros((len(offsets) - 1, width), np.int64)
    size = np.diff(offsets)
    at = np.repeat(np.arange(len(size)), size)
    out[at, np.arange(len(components)) - np.repeat(offsets[:-1] - offsets[0], size)] = components
    return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return whole(column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy(), width)


def usable(vectors: DataFrame, vec_id: str, embedding: str, label: str, scale: int) -> DataFrame:
    """row, vec_id, label, q (integer components) of the rows that take part. Numbered, so it has to be written."""
    x = F.transform(F.col(embedding), lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    q = F.transform(x, lambda v: F.floor(v * scale).cast("long"))
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), q.alias("q"), fine.alias("fine")).where(
        F.col("label").isNotNull() & F.col("q").isNotNull() & F.col("fine")).select(
        F.monotonically_increasing_id().alias("row"), "vec_id", F.col("label").cast("long").alias("label"), "q")


def best_few(keys: np.ndarray, value: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each key: larger value first, then smaller id, then smaller row."""
    order = np.lexsort((rows, ids, -value, keys))
    sorted_keys = keys[order]
    first = np.searchsorted(sorted_keys, sorted_keys)
    return order[np.arange(len(order)) - first < k]


def hard_negatives(vectors: DataFrame, anchor: Column, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
                   positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, batch: int = 4 << 20) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchor: a condition on `vec_id` (under that name). A positive of score p takes the first `negatives` rows of other labels
    with low * p <= 100 * score <= high * p.
    """
    spark = vectors.sparkSession
    rows = written(usable(vectors.repartition(partitions(spark)), vec_id, embedding, label, scale), "negatives-rows")
    size = F.array_max(F.transform("q", lambda v: F.abs(v.cast("double"))))
    bound = rows.agg(F.max(F.size("q")).alias("width"), F.max(size).alias("most"), F.count(F.when(anchor, 1)).alias("anchors")).first()
    most, width = int(bound["most"] or 0), -(-max(1, bound["width"] or 0) // GROUP) * GROUP
    if most * most * width >= 1 << 62:
        raise ValueError(f"components of {most} in {width} dimensions: 64 bits don't hold their scores")
    planes = most.bit_length() + 1
    kind = np.int32 if most * most * width < 1 << 30 else np.int64
    parts = max(1, -(-bound["anchors"] * 10 * width // batch))  # 8 bytes a component, and room for uneven parts
    if parts == 1:
        return one_batch(rows, rows.where(anchor), width, planes, kind, positives, negatives, low, high)
    numbered = rows.where(anchor).withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    chosen, path = written(numbered, "negatives-anchors"), shared_dir(spark, "negatives")
    for part in range(parts):
        found = one_batch(rows, chosen.where(F.col("part") == part), width, planes, kind, positives, negatives, low, high)
        found.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def one_batch(rows: DataFrame, chosen: DataFrame, width: int, planes: int, kind: type, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The result for a bounded number of anchors; their components are broadcast and scored against all rows."""
    sc = rows.sparkSession.sparkContext
    got = chosen.select("row", "vec_id", "label", "q").toArrow().combine_chunks()
    column = {c: got.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("row", "vec_id", "label")} if got.num_rows else {}
    q = got.column("q").combine_chunks() if got.num_rows else None
    anchors = sc.broadcast((column, matrix(q, width).astype(kind) if q is not None else np.zeros((0, width), kind)))

    def scored(batches: Iterator[pa.RecordBatch], keep) -> Iterator[pa.RecordBatch]:
        """keep(blocks of anchors, ids and labels of rows, their scores) gives arrays of TOP's columns."""
        column, table = anchors.value
        step = max(1, TABLES // (256 * (width // GROUP)))
        held: list[list[np.ndarray]] = []
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                some = b.slice(lo, BLOCK)
                bits = packed(matrix(some.column("q"), width), planes)
                ids = some.column("vec_id").fill_null((1 << 63) - 1).to_numpy()
                row, label = some.column("row").to_numpy(), some.column("label").to_numpy()
                for first in range(0, len(table), step):
                    part = slice(first, first + step)
                    s = scores(cached(first, table[part]), bits)
                    found = keep({c: v[part] for c, v in column.items()}, first, row, ids, label, s)
                    if found is not None:
                        held.append(found)
            if sum(len(h[0]) for h in held) > 1 << 16:
                held = [merged(held)]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in merged(held)], [c.split()[0] for c in TOP.split(", ")])

    made: dict[int, np.ndarray] = {}

    def cached(first: int, part: np.ndarray) -> np.ndarray:
        if first not in made:
            made[first] = tables(part)
        return made[first]

    def merged(held: list[list[np.ndarray]]) -> list[np.ndarray]:
        """The best rows of each (anchor, positive) so far; column 1 is -1 in the pass for positives."""
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        k = positives if len(cols[1]) and cols[1][0] < 0 else negatives
        _, key = np.unique(np.stack([cols[0], cols[1]]), axis=1, return_inverse=True)
        top = best_few(key.reshape(-1), cols[6], cols[5], cols[4], k)
        return [c[top] for c in cols]

    def same_label(anchor, first, row, ids, label, s):
        fit = (label[:, None] == anchor["label"][None]) & (row[:, None] != anchor["row"][None])
        c, a = np.nonzero(fit)
        if not len(c):
            return None
        none = np.full(len(c), -1)
        found = [anchor["row"][a], none, none, none, row[c], ids[c], s[c, a].astype(np.int64)]
        return merged([found])

    def positive(batches):
        return scored(batches, same_label)

    def ranked(df: DataFrame, k: int) -> DataFrame:
        w = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "vec_id", "row")
        return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    top = ranked(rows.mapInArrow(positive, TOP), positives).select("anchor", "row", "vec_id", "score").toArrow()
    place = {int(r): i for i, r in enumerate(column.get("row", []))}
    of = np.array([place[a] for a in top.column("anchor").to_pylist()], np.int64)
    order = np.argsort(of, kind="stable")
    pairs = sc.broadcast((np.searchsorted(of[order], np.arange(len(place) + 1)), *(top.column(c).to_numpy()[order] for c in ("row", "vec_id", "score"))))

    def between(anchor, first, row, ids, label, s):
        at, p_row, p_id, p_score = pairs.value
        n = len(anchor["row"])
        low_p, high_p = at[first : first + n], at[first + 1 : first + n + 1]
        fit = label[:, None] != anchor["label"][None]
        out = []
        for k in range(positives):
            a = np.flatnonzero(low_p + k < high_p)
            if not len(a):
                break
            p = low_p[a] + k
            mine = s[:, a].astype(np.int64)
            least, most = -(-low * p_score[p] // 100), high * p_score[p] // 100
            c, j = np.nonzero(fit[:, a] & (mine >= least) & (mine <= most))
            if len(c):
                out.append(merged([[anchor["row"][a[j]], p_row[p[j]], p_id[p[j]], p_score[p[j]], row[c], ids[c], mine[c, j]]]))
        return [np.concatenate(c) for c in zip(*out, strict=True)] if out else None

    def negative(batches):
        return scored(batches, between)

    names = chosen.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    found = ranked(rows.mapInArrow(negative, TOP), negatives).join(names, "anchor")
    null = F.lit((1 << 63) - 1)
    return found.select("anchor_id", F.nullif("positive_id", null).alias("positive_id"), "rank", F.nullif("vec_id", null).alias("negative_id"),
                        "positive_score", F.col("score").alias("negative_score"))
