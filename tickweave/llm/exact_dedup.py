"""Operator 4, exact dedup: an extendible-hash index of distinct texts on shared files.

Texts are equal when they are the same bytes after deleting `[\\x20\\x09-\\x0D]`. Of equal texts the row with the most
code points stays, then the one with the smallest doc_id (null last), then one of the repeated rows.

1. Every row's key (64 bits), sha256 and length are written to the shared folder.
2. A directory is grown from the counts of distinct keys: a bucket over its capacity splits on its next key bit, and the
   directory doubles when the bucket has no spare bit. It has about `rows / capacity` entries.
3. Each task collapses the equal texts it holds, so that a text of which there are millions of copies leaves a task once.
4. Owner tasks take contiguous buckets, read their texts in key order, chain different texts that share a key and compare
   bytes along the chain; one entry for each distinct text goes to the index files.

Null and empty texts are one group. A task holds `FLUSH` bytes of texts at most, or one text and the chain of one key.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, partitions, small_batches, text_bytes, written

SPACES = b" \t\n\x0b\x0c\r"
FLUSH = 48 << 20
ROWS = "doc_id long, n_chars long, text_hash long, key long, sha binary"
ENTRIES = "owner int, bucket int, key long, sha binary, body binary, size long, keep_chars long, keep_id long"
INDEX = "bucket int, key long, chain int, sha binary, group_size long, keep_chars long, keep_id long"


def normalised(batch: pa.RecordBatch) -> Iterator[bytes]:
    data, at = text_bytes(batch.column("text"))
    raw = data.tobytes()
    for lo, hi in zip(at, at[1:], strict=False):
        yield raw[lo:hi].translate(None, SPACES)


def signed(key: int, bits: int) -> int:
    key >>= 64 - bits
    key <<= 64 - bits
    return key - (1 << 64) if key >> 63 else key


def row_keys(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text"):
            found = [(signed(xxhash.xxh64_intdigest(t), bits), hashlib.sha256(t).digest()) for t in normalised(b)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "n_chars", "text_hash")), pa.array([k for k, _ in found], pa.int64()),
                 pa.array([s for _, s in found], pa.binary())], ["doc_id", "n_chars", "text_hash", "key", "sha"])

    return run


class Directory:
    """Slots 0 to 2**depth - 1 that name buckets; a bucket with fewer local bits is named by several slots."""

    def __init__(self, cells: np.ndarray, capacity: int):
        """cells: keys counted by their leading bits, a power of two of cells."""
        top = int(math.log2(len(cells)))
        self.depth, sums = 0, np.concatenate([[0], np.cumsum(cells)])
        full, buckets = [(0, 0)], []
        while full:
            prefix, local = full.pop()
            width = top - local
            n = int(sums[(prefix + 1) << width] - sums[prefix << width])
            if n <= capacity or local == top:
                buckets.append((prefix << width, local, n))
                continue
            if local == self.depth:
                self.depth += 1  # the directory doubles
            full += [(2 * prefix + 1, local + 1), (2 * prefix, local + 1)]
        buckets.sort()
        self.counts = np.array([n for _, _, n in buckets])
        self.slots = np.repeat(np.arange(len(buckets), dtype=np.int32), [1 << (self.depth - local) for _, local, _ in buckets])

    def bucket(self, key: int) -> int:
        return int(self.slots[(key % (1 << 64)) >> (64 - self.depth)])

    def owners(self, tasks: int) -> np.ndarray:
        """The owner of each bucket: contiguous ranges of about equally many keys."""
        before = np.cumsum(self.counts) - self.counts
        return (before * tasks // max(1, int(self.counts.sum()))).astype(np.int32)


def collapsed(bits: int, directory: Directory, owners: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size = 0
        for b in small_batches(batches, "text"):
            for t, chars, i in zip(normalised(b), b.column("n_chars").to_pylist(), b.column("doc_id").to_pylist(), strict=True):
                best = (chars, i is not None, -(i or 0))
                if (x := held.get(t)) is None:
                    held[t] = [1, best]
                    size += len(t) + 200
                else:
                    x[0] += 1
                    x[1] = max(x[1], best)
            if size > FLUSH:
                yield from entries(held)
                held, size = {}, 0
        yield from entries(held)

    def entries(held: dict[bytes, list]) -> Iterator[pa.RecordBatch]:
        texts = list(held)
        for lo in range(0, len(texts), 1000):
            some = texts[lo : lo + 1000]
            keys = [signed(xxhash.xxh64_intdigest(t), bits) for t in some]
            buckets = [directory.bucket(k) for k in keys]
            best = [held[t][1] for t in some]
            yield pa.RecordBatch.from_arrays([
                pa.array([int(owners[x]) for x in buckets], pa.int32()), pa.array(buckets, pa.int32()), pa.array(keys, pa.int64()),
                pa.array([hashlib.sha256(t).digest() for t in some], pa.binary()), pa.array(some, pa.binary()),
                pa.array([held[t][0] for t in some], pa.int64()), pa.array([x[0] for x in best], pa.int64()),
                pa.array([-x[2] if x[1] else None for x in best], pa.int64())],
                ["owner", "bucket", "key", "sha", "body", "size", "keep_chars", "keep_id"])

    return run


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in (bucket, key) order to one index row for each distinct text."""
    key, chain, done = None, [], []

    def flush() -> None:
        done.extend((*x[:2], n, x[2], x[4], x[5][0], -x[5][2] if x[5][1] else None) for n, x in enumerate(chain))

    def batch() -> pa.RecordBatch:
        names = ["bucket", "key", "chain", "sha", "group_size", "keep_chars", "keep_id"]
        types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names)

    for b in batches:
        for lo in range(0, b.num_rows, 500):
            for r in b.slice(lo, 500).to_pylist():
                if r["key"] != key:
                    flush()
                    key, chain = r["key"], []
                best = (r["keep_chars"], r["keep_id"] is not None, -(r["keep_id"] or 0))
                for x in chain:
                    if x[3] == r["body"]:
                        x[4] += r["size"]
                        x[5] = max(x[5], best)
                        break
                else:
                    chain.append([r["bucket"], key, r["sha"], r["body"], r["size"], best])
            if len(done) > 5000:
                yield batch()
                done.clear()
    flush()
    yield batch()


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.length(text).cast("long").alias("n_chars"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def index(docs: DataFrame, capacity: int = 1 << 14, key_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """The rows (with key and sha256) and the index (one row for each distinct text), both on shared files.

    capacity: distinct keys in a bucket before it splits. key_bits: how many bits of the key count; fewer force chains.
    """
    spark, source = docs.sparkSession, keyed(docs)
    rows = written(source.mapInArrow(row_keys(key_bits), ROWS).withColumn("row", F.monotonically_increasing_id()), "exact-rows")
    keys = rows.select("key").distinct()
    n = rows.count()
    top = max(0, math.ceil(math.log2(max(1, n) / capacity))) + 3
    cells = np.zeros(1 << top, np.int64)
    for cell, count in keys.groupBy(F.shiftrightunsigned("key", 64 - top).alias("cell")).count().collect():
        cells[cell] = count
    directory, tasks = Directory(cells, capacity), partitions(spark)
    owners = directory.owners(tasks)
    entries = (source.mapInArrow(collapsed(key_bits, directory, owners), ENTRIES)
               .repartitionById(tasks, F.col("owner")).sortWithinPartitions("bucket", "key"))
    return rows, written(entries.mapInArrow(chained, INDEX), "exact-index")


def exact_dedup(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_chars, text_hash, sha, keep_id, group_size, kept. Other columns of docs are ignored.

    Rows that repeat doc_id and text count one by one; one of them is kept. An empty table gives an empty result.
    """
    rows, found = index(docs, **options)
    winner = (rows.join(found.select("sha", "keep_chars", "keep_id"), "sha")
              .where((F.col("n_chars") == F.col("keep_chars")) & F.col("doc_id").eqNullSafe(F.col("keep_id")))
              .groupBy("sha").agg(F.min("row").alias("keep_row")))
    classes = found.select("sha", "keep_id", "group_size").join(winner, "sha")
    return rows.join(classes, "sha").select(
        "doc_id", "n_chars", "text_hash", "sha", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"))


def keep_rows(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of docs that `decided` (doc_id, text_hash) names, each once, with the columns of docs, whatever their names."""
    key, body = free(docs, "_id"), free(docs, "_hash")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    left = docs.withColumns({key: name, body: F.xxhash64(F.coalesce("text", F.lit("")))})
    right = decided.select(name.alias(key), F.col("text_hash").alias(body))
    return left.join(right, [key, body], "left_semi").dropDuplicates([key, body]).select(*docs.columns)
