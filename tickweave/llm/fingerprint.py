"""Operator 8, document fingerprints: a homomorphic multiset hash of a text's paragraphs.

Each paragraph (text between line feeds) is hashed to a wide vector; a document's fingerprint is the sum of its
paragraphs' vectors modulo 2**32 in every lane, and so does not depend on their order: inserting a paragraph adds its
vector, deleting one subtracts it, without the rest of the text. Two kinds of lanes make up the vector:

* 16 lanes of eight seeded 64-bit hashes of the whole paragraph: what tells unequal documents apart (not made against an
  adversary who searches for collisions).
* `SIGNS` lanes, sums of +1 and -1 from the hash bits of the paragraph's pieces of `PIECE` code points, and a lane that
  counts the pieces. Vectors of independent signs are nearly orthogonal, so the cosine of two such sums estimates that of
  the piece multisets, within about 1 / sqrt(SIGNS): the likeness of two fingerprints.

Column expressions only; the neighbour of each document comes from a global order by doc_id. Null and
empty text: one empty paragraph, no pieces; the likeness of two texts without pieces is 1, of one with and one without 0.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, written

SIGNS, PIECE, SEEDS, LANE = 64, 32, 8, 0xFFFFFFFF


def _sum(array: Column, value) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda total, x: total + value(x))


def _seeded(k: int, p: Column) -> Column:
    return F.xxhash64(F.lit(k), p)


def vector(text: str) -> Column:
    """The lanes of a text as an array of longs below 2**32: 16 for equality, the number of pieces, and per sign bit the pieces that have it."""
    paragraphs = F.split(F.col(text), "\n")
    pieces = F.transform(F.regexp_extract_all(F.col(text), F.lit(r"[^\n]{1,%d}" % PIECE), F.lit(0)), lambda p: F.xxhash64(p))
    hashes = [F.transform(paragraphs, partial(_seeded, k)) for k in range(SEEDS)]

    def lanes(h, s):
        equal = [_sum(x, lambda v, r=r: F.shiftrightunsigned(v, r).bitwiseAND(F.lit(LANE))) for x in h for r in (0, 32)]
        both = F.lit((1 << 32) + 1)  # bits i and i + 32 are counted in the two halves of one sum
        bits = [_sum(s, lambda v, r=r: F.shiftrightunsigned(v, r).bitwiseAND(both)) for r in range(SIGNS // 2)]
        halves = F.flatten(F.transform(F.array(*bits), lambda b: F.array(b.bitwiseAND(F.lit(LANE)), F.shiftrightunsigned(b, 32))))
        return F.concat(F.transform(F.array(*equal), lambda e: e.bitwiseAND(F.lit(LANE))), F.array(F.size(s).cast("long")), halves)

    return bound([F.array(*hashes), pieces], lambda h, s: lanes([h[k] for k in range(SEEDS)], s))


def added(a: Column, b: Column, sign: int = 1) -> Column:
    """The vector with another's paragraphs inserted, or deleted with sign -1."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + sign * y, F.lit(1 << 32)))


def spelt(v: Column) -> Column:
    """The fingerprint as hexadecimal digits, eight for each lane."""
    return F.concat_ws("", F.transform(v, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))))


def likeness(a: Column, b: Column) -> Column:
    """Estimated cosine of the piece multisets, 0 to 1; 1 for equal vectors."""
    def signs(v: Column) -> Column:
        return F.transform(F.slice(v, 2 * SEEDS + 2, SIGNS), lambda x: (2 * x - v[2 * SEEDS]).cast("double"))

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda t, z: t + z)

    def cosine(x: Column, y: Column) -> Column:
        return F.try_divide(dot(x, y), F.sqrt(dot(x, x) * dot(y, y)))

    cos = bound([signs(a), signs(b)], cosine)
    empty = (a[2 * SEEDS] == 0) | (b[2 * SEEDS] == 0)
    return F.when(a == b, 1.0).when(empty, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(cos, F.lit(0.0)))))


def bound(values: list[Column], f) -> Column:
    """f of the values, each of which is computed once however often f uses it."""
    held = F.array(F.struct(*(v.alias(f"v{i}") for i, v in enumerate(values))))
    return F.element_at(F.transform(held, lambda x: f(*(x[f"v{i}"] for i in range(len(values))))), 1)


def in_buckets(docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id, text, row, bucket: buckets rise as doc_id falls, null last.

    Buckets lie between sampled quantiles of doc_id, so they hold about equally many rows whatever the ids are. An id that is
    several quantiles is cut by its rows' hash into as many buckets, as are the rows without doc_id. Only rows that repeat
    doc_id and text stay in one bucket.
    """
    cuts = docs.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 100 * buckets)).first()[0] or []
    cuts = F.lit(cuts).cast("array<long>") if cuts else F.array().cast("array<long>")
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    alone = F.lit(1 << 62) + F.shiftright("row", 56)
    above, same = (F.size(F.filter(cuts, f)).cast("long") for f in (lambda c: c > F.col("doc_id"), lambda c: c == F.col("doc_id")))
    base = base.withColumns({"above": above, "same": same})
    # an id that is a quantile comes after those above it and before those below
    part = F.least(F.floor((F.col("row") / F.lit(2.0**64) + 0.5) * F.col("same")), F.greatest(F.col("same") - 1, F.lit(0)))
    bucket = F.shiftleft(2 * F.col("above") + F.col("same"), 20) + part
    return base.withColumn("bucket", F.when(F.col("doc_id").isNull(), alone).otherwise(bucket).cast("long")).drop("above", "same")


def heads(cut: DataFrame, tasks: int) -> DataFrame:
    """bucket, next_text: the text that follows the last row of each bucket, the first one of the next bucket.

    The first rows are found by their keys; only their texts, some 4 for each task, are read again and joined. What follows
    the last bucket is the first one.
    """
    # the first row is the one with the largest doc_id (null last), then the smallest hash
    first = F.max(F.struct(F.col("doc_id").isNotNull().alias("a"), F.col("doc_id").alias("b"), F.bitwise_not("row").alias("c")))
    keys = cut.groupBy("bucket").agg(first.alias("first")).select("bucket", F.col("first.b").alias("doc_id"), F.bitwise_not("first.c").alias("row"))
    keys = written(keys, "fingerprint-heads")
    order = Window.orderBy("bucket")  # a row for each bucket, some 4 for each task
    start = F.min("bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = keys.select(F.col("bucket").alias("of"), F.coalesce(F.lead("bucket").over(order), start).alias("bucket"))
    same = cut["doc_id"].eqNullSafe(keys["doc_id"]) & (cut["row"] == keys["row"]) & (cut["bucket"] == keys["bucket"])
    texts = cut.join(F.broadcast(keys), same).select(keys["bucket"], cut["text"]).dropDuplicates(["bucket"])
    return written(texts.join(after, "bucket").select(F.col("of").alias("bucket"), F.col("text").alias("next_text")), "fingerprint-next")


def edits(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text, edited of each row: the last half of each text replaced by the start of the next document.

    Texts are shuffled once, into ranges of buckets, and written nowhere. In a bucket each row looks at the next one; the last row of
    each bucket gets its neighbour from `heads`.
    """
    tasks = partitions(docs.sparkSession)
    cut = in_buckets(docs, 4 * tasks)
    line = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), "row")
    rows = cut.repartitionByRange(tasks, "bucket").withColumn("next_text", F.lead("text").over(line))
    inner = rows.where(F.col("next_text").isNotNull())
    ends = rows.where(F.col("next_text").isNull()).drop("next_text").join(heads(cut, tasks), "bucket").select(*rows.columns)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    return inner.union(ends).select("doc_id", "text", "next_text", edited.alias("edited"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (vectors), near_edited, near_next of each row.

    Rows that repeat a doc_id follow one another, in the order of their hash. Other columns are ignored.
    """
    found = bound([vector("text"), vector("edited"), vector("next_text")], lambda a, b, c: F.struct(
        a.alias("fingerprint"), b.alias("edited_fingerprint"), likeness(a, b).alias("near_edited"), likeness(a, c).alias("near_next")))
    return edits(docs).select("doc_id", F.length("text").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), found.alias("found")).select(
        "doc_id", "n_chars", "edited_sha256", "found.*")
