"""Operator 7, mixing sources to target weights: a curriculum whose weights change over training.

Sizes are words. The mix takes `share` times all words; sources get them by weight, none more than `most` times its own
words, and what a full source leaves goes to the others by weight (water filling in closed form over the source table).

In each source the documents follow one another in an order drawn from doc_id, again and again; the mix takes the first
`target` words of that row, so every document is taken whole `k` or `k + 1` times but for the one at the end. A source's
weight runs linearly from `a` at the start of training to `b` at its end. The integral of that schedule, scaled to the
target, is the source's cumulative demand; inverted, it gives the time at which each take of a document is due. Sorting by
that time is the training order.

DataFrame functions only. A source of any share is summed in blocks of the global order. Null source: a source of its own,
last; null text: size 0; a document without words is never taken. Repeated rows count one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_order, with_running, written

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: int) -> DataFrame:
    """source, source_size, weight, target of each source; sources: source, source_size. One row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    s = sources.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    s = s.withColumn("by", F.col("cap") / F.col("weight"))
    line = Window.orderBy("by", F.col("source").asc_nulls_last())
    filled = F.coalesce(F.sum("cap").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(line.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    s = s.withColumn("level", (F.lit(share) * F.sum("source_size").over(everything) - filled) / rest)
    s = s.withColumn("open", F.col("cap") > F.col("level") * F.col("weight"))
    level = F.max(F.when(F.col("open"), F.col("level"))).over(everything)
    target = F.when(F.col("open"), level * F.col("weight")).otherwise(F.col("cap").cast("double"))
    return s.select("source", "source_size", "weight", target.alias("target"))


def due(part: Column, a: Column, b: Column) -> Column:
    """The time in 0..1 at which a weight running from a to b has met `part` of its demand."""
    met = part * (a + b) / 2
    return 2 * met / (a + F.sqrt(a * a + 2 * (b - a) * met))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), late: tuple[float, ...] | None = None, share: float = 1.5,
        most: int = 2, keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, takes, time_1 .. time_<most> of each row, and its columns that `keep` names, in training order.

    weights, late: weights at the start and the end of training, given to the sources by code point in turn; late: the
    same weights reversed. taken: words the mix takes; takes: whole takes, rounded; time_k: when take k is due, else null.
    """
    late = late or weights[::-1]
    rows = docs.select("doc_id", "source", word_count("text").alias("size"), F.xxhash64("doc_id").alias("tie"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), *keep)
    rows = written(rows, "mix")
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    ends = F.element_at(F.array(*(F.lit(float(w)) for w in late)),
                        (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(late) + 1)
    sources = written(sources.withColumn("late", ends), "mix-targets")
    order = [F.col("source").asc_nulls_last(), F.col("tie"), F.col("doc_id"), F.col("text_hash"), *(F.col(c) for c in keep)]
    rows = with_running(in_order(rows, order, "mix-order"), order, {"at": F.col("size")}, ["source"])
    s = sources.withColumnRenamed("source", "_source")
    rows = rows.join(s, rows["source"].eqNullSafe(s["_source"])).drop("_source")
    goal, zero = F.round("target").cast("long"), F.lit(0).cast("long")
    part = [F.greatest(zero, F.least(F.col("size"), goal - k * F.col("source_size") - F.col("at"))) for k in range(most)]
    rows = rows.withColumn("taken", sum(part[1:], part[0]))
    times = {f"time_{k + 1}": F.when(p > 0, due(F.try_divide(k * F.col("source_size") + F.col("at") + p / 2, goal), F.col("weight"), F.col("late")))
             for k, p in enumerate(part)}
    takes = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    rows = rows.withColumns(times).withColumn("takes", takes)
    return rows.orderBy(F.col("time_1").asc_nulls_last(), "tie", "doc_id").select(
        "doc_id", "source", "text_hash", "size", "source_size", "target", "taken", "takes", *times, *keep)
