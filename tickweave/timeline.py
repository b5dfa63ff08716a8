"""Ordered work on long series without sorting a whole series in one task.

A symbol's history has no upper size, and one symbol may hold a third of all bars, so no operator here
partitions a window by symbol alone. Three steps replace that:

* ``number_rows`` gives every row its position: rows are numbered inside calendar slices and the slice
  counts are summed into offsets (the summary holds one row per key and slice);
* ``trailing`` cuts the positions into equal blocks and copies the last ``reach`` rows of each block into
  the next one, so any frame that looks back at most ``reach`` rows is exact inside its block;
* ``running`` accumulates inside a block and adds what the earlier blocks sum to.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK = 65_536


def number_rows(
    df: DataFrame,
    *,
    key: Sequence[str] = ("symbol",),
    order: Sequence[str | Column] = ("ts",),
    slice_by: Column | None = None,
    out: str = "pos",
) -> DataFrame:
    """1-based position of each row inside its key; ``slice_by`` must rise with ``order``."""
    k = list(key)
    sliced = df.withColumn("_slice", F.year("ts") * 12 + F.month("ts") if slice_by is None else slice_by)
    before = Window.partitionBy(*k).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*k, "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*k, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*k, "_slice").orderBy(*order)
    return (
        sliced.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, [*k, "_slice"])
        .withColumn(out, F.col("_before") + F.col("_rn"))
        .drop("_slice", "_rn", "_before")
    )


def _block(pos: str, size: int) -> Column:
    return F.floor((F.col(pos) - 1) / size)


def trailing(
    df: DataFrame,
    reach: int,
    columns: Callable[[WindowSpec], dict[str, Column]],
    *,
    key: Sequence[str] = ("symbol",),
    pos: str = "pos",
    block: int = BLOCK,
) -> DataFrame:
    """Add columns whose frames look back at most ``reach`` rows."""
    block = max(block, reach + 1)
    own = _block(pos, block)
    edge = (F.col(pos) - 1) % block >= block - reach
    spread = df.withColumn("_own", own).withColumn(
        "_home", F.explode(F.when(edge, F.array(own, own + 1)).otherwise(F.array(own)))
    )
    w = Window.partitionBy(*key, "_home").orderBy(pos)
    added = [c.alias(n) for n, c in columns(w).items()]
    return spread.select("*", *added).filter("_own = _home").drop("_own", "_home")


_MERGE = {
    "sum": (F.sum, lambda a, b: a + b, 0),
    "product": (F.product, lambda a, b: a * b, 1),
    "max": (F.max, lambda a, b: F.greatest(a, b), None),
}


def running(
    df: DataFrame,
    totals: dict[str, tuple[str, Column]],
    *,
    key: Sequence[str] = ("symbol",),
    pos: str | Column = "pos",
    slice_by: Column | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Add running totals over all earlier rows and the current one: ``{name: (sum|product|max, expr)}``."""
    k = list(key)
    sliced = df.withColumn("_slice", _block(pos, block) if slice_by is None else slice_by)
    for n, (_, e) in totals.items():
        sliced = sliced.withColumn(f"_x_{n}", e)
    before = Window.partitionBy(*k).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = sliced.groupBy(*k, "_slice").agg(*[_MERGE[m][0](f"_x_{n}").alias(f"_t_{n}") for n, (m, _) in totals.items()])
    carry = carry.select(
        *k, "_slice", *[_MERGE[m][0](f"_t_{n}").over(before).alias(f"_c_{n}") for n, (m, _) in totals.items()]
    )
    inside = (
        Window.partitionBy(*k, "_slice").orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = sliced.select("*", *[_MERGE[m][0](f"_x_{n}").over(inside).alias(n) for n, (m, _) in totals.items()])
    out = out.join(carry, [*k, "_slice"])
    for n, (m, _) in totals.items():
        _, merge, unit = _MERGE[m]
        prior = F.col(f"_c_{n}") if unit is None else F.coalesce(F.col(f"_c_{n}"), F.lit(unit))
        out = out.withColumn(n, merge(prior, F.col(n)))
    return out.drop("_slice", *[f"_{p}_{n}" for n in totals for p in "xc"])


def smoothed(
    df: DataFrame,
    columns: dict[str, tuple[str, float, int]],
    *,
    key: Sequence[str] = ("symbol",),
    pos: str = "pos",
    block: int | None = None,
) -> DataFrame:
    """Exponential smoothing ``e = a*x + (1-a)*e'`` for ``{output: (input, a, seed)}``, started by the plain mean
    of the first ``seed`` rows; null before.

    One window over blocks, without a join: a value is a sum of its inputs times powers of ``1-a`` and of the first mean, so it
    needs the rows back to where the power falls below what doubles hold (``exp(-45)`` of their size). Those rows are copied into
    the blocks they reach. Powers are counted from the block's start, and blocks are cut so that they stay finite
    (``exp(300)`` at most), which leaves about every seventh row to be copied. Columns whose rates are too far apart for
    common blocks are done one after the other.
    """
    rates = [-math.log1p(-a) for _, a, _ in columns.values()]
    size = block or max(1, int(300 / max(rates)))
    reach = max(math.ceil(45 / rate) + seed for rate, (_, _, seed) in zip(rates, columns.values(), strict=True))
    if not block and reach > size and len(columns) > 1:
        for out, spec in columns.items():
            df = smoothed(df, {out: spec}, key=key, pos=pos)
        return df
    at, own = F.col(pos), _block(pos, size)
    homes = F.when(at >= 1, F.sequence(own, F.floor((at - 1 + reach) / size))).otherwise(F.array(own))
    d = df.withColumn("_own", own).withColumn("_home", F.explode(homes)).withColumn("_age", at - F.col("_home") * size)
    w = Window.partitionBy(*key, "_home").orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = []
    for out, (value, alpha, seed) in columns.items():
        keep, first = F.lit(1.0 - alpha), F.when((at >= 1) & (at <= seed), F.col(value))
        later = F.sum(F.when(at > seed, F.col(value) * alpha * F.pow(keep, -F.col("_age")))).over(w)
        start = F.try_divide(F.sum(first).over(w), F.count(first).over(w))
        total = F.coalesce(later, F.lit(0.0)) * F.pow(keep, F.col("_age")) + F.coalesce(start, F.lit(0.0)) * F.pow(keep, at - seed)
        added.append(F.when(at >= seed, total).alias(out))
    kept = [c for c in d.columns if c not in columns]
    return d.select(*kept, *added).filter("_own = _home").drop("_own", "_home", "_age")


def wealth(
    df: DataFrame, growth: Column, *, key: Sequence[str] = ("symbol",), pos: str = "pos", block: int = BLOCK
) -> DataFrame:
    """Add ``value``, the running product of ``growth`` from 1, and ``peak``, its running maximum from 1.

    Per block the product and the extreme inner values are enough to continue both in the next block; the
    lowest counts too because a growth factor may be negative.
    """
    k = list(key)
    d = df.withColumn("_slice", _block(pos, block)).withColumn("_g", growth)
    inside = Window.partitionBy(*k, "_slice").orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_v", F.product("_g").over(inside))
    d = d.select("*", F.max("_v").over(inside).alias("_m"), F.min("_v").over(inside).alias("_l"))
    blocks = d.groupBy(*k, "_slice").agg(F.product("_g").alias("_p"), F.max("_v").alias("_top"), F.min("_v").alias("_low"))
    before = Window.partitionBy(*k).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_from", F.coalesce(F.product("_p").over(before), F.lit(1.0)))

    def highest(top: str, low: str) -> Column:
        return F.greatest(F.col("_from") * F.col(top), F.col("_from") * F.col(low))

    blocks = blocks.withColumn("_high", F.greatest(F.lit(1.0), F.max(highest("_top", "_low")).over(before)))
    d = d.join(blocks.select(*k, "_slice", "_from", "_high"), [*k, "_slice"])
    return (
        d.withColumn("value", F.col("_from") * F.col("_v"))
        .withColumn("peak", F.greatest(F.col("_high"), highest("_m", "_l")))
        .drop("_slice", "_g", "_v", "_m", "_l", "_from", "_high")
    )


def value_ladder(df: DataFrame, value: str, *, key: Sequence[str] = ("symbol",), slices: int = 64) -> DataFrame:
    """Distinct values per key with their count ``n`` and how many rows are at or below them (``upto``).

    Equal values are merged before the ordering, and the ordering is cut into ``slices`` per standard
    deviation of the key, so neither a hot key nor a hot value lands in one task. ``size`` is the key's row
    count.
    """
    k = list(key)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*k, value).agg(F.count(F.lit(1)).alias("n"))
    v, n = F.col(value), F.col("n")
    mean = F.sum(v * n) / F.sum("n")
    spread = counts.groupBy(*k).agg(mean.alias("_m"), F.sqrt(F.greatest(F.lit(0.0), F.sum(v * v * n) / F.sum("n") - mean * mean)).alias("_sd"))
    at = F.when(F.col("_sd") > 0, F.floor((v - F.col("_m")) / F.col("_sd") * slices)).otherwise(F.lit(0))
    sliced = counts.join(spread, k).withColumn("_slice", at).drop("_m", "_sd")
    whole = Window.partitionBy(*k)
    before = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = sliced.groupBy(*k, "_slice").agg(F.sum("n").alias("_n")).select(
        *k, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("size"))
    inside = Window.partitionBy(*k, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ladder = sliced.withColumn("_upto", F.sum("n").over(inside)).join(totals, [*k, "_slice"])
    return ladder.select(*k, value, "n", (F.col("_before") + F.col("_upto")).alias("upto"), "size")


def nth(value: str, index: Column) -> Column:
    """Aggregate over a ladder: the value at 0-based ``index`` of the sorted rows."""
    return F.min(F.when(F.col("upto") > index, F.col(value)))


def lowest_mean(value: str, count: Column) -> Column:
    """Aggregate over a ladder: mean of the ``count`` smallest rows."""
    taken = F.least(F.col("n"), F.greatest(F.lit(0), count - (F.col("upto") - F.col("n"))))
    return F.sum(F.col(value) * taken) / F.max(count)
