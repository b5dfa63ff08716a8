"""Centred co-moments that can be merged: of pairs in panes of dates, and of tiles of symbols.

A state holds n, the two means, and the sums of squares and products about them. States of parts give that of the whole without the
cancellation of plain sums, so prices of 1e9 with small noise keep their covariance. A window is a merge of panes, so rows are
not copied into windows; a matrix of many symbols is a set of tiles, so a date is not joined with itself symbol by symbol.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATE = ("n", "ma", "mb", "caa", "cbb", "cab")


def state(a: str, b: str) -> list[Column]:
    """Aggregates of two columns of numbers; rows with a null in either are to be left out."""
    n = F.count(F.lit(1))
    return [n.alias("n"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), (F.var_pop(a) * n).alias("caa"), (F.var_pop(b) * n).alias("cbb"), (F.covar_pop(a, b) * n).alias("cab")]


def merged(states: DataFrame, by: list[str]) -> DataFrame:
    """One state for each key; a key has as many states as the panes or blocks it is made of."""
    d = states.groupBy(*by).agg(F.collect_list(F.struct(*STATE)).alias("_s"))

    def total(f) -> Column:
        return F.aggregate("_s", F.lit(0.0), lambda t, x: t + f(x))

    first = F.element_at("_s", 1)
    d = d.withColumn("n", F.aggregate("_s", F.lit(0).cast("long"), lambda t, x: t + x["n"]))
    # means as differences from the first one
    d = d.withColumns({m: first[m] + total(lambda x, m=m: x["n"] * (x[m] - first[m])) / F.col("n") for m in ("ma", "mb")})
    both = {"caa": ("ma", "ma"), "cbb": ("mb", "mb"), "cab": ("ma", "mb")}
    return d.select(*by, "n", "ma", "mb", *(
        total(lambda x, c=c, p=p, q=q: x[c] + x["n"] * (x[p] - F.col(p)) * (x[q] - F.col(q))).alias(c) for c, (p, q) in both.items()))


def in_windows(dates: DataFrame, train: int, test: int, count: Column) -> tuple[Column, Column]:
    """Panes of the position ``pos``, and the training windows of a pane ``_pane``: (pane, array of windows).

    Window k has the positions after k * test + 1 up to k * test + train: its first date is left out. Panes end where a window begins or ends
    and hold the first date by itself, so a window is a set of panes.
    """
    rest, whole = train % test, train // test
    step, off = F.floor((F.col("pos") - 1) / test), (F.col("pos") - 1) % test
    part = F.when(off == 0, 0).when((off < rest) | F.lit(rest == 0), 1).otherwise(2)
    at, kind = F.floor(F.col("_pane") / 3), F.col("_pane") % 3
    first = F.when(F.lit(rest > 0) & (kind <= 1), at - whole).otherwise(at - whole + 1)
    last = F.when(kind >= 1, at).otherwise(at - 1)
    first, last = F.greatest(F.lit(0), first), F.least(count - 1, last)
    return (step * 3 + part).cast("long"), F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def numbered(names: DataFrame, tile: int) -> DataFrame:
    """symbol, tile, slot. One row for each symbol is numbered in one task."""
    at = F.row_number().over(Window.orderBy("symbol")) - 1
    return names.select("symbol").distinct().select("symbol", F.floor(at / tile).cast("int").alias("tile"), (at % tile).cast("int").alias("slot"))


def tile_pairs(rows: DataFrame, value: str, names: DataFrame, block: Column) -> DataFrame:
    """The values of each date and tile as one row, sent to every pair of tiles (row <= column) it is part of: block, row, col, mine, ts, pos, slots, xs.

    A date gives tiles * tiles rows, where a join by date gives symbols * symbols.
    """
    tiles = names.agg(F.max("tile")).first()[0] or 0
    packed = rows.where(F.col(value).isNotNull()).join(names, "symbol").withColumn("block", F.explode(block)).groupBy("block", "tile", "ts", "pos").agg(
        F.collect_list(F.struct("slot", F.col(value).cast("double").alias("x"))).alias("v"))
    other = F.explode(F.sequence(F.lit(0), F.lit(tiles))).alias("other")
    d = packed.select("block", "tile", "ts", "pos", F.col("v.slot").alias("slots"), F.col("v.x").alias("xs"), other)
    return d.select("block", F.least("tile", "other").alias("row"), F.greatest("tile", "other").alias("col"), F.col("tile").alias("mine"), "ts", "pos", "slots", "xs")


def dense(table: pa.Table, tile: int, positions: np.ndarray, size: int) -> np.ndarray:
    """dates x slots of one tile's rows, NaN where a symbol has no value."""
    out = np.full((len(positions), size), np.nan)
    t = table.filter(pa.compute.equal(table["mine"], tile))
    slots, xs = t["slots"].combine_chunks(), t["xs"].combine_chunks()
    row = np.repeat(np.searchsorted(positions, t["pos"].to_numpy()), np.diff(slots.offsets.to_numpy()))
    out[row, slots.flatten().to_numpy()] = xs.flatten().to_numpy()
    return out


def pair_states(rows: DataFrame, value: str = "r", tile: int = 64, block: int = 4096) -> DataFrame:
    """symbol_row <= symbol_col with their state on the dates both have. rows: symbol, ts, pos (the date's number), value."""
    names = numbered(rows, tile).persist()

    def fold(key, table):
        positions = np.unique(table["pos"].to_numpy())
        a, b = (dense(table, key[k].as_py(), positions, tile) for k in (1, 2))
        has_a, has_b = ~np.isnan(a), ~np.isnan(b)
        # values about the tile's means: what is summed is small, and the sums are corrected to each pair's own means
        shift_a, shift_b = (np.where(h.any(axis=0), np.nansum(x, axis=0) / np.maximum(1, h.sum(axis=0)), 0.0) for x, h in ((a, has_a), (b, has_b)))
        a, b = np.where(has_a, a - shift_a, 0.0), np.where(has_b, b - shift_b, 0.0)
        p, q = has_a.astype(float), has_b.astype(float)
        n = p.T @ q
        i, j = np.nonzero(n > 0)
        if key[1].as_py() == key[2].as_py():
            i, j = i[i <= j], j[i <= j]
        n = n[i, j]
        sa, sb = (a.T @ q)[i, j], (p.T @ b)[i, j]
        both = [((a * a).T @ q)[i, j] - sa * sa / n, (p.T @ (b * b))[i, j] - sb * sb / n, (a.T @ b)[i, j] - sa * sb / n]
        return pa.table({"a": i + key[1].as_py() * tile, "b": j + key[2].as_py() * tile, "n": n.astype(np.int64), "ma": shift_a[i] + sa / n, "mb": shift_b[j] + sb / n,
                         "caa": both[0], "cbb": both[1], "cab": both[2]})

    d = tile_pairs(rows, value, names, F.array(F.floor((F.col("pos") - 1) / block))).groupBy("block", "row", "col").applyInArrow(
        fold, "a long, b long, n long, ma double, mb double, caa double, cbb double, cab double")
    return named(merged(d, ["a", "b"]), names, tile, "symbol_row", "symbol_col")


def named(d: DataFrame, names: DataFrame, tile: int, row: str, col: str) -> DataFrame:
    number = (F.col("tile") * tile + F.col("slot")).cast("long")
    for at, out in (("a", row), ("b", col)):
        d = d.join(names.select(number.alias(at), F.col("symbol").alias(out)), at)
    return d.drop("a", "b")


def mirrored(upper: DataFrame) -> DataFrame:
    """Both orders of each pair of a symmetric matrix (symbol_row, symbol_col, value)."""
    r, c = F.col("symbol_row"), F.col("symbol_col")
    one, two = F.struct(r.alias("symbol_row"), c.alias("symbol_col")), F.struct(c.alias("symbol_row"), r.alias("symbol_col"))
    return upper.select(F.explode(F.when(r == c, F.array(one)).otherwise(F.array(one, two))).alias("_p"), "value").select("_p.*", "value")


def covariance(rows: DataFrame, periods: int, value: str = "r", **options) -> DataFrame:
    """All sample covariances of many symbols, from tiles; null for pairs with fewer than two common dates."""
    s = pair_states(rows, value, **options)
    return mirrored(s.select("symbol_row", "symbol_col", (F.try_divide("cab", F.when(F.col("n") > 1, F.col("n") - 1)) * periods).alias("value")))


def correlation(rows: DataFrame, value: str = "r", **options) -> DataFrame:
    """Sample correlations of many symbols: diagonal 1, and 0 where a side does not vary."""
    s = pair_states(rows, value, **options)
    c = F.when((F.col("caa") > 0) & (F.col("cbb") > 0), F.col("cab") / F.sqrt(F.col("caa")) / F.sqrt(F.col("cbb"))).otherwise(0.0)
    return mirrored(s.select("symbol_row", "symbol_col", F.when(F.col("symbol_row") == F.col("symbol_col"), 1.0).otherwise(c).alias("value")))


def rolling_correlation(rows: DataFrame, window: int, value: str = "r", tile: int = 32, block: int = 1024) -> DataFrame:
    """symbol_a < symbol_b, ts, correlation over the last ``window`` dates of an aligned panel; null before and where a value is missing.

    Each window is centred by itself. Blocks of dates take the dates before them that their windows reach.
    """
    names = numbered(rows, tile).persist()

    def fold(key, table):
        positions, first = np.unique(table["pos"].to_numpy(), return_index=True)
        times = table["ts"].take(pa.array(first))
        a, b = (dense(table, key[k].as_py(), positions, tile) for k in (1, 2))
        same = key[1].as_py() == key[2].as_py()
        i, j = np.triu_indices(tile, 1) if same else (x.ravel() for x in np.indices((tile, tile)))
        live = ~np.isnan(a).all(axis=0)[i] & ~np.isnan(b).all(axis=0)[j]
        i, j = i[live], j[live]
        own = np.flatnonzero((positions - 1) // block == key[0].as_py())
        out = []
        for lo in range(0, len(own), 64):
            at = own[lo : lo + 64]
            full = at[at >= window - 1]
            c = np.full((len(at), len(i)), np.nan)
            if len(full):
                views = [np.lib.stride_tricks.sliding_window_view(x, window, axis=0)[full - window + 1] for x in (a, b)]
                x, y = (v - v.mean(axis=2, keepdims=True) for v in views)
                cov, vx, vy = x @ y.transpose(0, 2, 1), (x * x).sum(axis=2), (y * y).sum(axis=2)
                flat = np.sqrt(vx[:, i] * vy[:, j])
                c[len(at) - len(full) :] = np.where(np.isnan(flat), np.nan, np.where(flat > 0, cov[:, i, j] / np.where(flat > 0, flat, 1.0), 0.0))
            out.append((at, c))
        at = np.concatenate([o[0] for o in out]) if out else np.zeros(0, int)
        c = np.concatenate([o[1] for o in out]) if out else np.zeros((0, len(i)))
        return pa.table({"a": np.tile(i + key[1].as_py() * tile, len(at)), "b": np.tile(j + key[2].as_py() * tile, len(at)),
                         "ts": times.take(pa.array(np.repeat(at, len(i)))), "correlation": pa.array(c.ravel(), mask=np.isnan(c.ravel()))})

    pos = F.col("pos") - 1
    homes = F.sequence(F.floor(pos / block), F.floor((pos + window - 1) / block))
    kind = dict(rows.dtypes)["ts"]
    d = tile_pairs(rows, value, names, homes).groupBy("block", "row", "col").applyInArrow(fold, f"a long, b long, ts {kind}, correlation double")
    return named(d, names, tile, "symbol_a", "symbol_b")
