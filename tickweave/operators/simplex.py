"""Best weights of a grid that is too large to list: branch and bound over cells of the simplex.

A grid of ``units`` parts over k symbols has C(units+k-1, k-1) weight vectors. ``grid.scored`` lists them, which is for a few symbols;
``search`` finds the best by an objective for real universes. A cell is a range of parts for each symbol. For each cell there
is a proven upper bound of the score of all vectors in it:

* minimal variance and utility (mean less a multiple of variance) are concave scores: the tangent plane at any point of the cell
  lies above them, and its largest value over the cell is a sort of the gradient;
* a ratio n.w / volatility (Sharpe, diversification) beats the best value t so far only where n.w - t * volatility, which is
  concave too, is positive; what its tangent plane leaves, over the least volatility of the cell, bounds the ratio;
* the risk imbalance is bounded by ranges of the marginal risks and of the variance.

Cells that can't beat the best vector found so far are dropped, others are cut in two. Each level is one job: every cell is
refined in its task by at most ``nodes`` cuts, best bound first, and the cells that are left are pruned against the best vector
of all tasks and go to the next level. A level has at most ``max_cells`` cells for each key and objective; the bounds of cells beyond that, or left
after ``levels`` levels, are not lost: ``bound`` is the largest of them, and ``gap`` = bound - score says how far from the
optimum the answer can be at most. With gap 0 it is the optimum of the whole grid (up to rounding of 1e-12; ties are not ordered).
In any case no move of one part from one symbol to another is better.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir
from .grid import OBJECTIVES, universe

MEASURES = ("expected_return", "volatility", "sharpe", "diversification", "risk_imbalance")
FOUND = ("_u string, objective string, kind string, score double, lo array<int>, hi array<int>, "
         + ", ".join(f"{m} double" for m in MEASURES))


class Problem:
    """One universe and objective; scores are to be large. Weights are counted in parts."""

    def __init__(self, mu: np.ndarray, cov: np.ndarray, units: int, objective: str, risk_free: float, groups: list[tuple[np.ndarray, float]]):
        self.mu, self.cov, self.units, self.rf, self.groups = mu, cov, units, risk_free, groups
        self.sd, self.k = np.sqrt(np.maximum(0.0, np.diag(cov))), len(mu)
        self.kind, _, extra = objective.partition(":")
        self.aversion = float(extra) if extra else 0.0
        self.column, self.sign = OBJECTIVES.get(objective, ("utility", 1))

    def measures(self, parts: np.ndarray) -> dict[str, np.ndarray]:
        """The measures of weight vectors (rows of parts)."""
        w = parts / self.units
        s = w @ self.cov
        variance, mean, own = (w * s).sum(axis=1), w @ self.mu, w @ self.sd
        vol = np.sqrt(np.maximum(0.0, variance))
        live = vol > 1e-10
        safe = np.where(live, vol, 1.0)
        part = np.abs(w * s / np.where(live, variance, 1.0)[:, None] - 1.0 / self.k).max(axis=1)
        return {"expected_return": mean, "volatility": vol, "variance": variance, "sharpe": np.where(live, (mean - self.rf) / safe, 0.0),
                "diversification": np.where(live, own / safe, 0.0), "risk_imbalance": np.where(live, part, 1.0), "utility": mean - self.aversion * variance}

    def scores(self, parts: np.ndarray) -> np.ndarray:
        return self.sign * self.measures(parts)[self.column]

    def allowed(self, parts: np.ndarray) -> np.ndarray:
        ok = np.ones(len(parts), bool)
        for member, most in self.groups:
            ok &= parts @ member <= most * self.units + 1e-9
        return ok

    def least(self, g: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least g.w over the cell for each row of g, by filling the cheapest symbols first."""
        g = np.atleast_2d(g)
        order = np.argsort(g, axis=1)
        room = (hi - lo)[order]
        fill = np.clip(self.units - lo.sum() - (np.cumsum(room, axis=1) - room), 0, room)
        return (g @ lo + (np.take_along_axis(g, order, 1) * fill).sum(axis=1)) / self.units

    def descend(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray, slope, steps: int = 80) -> np.ndarray:
        """A point of the cell (not of the grid) with a low convex function; slope(w) gives its gradient and curvature."""
        w, low, high = x / self.units, lo / self.units, hi / self.units
        for _ in range(steps):
            g, q = slope(w)
            i = int(np.argmin(np.where(w < high - 1e-12, g, np.inf)))
            j = int(np.argmax(np.where(w > low + 1e-12, g, -np.inf)))
            room, fall = min(high[i] - w[i], w[j] - low[j]), g[j] - g[i]
            if not (fall > 1e-12 and room > 0):
                break
            bend = q * (self.cov[i, i] + self.cov[j, j] - 2 * self.cov[i, j])
            step = min(room, fall / bend) if bend > 1e-300 else room
            w[i] += step
            w[j] -= step
        return w

    def _sloped(self, scale: float, linear: np.ndarray):
        """Of scale * variance - linear.w."""
        return lambda w: (2 * scale * (self.cov @ w) - linear, 2 * scale)

    def _rooted(self, t: float, linear: np.ndarray):
        """Of t * volatility - linear.w."""
        def slope(w):
            s = self.cov @ w
            vol = np.sqrt(max(1e-300, w @ s))
            return t * s / vol - linear, t / vol

        return slope

    def tangent(self, w: np.ndarray, value: float, g: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> float:
        """A lower bound of a convex function over the cell from its value and gradient at w."""
        return float(value + self.least(g, lo, hi)[0] - g @ w)

    def bound(self, lo: np.ndarray, hi: np.ndarray, start: np.ndarray, best: float) -> tuple[float, np.ndarray]:
        """An upper bound of the scores in the cell, and a point of the cell (in parts) where they are high."""
        zero = np.zeros(self.k)
        if self.kind in ("min_variance", "utility"):
            linear, scale = (self.mu, self.aversion) if self.kind == "utility" else (zero, 1.0)
            slope = self._sloped(scale, linear)
            w = self.descend(start, lo, hi, slope)
            return -self.tangent(w, scale * (w @ self.cov @ w) - linear @ w, slope(w)[0], lo, hi), w * self.units
        slope = self._sloped(1.0, zero)
        w = self.descend(start, lo, hi, slope, 40)
        calm = max(0.0, self.tangent(w, w @ self.cov @ w, slope(w)[0], lo, hi))
        if self.kind == "risk_parity":
            return self._imbalance(lo, hi, calm), w * self.units
        linear, rest = (self.mu, self.rf) if self.kind == "max_sharpe" else (self.sd, 0.0)
        top = -float(self.least(-linear, lo, hi)[0]) - rest
        if calm <= 1e-20:
            return np.inf, w * self.units
        if best < 0:
            # volatility is at most the weighted mean of volatilities
            most = -float(self.least(-self.sd, lo, hi)[0])
            return (top / np.sqrt(calm) if top >= 0 else top / most), w * self.units
        slope = self._rooted(best, linear)
        w = self.descend(w * self.units, lo, hi, slope)
        left = -self.tangent(w, best * np.sqrt(max(0.0, w @ self.cov @ w)) - linear @ w, slope(w)[0], lo, hi) - rest
        return best + (left / np.sqrt(calm) if left > 0 else left / max(1e-300, -float(self.least(-self.sd, lo, hi)[0]))), w * self.units

    def _imbalance(self, lo: np.ndarray, hi: np.ndarray, calm: float) -> float:
        low, high = self.least(self.cov, lo, hi), -self.least(-self.cov, lo, hi)
        wild, calm = -float(self.least(-high, lo, hi)[0]), max(calm, float(self.least(low, lo, hi)[0]))
        if calm <= 1e-20 or wild <= 0:
            return 0.0
        a, b = lo / self.units, hi / self.units
        least, most = np.minimum(a * low, b * low), np.maximum(a * high, b * high)
        share_low, share_high = least / np.where(least < 0, calm, wild), most / np.where(most > 0, calm, wild)
        return -min(1.0, float(np.maximum(0.0, np.maximum(share_low - 1 / self.k, 1 / self.k - share_high)).max()))

    def rounded(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        parts = np.clip(np.floor(x + 1e-9).astype(int), lo, hi)
        short = self.units - parts.sum()
        for i in np.argsort(parts - x if short > 0 else x - parts, kind="stable"):
            if short == 0:
                break
            step = int(np.clip(short, lo[i] - parts[i], hi[i] - parts[i]) if abs(short) > self.k else np.clip(np.sign(short), lo[i] - parts[i], hi[i] - parts[i]))
            parts[i] += step
            short -= step
        for i in range(self.k):
            step = int(np.clip(short, lo[i] - parts[i], hi[i] - parts[i]))
            parts[i] += step
            short -= step
        return parts

    def climb(self, parts: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[float, np.ndarray]:
        """Moves of one part from one symbol to another while one is better."""
        best = float(self.scores(parts[None])[0])
        i, j = np.nonzero(~np.eye(self.k, dtype=bool))
        while True:
            use = np.flatnonzero((parts[i] < hi[i]) & (parts[j] > lo[j]))
            near = np.repeat(parts[None], len(use), axis=0)
            near[np.arange(len(use)), i[use]] += 1
            near[np.arange(len(use)), j[use]] -= 1
            near = near[self.allowed(near)]
            if not len(near):
                return best, parts
            s = self.scores(near)
            top = int(np.argmax(s))
            if s[top] <= best + 1e-15 * max(1.0, abs(best)):
                return best, parts
            best, parts = float(s[top]), near[top]

    def tight(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """The cell without parts that no vector of it can have; None if it is empty."""
        for member, most in self.groups:
            if lo @ member > most * self.units + 1e-9:
                return None
        lo, hi = np.maximum(lo, hi - (hi.sum() - self.units)), np.minimum(hi, lo + (self.units - lo.sum()))
        return None if (lo > hi).any() or lo.sum() > self.units or hi.sum() < self.units else (lo, hi)


def worse(bound: float, best: float) -> bool:
    return bound <= best + 1e-12 * max(1.0, abs(best))


def refine(p: Problem, lo: np.ndarray, hi: np.ndarray, best: float, root: tuple[np.ndarray, np.ndarray], nodes: int) -> tuple[float, np.ndarray | None, list]:
    """The best vector found in the cell if it beats ``best``, and the cells that are left after ``nodes`` cuts as (bound, lo, hi)."""
    found: np.ndarray | None = None
    heap: list = []

    def tried(parts: np.ndarray) -> None:
        nonlocal best, found
        if p.allowed(parts[None])[0]:
            score = float(p.scores(parts[None])[0])
            if score > best or found is None and score >= best:
                best, found = p.climb(parts, *root)

    def opened(lo: np.ndarray, hi: np.ndarray, start: np.ndarray) -> None:
        if (cell := p.tight(lo, hi)) is None:
            return
        lo, hi = cell
        if (lo == hi).all():
            tried(lo)
            return
        start = np.clip(start, lo, hi).astype(float)
        start += (hi - start) * (p.units - start.sum()) / max(1e-300, (hi - start).sum()) if start.sum() < p.units else \
            (lo - start) * (start.sum() - p.units) / max(1e-300, (start - lo).sum())
        bound, x = p.bound(lo, hi, start, best if np.isfinite(best) else -1.0)
        tried(p.rounded(x, lo, hi))
        if not worse(bound, best):
            heapq.heappush(heap, (-bound, len(heap) + nodes * 1000, lo.tolist(), hi.tolist(), x.tolist()))

    opened(lo, hi, (lo + hi) / 2)
    count = 0
    while heap and count < nodes:
        bound, _, low, high, x = heapq.heappop(heap)
        if worse(-bound, best):
            break
        low, high, x = np.array(low), np.array(high), np.array(x)
        count += 1
        split = np.abs(x - np.round(x)) * (high > low)
        i = int(np.argmax(split if p.kind != "risk_parity" and split.max() > 1e-6 else high - low))
        at = int(np.clip(np.floor(x[i]) if split[i] > 1e-6 and p.kind != "risk_parity" else (low[i] + high[i]) // 2, low[i], high[i] - 1))
        upper, lower = high.copy(), low.copy()
        upper[i], lower[i] = at, at + 1
        opened(low, upper, x)
        opened(lower, high, x)
    return best, found, [(-b, lo, hi) for b, _, lo, hi, _ in heap if not worse(-b, best)]


def limits(symbols: list[str], units: int, lower: dict[str, float], upper: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    lo = np.array([int(np.ceil(lower.get(s, 0.0) * units - 1e-9)) for s in symbols])
    hi = np.array([min(units, int(np.floor(upper.get(s, 1.0) * units + 1e-9))) for s in symbols])
    return lo, hi


def search(universes: DataFrame, units: int, objectives: list[str] | None = None, key: list[str] | None = None, lower: dict[str, float] | None = None,
           upper: dict[str, float] | None = None, groups: list[tuple[list[str], float]] | None = None, risk_free: float = 0.05,
           nodes: int = 64, max_cells: int = 2048, levels: int = 12) -> DataFrame:
    """The best vector per key and objective: objective, candidate, parts, symbols, the measures, score, bound, gap.

    objectives: those of ``grid.best``, or ``utility:g`` for mean - g * variance. lower, upper: bounds of a symbol's weight; groups: (symbols,
    largest total). A key whose bounds no vector meets has no row for them. universes: one row per key, as ``grid.universe`` makes them.
    """
    spark, key = universes.sparkSession, key or []
    names = objectives or list(OBJECTIVES)
    for n in names:
        if n not in OBJECTIVES and not n.startswith("utility:"):
            raise ValueError(f"unknown objective {n!r}; known: {', '.join(OBJECTIVES)}, utility:g")
    lower, upper, groups = lower or {}, upper or {}, groups or []
    tag = F.to_json(F.struct(*key)) if key else F.lit("-")
    named = universes.select(*key, tag.alias("_u"), "symbols", "mu", "cov")
    facts = named.select("_u", "symbols", "mu", "cov")

    def level(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                symbols = list(r.symbols)
                member = [(np.isin(symbols, list(m)).astype(float), most) for m, most in groups]
                p = Problem(np.array(r.mu, float), np.array([list(c) for c in r.cov], float), units, r.objective, risk_free, member)
                root = limits(symbols, units, lower, upper)
                lo, hi = (np.array(x, int) for x in ((r.lo, r.hi) if r.lo is not None else root))
                best = -np.inf if r.best is None or np.isnan(r.best) else r.best
                score, parts, left = refine(p, lo, hi, best, root, nodes)
                if parts is not None:
                    m = p.measures(parts[None])
                    rows.append((r.tag, r.objective, "point", score, parts.tolist(), None, *(float(m[c][0]) for c in MEASURES)))
                rows += [(r.tag, r.objective, "cell", float(b), lo, hi, *[None] * len(MEASURES)) for b, lo, hi in left]
            if rows:
                yield pd.DataFrame(rows, columns=["_u", "objective", "kind", "score", "lo", "hi", *MEASURES])

    cells = facts.select("_u", F.explode(F.array(*[F.lit(n) for n in names])).alias("objective")).withColumns(
        {"lo": F.lit(None).cast("array<int>"), "hi": F.lit(None).cast("array<int>"), "best": F.lit(None).cast("double")})
    points, dropped = None, None
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for depth in range(levels):
        work = cells.repartition(width).join(facts, "_u").select(F.col("_u").alias("tag"), "objective", "lo", "hi", "best", "symbols", "mu", "cov")
        path = shared_dir(spark, f"simplex-{depth}")
        work.mapInPandas(level, FOUND).write.parquet(path)
        found = spark.read.schema(FOUND).parquet(path)
        here = found.where("kind = 'point'")
        points = here if points is None else points.unionByName(here)
        best = points.groupBy("_u", "objective").agg(F.max("score").alias("best"))
        left = found.where("kind = 'cell'").join(best, ["_u", "objective"], "left")
        left = left.where(F.col("best").isNull() | (F.col("score") > F.col("best") + 1e-12 * F.greatest(F.lit(1.0), F.abs("best"))))
        rank = F.row_number().over(Window.partitionBy("_u", "objective").orderBy(F.desc("score"), "lo", "hi"))
        ranked = left.withColumn("_rank", F.when(F.lit(depth + 1 < levels), rank).otherwise(F.lit(max_cells + 1)))
        over = ranked.where(F.col("_rank") > max_cells).select("_u", "objective", "score")
        dropped = over if dropped is None else dropped.unionByName(over)
        cells = ranked.where(F.col("_rank") <= max_cells).select("_u", "objective", "lo", "hi", "best")
        if cells.isEmpty():
            break
    top = points.groupBy("_u", "objective").agg(F.max_by(F.struct("score", F.col("lo").alias("parts"), *MEASURES), F.struct("score", "lo")).alias("b"))
    most = dropped.groupBy("_u", "objective").agg(F.max("score").alias("_open"))
    d = named.select(*key, "_u", "symbols").join(top, "_u").join(most, ["_u", "objective"], "left")
    bound = F.greatest(F.col("b.score"), F.coalesce("_open", F.col("b.score")))
    return d.select(*key, "objective", F.concat_ws("-", "b.parts").alias("candidate"), F.col("b.parts").alias("parts"), "symbols",
                    *(F.col(f"b.{m}").alias(m) for m in MEASURES), F.col("b.score").alias("score"), bound.alias("bound"), (bound - F.col("b.score")).alias("gap"))


def efficient(universes: DataFrame, units: int, aversions: list[float], **options) -> DataFrame:
    """Points of the efficient frontier of a large universe: the best vector for each risk aversion, by rising return."""
    found = search(universes, units, [f"utility:{a:g}" for a in aversions], **options)
    return found.withColumn("aversion", F.split_part("objective", F.lit(":"), F.lit(2)).cast("double"))


def search_weights(mu: DataFrame, cov: DataFrame, units: int, objectives: list[str], **options) -> DataFrame:
    """As ``walkforward.grid_weights``, for universes whose grid is not listed: window_id, strategy, symbol, weight."""
    chosen = search(universe(mu, cov, ["window_id"]), units, objectives, ["window_id"], **options)
    z = F.explode(F.arrays_zip("symbols", "parts")).alias("_z")
    return chosen.select("window_id", F.col("objective").alias("strategy"), z).select(
        "window_id", "strategy", F.col("_z.symbols").alias("symbol"), (F.col("_z.parts") / units).alias("weight"))
