"""Scoring of all long-only weight vectors on a grid, and the choice of the best by an objective.

A universe row carries the means and the covariance matrix of its k symbols as arrays. k is the size of the universe, and
a universe of another size is an error; ``units`` is the step of the grid. The number of candidates is C(units+k-1, k-1),
so a grid is for universes of a few symbols: choose fewer units for more. Candidates are made by one explode per symbol and are
scored by plain arithmetic inside the row, so scoring needs no join and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def universe(mu: DataFrame, cov: DataFrame, key: list[str] | None = None) -> DataFrame:
    """One row per key: symbols, means, volatilities and the covariance matrix, ordered by symbol."""
    k = key or []
    rows = cov.groupBy(*k, "symbol_row").agg(F.array_sort(F.collect_list(F.struct("symbol_col", "value"))).alias("_r"))
    rows = rows.select(*k, F.col("symbol_row").alias("symbol"), F.transform("_r", lambda x: x["value"]).alias("_c"))
    d = mu.join(rows, [*k, "symbol"]).groupBy(*k).agg(F.array_sort(F.collect_list(F.struct("symbol", "mean_return", "_c"))).alias("_u"))
    return d.select(
        *k, F.transform("_u", lambda x: x["symbol"]).alias("symbols"), F.transform("_u", lambda x: x["mean_return"]).alias("mu"),
        F.transform("_u", lambda x: x["_c"]).alias("cov"))


def candidates(universes: DataFrame, k: int, units: int) -> DataFrame:
    """Every split of ``units`` equal parts over the k symbols, one row each with ``parts``; a universe of another size raises."""
    wrong = F.concat(F.lit("the universe has "), F.size("symbols").cast("string"), F.lit(f" symbols, the grid {k}"))
    d = universes.withColumn("_left", F.when(F.size("symbols") == k, F.lit(units)).otherwise(F.raise_error(wrong)))
    for i in range(k - 1):
        d = d.withColumn(f"_u{i}", F.explode(F.sequence(F.lit(0), F.col("_left")))).withColumn("_left", F.col("_left") - F.col(f"_u{i}"))
        if i == 1:
            d = d.repartition(*[c for c in universes.columns if c not in ("symbols", "mu", "cov")], "_u0", "_u1")
    return d.withColumn("parts", F.array(*[f"_u{i}" for i in range(k - 1)], "_left")).drop("_left", *[f"_u{i}" for i in range(k - 1)])


def scored(cands: DataFrame, k: int, units: int, risk_free: float = 0.05) -> DataFrame:
    """Return, volatility, Sharpe ratio, diversification ratio and risk imbalance of each candidate."""
    w = [F.get("parts", F.lit(i)) / units for i in range(k)]

    def c(i: int, j: int) -> Column:
        return F.get(F.get("cov", F.lit(i)), F.lit(j))

    d = cands.select("*", *[sum((w[j] * c(i, j) for j in range(1, k)), w[0] * c(i, 0)).alias(f"_s{i}") for i in range(k)])
    d = d.withColumn("expected_return", sum((w[i] * F.get("mu", F.lit(i)) for i in range(1, k)), w[0] * F.get("mu", F.lit(0))))
    d = d.withColumn("variance", sum((w[i] * F.col(f"_s{i}") for i in range(1, k)), w[0] * F.col("_s0")))
    d = d.withColumn("volatility", F.sqrt(F.greatest(F.lit(0.0), F.col("variance"))))
    own = sum((w[i] * F.sqrt(c(i, i)) for i in range(1, k)), w[0] * F.sqrt(c(0, 0)))
    live = F.col("volatility") > 1e-10
    gaps = [F.abs(w[i] * F.col(f"_s{i}") / F.col("variance") - 1.0 / k) for i in range(k)]
    d = d.select(
        "*", F.when(live, (F.col("expected_return") - risk_free) / F.col("volatility")).otherwise(0.0).alias("sharpe"),
        F.when(live, own / F.col("volatility")).otherwise(0.0).alias("diversification"),
        F.when(live, F.greatest(*gaps)).otherwise(1.0).alias("risk_imbalance"), F.concat_ws("-", "parts").alias("candidate"))
    return d.drop(*[f"_s{i}" for i in range(k)])


# objective name -> (score column, +1 to take the highest or -1 the lowest)
OBJECTIVES = {
    "max_sharpe": ("sharpe", 1), "min_variance": ("variance", -1), "max_diversification": ("diversification", 1),
    "risk_parity": ("risk_imbalance", -1),
}


def best(grid: DataFrame, key: list[str] | None = None, objectives: list[str] | None = None) -> DataFrame:
    """The best candidate per objective, ties by candidate name; all objectives in one aggregation."""
    k = key or []
    names = objectives or list(OBJECTIVES)
    unknown = [n for n in names if n not in OBJECTIVES]
    if unknown:
        raise ValueError(f"unknown objective {unknown[0]!r}; known: {', '.join(OBJECTIVES)}")
    row = F.struct("candidate", "parts", "symbols", "expected_return", "volatility", "sharpe", "diversification", "risk_imbalance")
    picks = []
    for n in names:
        column, sign = OBJECTIVES[n]
        picks.append(F.max_by(row, F.struct(F.col(column) * sign, F.col("candidate"))).alias(n))
    d = grid.groupBy(*k).agg(*picks)
    rows = F.array(*[F.struct(F.lit(n).alias("objective"), F.col(n).alias("b")) for n in names])
    return d.select(*k, F.explode(rows).alias("_x")).select(*k, "_x.objective", "_x.b.*")


def weights_of(chosen: DataFrame, units: int, key: list[str]) -> DataFrame:
    """Weights as rows."""
    z = F.explode(F.arrays_zip("symbols", "parts"))
    return chosen.select(*key, z.alias("_z")).select(*key, F.col("_z.symbols").alias("symbol"), (F.col("_z.parts") / units).alias("weight"))


def feasible(symbols: DataFrame, lower: dict[str, float], upper: dict[str, float]) -> DataFrame:
    lo = F.coalesce(F.create_map(*[F.lit(x) for kv in lower.items() for x in kv])[F.col("symbol")], F.lit(0.0)) if lower else F.lit(0.0)
    hi = F.coalesce(F.create_map(*[F.lit(x) for kv in upper.items() for x in kv])[F.col("symbol")], F.lit(1.0)) if upper else F.lit(1.0)
    d = symbols.select("symbol", lo.alias("lo"), hi.alias("hi")).agg(F.sum("lo").alias("min_total"), F.sum("hi").alias("max_total"))
    return d.withColumn("is_feasible", (F.col("min_total") <= 1 + 1e-6) & (F.col("max_total") >= 1 - 1e-6))


def constrained(grid: DataFrame, units: int, lower: dict[str, float], upper: dict[str, float], groups: list[tuple[list[str], float]]) -> DataFrame:
    """Candidates within per-symbol bounds and group maxima."""
    named = F.map_from_arrays("symbols", "parts")

    def w(s: str) -> Column:
        return F.coalesce(F.element_at(named, F.lit(s)), F.lit(0)) / units

    ok = F.lit(True)
    for s, v in lower.items():
        ok = ok & (w(s) >= v - 1e-9)
    for s, v in upper.items():
        ok = ok & (w(s) <= v + 1e-9)
    for members, v in groups:
        ok = ok & (sum((w(s) for s in members), F.lit(0.0)) <= v + 1e-9)
    return grid.filter(ok)


def active_bounds(weights: DataFrame, lower: dict[str, float], upper: dict[str, float]) -> DataFrame:
    at = F.lit(None).cast("string")
    for bound, table in (("lower", lower), ("upper", upper)):
        for s, v in table.items():
            at = F.when((F.col("symbol") == s) & (F.abs(F.col("weight") - v) < 1e-9), bound).otherwise(at)
    return weights.withColumn("active_bound", at)


def checked(symbols: DataFrame, lower: dict[str, float], upper: dict[str, float]) -> DataFrame:
    """As ``feasible``, but bounds that no weights of sum 1 meet raise."""
    text = F.concat(F.lit("infeasible bounds: least total "), F.col("min_total").cast("string"), F.lit(", largest "), F.col("max_total").cast("string"))
    return feasible(symbols, lower, upper).withColumn("is_feasible", F.when(F.col("is_feasible"), True).otherwise(F.raise_error(text)))


def frontier(grid: DataFrame, buckets: int = 20, risk_free: float = 0.05) -> DataFrame:
    """Least volatility per return bucket, the single assets, the two optima and two points of the capital-market line.

    The line starts at the risk-free return, touches the best Sharpe ratio and ends at 1.2 times the curve's largest volatility.
    """
    lo, hi = (grid.agg(f("expected_return")).scalar() for f in (F.min, F.max))
    at = F.when(hi > lo, F.least(F.floor((F.col("expected_return") - lo) / (hi - lo) * buckets), F.lit(buckets - 1))).otherwise(0)
    point = F.struct("candidate", "expected_return", "volatility")
    curve = grid.withColumn("bucket", at).groupBy("bucket").agg(F.min_by(point, F.struct("volatility", "candidate")).alias("p")).select(
        F.lit("frontier").alias("kind"), F.col("bucket").cast("string").alias("name"), "p.*")
    single = grid.filter(F.array_max("parts") == F.aggregate("parts", F.lit(0), lambda a, x: a + x))
    assets = single.select(F.lit("asset").alias("kind"), F.element_at("symbols", F.array_position("parts", F.array_max("parts")).cast("int")).alias("name"),
                           "candidate", "expected_return", "volatility")
    optima = best(grid, objectives=["max_sharpe", "min_variance"]).select(
        F.lit("optimum").alias("kind"), F.col("objective").alias("name"), "candidate", "expected_return", "volatility")
    top = optima.filter("name = 'max_sharpe'").select("candidate", ((F.col("expected_return") - risk_free) / F.col("volatility")).alias("slope"))
    reach = curve.agg((F.max("volatility") * 1.2).alias("far"))
    ends = F.explode(F.array(F.struct(F.lit("start").alias("name"), F.lit(0.0).alias("x")), F.struct(F.lit("end").alias("name"), reach.scalar().alias("x"))))
    line = top.select("candidate", "slope", ends.alias("e")).select(
        F.lit("capital_line").alias("kind"), "e.name", "candidate", (risk_free + F.col("slope") * F.col("e.x")).alias("expected_return"),
        F.col("e.x").alias("volatility"))
    return curve.unionByName(assets).unionByName(optima).unionByName(line)
