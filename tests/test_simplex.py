"""The search of the simplex against listing its vectors."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickweave.operators import grid, simplex
from tickweave.plans import q_search
from tickweave.plans.catalog import QUERIES

OBJECTIVES = ["max_sharpe", "min_variance", "max_diversification", "risk_parity", "utility:3"]


def listed(k, units):
    cuts = (np.array((-1, *c, units + k - 1)) for c in itertools.combinations(range(units + k - 1), k - 1))
    return np.array([np.diff(c) - 1 for c in cuts])


def problem(k, units, objective, seed, shift=0.05, groups=()):
    r = np.random.default_rng(seed)
    a = r.normal(size=(k, k + 3))
    return simplex.Problem(r.normal(shift, 0.1, k), a @ a.T / (k + 3) * 0.05, units, objective, 0.05, list(groups))


@pytest.mark.parametrize("objective", OBJECTIVES)
@pytest.mark.parametrize(("k", "units"), [(1, 7), (2, 9), (5, 10), (5, 20), (7, 6)])
def test_one_task_finds_the_optimum(objective, k, units):
    every = listed(k, units)
    for seed, shift in ((0, 0.05), (1, -0.4)):
        p = problem(k, units, objective, seed, shift)
        root = np.zeros(k, int), np.full(k, units)
        best, found, left = simplex.refine(p, *root, -np.inf, root, 10**6)
        assert not left and best == pytest.approx(p.scores(every).max(), abs=1e-12)
        assert p.scores(found[None])[0] == pytest.approx(best, abs=1e-12)


@pytest.mark.parametrize("objective", OBJECTIVES)
def test_bounds_hold_for_all_vectors_of_a_cell(objective):
    every, r = listed(5, 12), np.random.default_rng(7)
    for seed, shift in ((0, 0.05), (1, -0.4), (2, 0.3)):
        p = problem(5, 12, objective, seed, shift)
        scores = p.scores(every)
        for _ in range(40):
            lo = r.integers(0, 4, 5)
            cell = p.tight(lo, lo + r.integers(0, 7, 5))
            if cell is None:
                continue
            inside = scores[((every >= cell[0]) & (every <= cell[1])).all(axis=1)]
            start = p.rounded((cell[0] + cell[1]) / 2, *cell).astype(float)
            # a ratio's bound is above all scores that beat the best one known
            for best in (scores.max(), np.median(scores)):
                bound, _ = p.bound(*cell, start, best)
                beat = inside[inside > best] if p.kind in ("max_sharpe", "max_diversification") else inside
                assert not len(beat) or bound >= beat.max() - 1e-12


def universes(spark, seeds, k=5):
    rows = []
    for s in seeds:
        p = problem(k, 1, "min_variance", s)
        rows.append((s, [f"s{i}" for i in range(k)], p.mu.tolist(), p.cov.tolist()))
    return spark.createDataFrame(rows, "window_id long, symbols array<string>, mu array<double>, cov array<array<double>>")


def test_jobs_of_few_cells_find_what_the_grid_has(spark):
    """Several levels with one or two cuts a task: cells go from job to job."""
    u = universes(spark, [0, 1, 2])
    want = {(r["window_id"], r["objective"]): r for r in grid.best(grid.scored(grid.candidates(u, 5, 10), 5, 10), ["window_id"]).collect()}
    for options in ({"nodes": 512}, {"nodes": 4, "levels": 40}):
        got = {(r["window_id"], r["objective"]): r for r in simplex.search(u, 10, key=["window_id"], **options).collect()}
        assert got.keys() == want.keys()
        for at, r in got.items():
            column = {"min_variance": "volatility"}.get(at[1], grid.OBJECTIVES[at[1]][0])
            assert r["gap"] == 0 and r[column] == pytest.approx(want[at][column], abs=1e-12)
            # several vectors with a weight of 0 have the imbalance 1 / k
            assert at[1] == "risk_parity" or r["candidate"] == want[at]["candidate"]


def test_the_gap_bounds_what_a_cut_short_search_missed(spark):
    u, every = universes(spark, [3], 6), listed(6, 20)
    for r in simplex.search(u, 20, OBJECTIVES, ["window_id"], nodes=2, max_cells=2, levels=2).collect():
        p = problem(6, 20, r["objective"], 3)
        assert r["score"] - 1e-12 <= p.scores(every).max() <= r["bound"] + 1e-12 and r["gap"] == pytest.approx(r["bound"] - r["score"])


def test_limits_and_groups(spark):
    u, every = universes(spark, [4], 5), listed(5, 10)
    w = every / 10
    ok = (w[:, 0] >= 0.2) & (w[:, 1] <= 0.1) & (w[:, 2] + w[:, 3] <= 0.4 + 1e-9)
    for r in simplex.search(u, 10, OBJECTIVES, ["window_id"], {"s0": 0.15}, {"s1": 0.1, "zz": 0.0}, [(["s2", "s3"], 0.4)], nodes=512).collect():
        p = problem(5, 10, r["objective"], 4)
        assert r["score"] == pytest.approx(p.scores(every[ok]).max(), abs=1e-12) and r["gap"] == 0
    assert simplex.search(u, 10, ["min_variance"], ["window_id"], {"s0": 0.6, "s1": 0.6}).count() == 0
    with pytest.raises(ValueError, match="unknown objective"):
        simplex.search(u, 10, ["nope"])


def test_flat_and_equal_symbols(spark):
    """No variance at all, and symbols that are copies of each other."""
    rows = [(0, ["a", "b"], [0.1, 0.2], [[0.0, 0.0], [0.0, 0.0]]), (1, ["a", "b"], [0.1, 0.1], [[0.04, 0.04], [0.04, 0.04]]), (2, ["a"], [0.1], [[0.04]])]
    u = spark.createDataFrame(rows, "window_id long, symbols array<string>, mu array<double>, cov array<array<double>>")
    got = {(r["window_id"], r["objective"]): r for r in simplex.search(u, 4, key=["window_id"], nodes=64).collect()}
    assert len(got) == 12 and all(r["gap"] < 1e-9 for (w, o), r in got.items() if o == "min_variance")
    assert got[1, "max_sharpe"]["sharpe"] == pytest.approx(0.25) and got[2, "max_sharpe"]["candidate"] == "4"


def test_fine_weights_of_all_nations(spark):
    """No move of one percent is better, the bound holds for random vectors, and most objectives are solved to the end."""
    sf = "/root/testdata/sf0.01"
    u = q_search.whole(spark, sf).first()
    got = QUERIES["j7_search_fine"](spark, sf).collect()
    k, r = len(u["symbols"]), np.random.default_rng(0)
    i, j = np.nonzero(~np.eye(k, dtype=bool))
    assert {g["objective"] for g in got} == set(grid.OBJECTIVES)
    for g in got:
        p = simplex.Problem(np.array(u["mu"]), np.array(u["cov"]), 100, g["objective"], 0.05, [])
        parts = np.array([int(x) for x in g["candidate"].split("-")])
        near = np.repeat(parts[None], len(i), axis=0)
        near[np.arange(len(i)), i] += 1
        near[np.arange(len(i)), j] -= 1
        assert p.scores(near[(near >= 0).all(axis=1)]).max() <= g["score"] + 1e-12
        assert p.scores(r.multinomial(100, np.full(k, 1 / k), 2000)).max() <= g["bound"] + 1e-12
    assert sum(g["gap"] <= 1e-3 * abs(g["score"]) for g in got) >= 3


def test_frontier_returns_rise_as_aversion_falls(spark):
    d = simplex.efficient(universes(spark, [5], 6).drop("window_id"), 20, [0.0, 0.5, 2.0, 8.0, 32.0], nodes=256)
    rows = d.orderBy(F.desc("aversion")).collect()
    assert len(rows) == 5 and all(a["expected_return"] <= b["expected_return"] + 1e-12 and a["volatility"] <= b["volatility"] + 1e-12 for a, b in itertools.pairwise(rows))
