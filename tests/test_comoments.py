"""Co-moments of panes and tiles against numpy."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickweave.operators import comoments, walkforward

DAY = datetime(2024, 1, 1)


def panel(spark, x, names=None):
    """x: dates x symbols, NaN where there is no row."""
    n, k = x.shape
    names = names or [f"s{i:04d}" for i in range(k)]
    rows = [(names[j], DAY + timedelta(days=i), i + 1, float(x[i, j])) for i in range(n) for j in range(k) if not np.isnan(x[i, j])]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, pos int, r double")


def matrix(df, k, row="symbol_row", col="symbol_col", value="value"):
    out = np.full((k, k), np.nan)
    for r in df.collect():
        out[int(r[row][1:]), int(r[col][1:])] = np.nan if r[value] is None else r[value]
    return out


@pytest.mark.parametrize("shift", [0.0, 1e9])
def test_tiles_give_the_matrix(spark, shift):
    x = np.random.default_rng(1).normal(size=(70, 11)) @ np.random.default_rng(2).normal(size=(11, 11)) + shift
    d = panel(spark, x)
    for options in ({"tile": 4, "block": 16}, {"tile": 64}, {"tile": 1, "block": 1000}):
        got = matrix(comoments.covariance(d, 12, **options), 11)
        assert np.allclose(got, np.cov((x - shift).T) * 12, rtol=1e-6 if shift else 1e-12)
    assert np.allclose(matrix(comoments.correlation(d, tile=4, block=16), 11), np.corrcoef((x - shift).T), atol=1e-7)


def test_gaps_and_flat_symbols(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(40, 6))
    x[r.random(x.shape) < 0.3] = np.nan
    x[:, 5], x[:, 4] = np.nan, 7.0
    x[0, 5] = 1.0
    d = panel(spark, x)
    got, corr = matrix(comoments.covariance(d, 1, tile=4, block=7), 6), matrix(comoments.correlation(d, tile=4, block=7), 6)
    for i in range(5):
        for j in range(5):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            want = np.cov(x[both, i], x[both, j])[0, 1]
            assert got[i, j] == pytest.approx(want, abs=1e-12) and (i != 4 or corr[i, j] == (i == j))
    assert np.isnan(got[5, 5])  # one date
    assert comoments.covariance(d.where("r > 99"), 1).count() == 0


def test_two_thousand_symbols(spark):
    """The join by date would make 200 million rows; tiles make fewer than 300 rows a date."""
    x = np.random.default_rng(4).normal(size=(50, 2000))
    d = panel(spark, x)
    names = comoments.numbered(d, 128)
    assert comoments.tile_pairs(d, "r", names, F.array(F.lit(0))).groupBy("ts").count().agg(F.max("count")).first()[0] == 16 * 16
    s = comoments.pair_states(d, tile=128)
    want = np.cov(x.T)
    assert s.count() == 2000 * 2001 // 2
    for r in s.where("pmod(hash(symbol_row, symbol_col), 4001) = 0").collect():
        assert r["cab"] / (r["n"] - 1) == pytest.approx(want[int(r["symbol_row"][1:]), int(r["symbol_col"][1:])], abs=1e-12)


@pytest.mark.parametrize("window", [2, 9, 40])
def test_rolling_correlations(spark, window):
    x = np.cumsum(np.random.default_rng(5).normal(size=(90, 7)), axis=0) + 1e6
    x[:, 3] = 5.0
    got = {(r["symbol_a"], r["symbol_b"], r["ts"]): r["correlation"] for r in comoments.rolling_correlation(panel(spark, x), window, tile=3, block=20).collect()}
    assert len(got) == 21 * 90
    for (a, b, ts), c in got.items():
        i, j, at = int(a[1:]), int(b[1:]), (ts - DAY).days
        if at + 1 < window:
            assert c is None
            continue
        p, q = x[at + 1 - window : at + 1, i], x[at + 1 - window : at + 1, j]
        assert c == pytest.approx(0.0 if 3 in (i, j) else np.corrcoef(p, q)[0, 1], abs=1e-7)


@pytest.mark.parametrize(("train", "test"), [(12, 4), (10, 4), (9, 4), (4, 4), (3, 5), (13, 1)])
def test_windows_of_panes(spark, train, test):
    """Train lengths that are and are not multiples of the step; values of 1e9 plus noise."""
    n, k = 40, 3
    x = np.random.default_rng(6).normal(size=(n, k))
    d = panel(spark, x + 1e9)
    mu, cov = walkforward.window_moments(d, train, test, 1)
    means = {(r["window_id"], r["symbol"]): r for r in mu.collect()}
    covs = {(r["window_id"], r["symbol_row"], r["symbol_col"]): r["value"] for r in cov.collect()}
    windows = (n - train - test) // test + 1
    assert {w for w, _ in means} == set(range(windows)) and len(covs) == windows * k * k
    for w in range(windows):
        part = x[w * test + 1 : w * test + train]
        want = np.atleast_2d(np.cov(part.T))
        for i in range(k):
            r = means[w, f"s{i:04d}"]
            assert r["mean_return"] == pytest.approx(part[:, i].mean() + 1e9, abs=1e-5) and r["volatility"] == pytest.approx(part[:, i].std(ddof=1), abs=1e-6)
            for j in range(k):
                assert covs[w, f"s{i:04d}", f"s{j:04d}"] == pytest.approx(want[i, j], abs=1e-6)
    plan = cov._jdf.queryExecution().optimizedPlan().toString()
    assert "covar_pop" in plan
    with pytest.raises(Exception, match="too few dates"):
        walkforward.window_moments(d, n, test, 1)[0].collect()
