"""Small hand-computed cases and invariants."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickweave.functions import magnitude_number, percent_number, range_cutoff
from tickweave.operators import align, drawdown, grid, lifecycle, moments, pairs, portfolio, quality, risk, signals, walkforward
from tickweave.operators.bars import build_bars
from tickweave.sources import readers, writers
from tickweave.streaming.jobs import append_new_bars

PRICES = {
    "ONE": [71.0, 69.4, 73.1, 73.9, 72.2, 76.8, 75.1, 77.7, 80.3, 78.6], "TWO": [8.1, 8.4, 8.0, 8.9, 8.7, 8.2, 9.3, 9.1, 8.8, 9.6],
    "SIX": [310.0, 322.5, 305.0, 301.5, 318.0, 333.0, 329.0, 341.0, 352.5, 347.0],
}


def bars(spark, prices):
    rows = [(s, datetime(2024, 1, 1) + timedelta(days=i), float(p), float(p) + 1.0, float(p) - 1.0, float(p), 10.0) for s, ps in prices.items() for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")


@pytest.fixture(scope="module")
def rets(spark):
    return align.returns_only(align.with_returns(align.common_dates(bars(spark, PRICES)))).cache()


def logs(ps):
    return np.diff(np.log(ps))


def series(spark, values, symbol="a"):
    return spark.createDataFrame([(symbol, i + 1, float(v)) for i, v in enumerate(values)], "symbol string, pos long, r double")


def test_moments_match_numpy(rets):
    got = {r["symbol"]: r for r in moments.mean_vol(rets, 365).collect()}
    for s, ps in PRICES.items():
        assert got[s]["mean_return"] == pytest.approx(logs(ps).mean() * 365)
        assert got[s]["volatility"] == pytest.approx(logs(ps).std(ddof=1) * math.sqrt(365))
    cov = {(r["symbol_row"], r["symbol_col"]): r["value"] for r in moments.covariance(rets, 1).collect()}
    assert cov["ONE", "TWO"] == pytest.approx(np.cov(logs(PRICES["ONE"]), logs(PRICES["TWO"]))[0, 1])
    corr = {(r["symbol_row"], r["symbol_col"]): r["value"] for r in moments.correlation(rets).collect()}
    assert len(corr) == 9 and all(corr[s, s] == 1.0 for s in PRICES)
    assert all(corr[a, b] == pytest.approx(corr[b, a]) for a, b in corr)


def test_alignment_keeps_common_dates_only(spark):
    short = dict(PRICES, TWO=PRICES["TWO"][:7])
    assert align.common_dates(bars(spark, short)).groupBy("symbol").count().filter("count <> 7").count() == 0


def test_flat_series_has_zero_correlation(spark):
    d = align.returns_only(align.with_returns(bars(spark, {"A": [5] * 10, "B": PRICES["ONE"]})))
    assert {r["value"] for r in moments.correlation(d).filter("symbol_row <> symbol_col").collect()} == {0.0}


VAR_RETURNS = [0.013, -0.041, 0.022, -0.006, 0.037, -0.028, 0.009, -0.017, 0.031, -0.002] * 5


def test_value_at_risk_by_index(spark):
    r = risk.value_at_risk(series(spark, VAR_RETURNS)).first()
    s = sorted(VAR_RETURNS)
    assert r["historical_var"] == pytest.approx(-s[2]) and r["historical_cvar"] == pytest.approx(-np.mean(s[:2]))
    assert r["parametric_var"] == pytest.approx(-(np.mean(s) - 1.64485 * np.std(s, ddof=1)), abs=1e-4)
    assert r["parametric_cvar"] > r["parametric_var"]


def test_shape_and_ratios(spark):
    x = np.array([0.01, -0.02, 0.03, 0.015, -0.01, 0.02])
    n, z = len(x), (x - x.mean()) / x.std(ddof=1)
    r = risk.sample_shape(series(spark, x)).first()
    assert r["skewness"] == pytest.approx(n / ((n - 1) * (n - 2)) * (z**3).sum())
    assert r["excess_kurtosis"] == pytest.approx(n * (n + 1) / ((n - 1) * (n - 2) * (n - 3)) * (z**4).sum() - 3 * (n - 1) ** 2 / ((n - 2) * (n - 3)))
    assert risk.omega(series(spark, [0.1, 0.2])).first()["omega"] == math.inf
    d = risk.downside(series(spark, x), 0.0, 365).first()
    assert d["downside_deviation"] == pytest.approx(math.sqrt((np.minimum(x, 0) ** 2).mean() * 365))
    assert (d["n_negative"], d["n_positive"]) == (2, 4)
    assert risk.compounded_drawdown(series(spark, [0.1, -0.5, 0.2])).first()["max_drawdown"] == pytest.approx(0.5)
    assert risk.compounded_drawdown(series(spark, [0.1, 0.2])).first()["max_drawdown"] == 0.0


def test_drawdown_periods(spark):
    d = bars(spark, {"A": [100, 90, 95, 100, 110, 88, 99]}).withColumn("pos", F.dayofmonth("ts"))
    p = [r.asDict() for r in drawdown.drawdown_periods(drawdown.drawdown(d)).orderBy("start_idx").collect()]
    assert [(x["start_idx"], x["end_idx"], x["trough_idx"], x["duration"], x["recovered"]) for x in p] == [(1, 2, 1, 2, True), (5, 6, 5, 2, False)]
    assert p[0]["recovery_idx"] == 3 and p[0]["recovery_duration"] == 2 and p[1]["recovery_idx"] is None
    s = drawdown.drawdown_summary(drawdown.drawdown(d)).first()
    assert s["max_drawdown"] == pytest.approx(-0.2) and s["current_drawdown"] == pytest.approx(-0.1) and s["n_periods"] == 2


def test_signals_of_rising_prices(spark):
    d = bars(spark, {"UP": [100 + i for i in range(60)], "FLAT": [100] * 60}).withColumn("pos", F.date_diff("ts", F.lit("2024-01-01")) + 1)
    got = {r["symbol"]: r for r in signals.latest_signals(d).collect()}
    assert got["UP"]["sma_signal"] == "BUY" and got["UP"]["rsi_value"] == 100.0 and got["UP"]["rsi_signal"] == "SELL"
    assert got["FLAT"]["sma_signal"] == "HOLD" and got["FLAT"]["bollinger_signal"] == "HOLD" and got["FLAT"]["combined"] in ("HOLD", "SELL")
    reg = {r["symbol"]: r for r in signals.regimes(d).collect()}
    assert reg["UP"]["regime"] == "BULL" and reg["UP"]["trend_signal"] == "BULLISH"
    few = signals.regimes(d.filter("pos <= 10")).first()
    assert (few["regime"], few["vol_regime"], few["confidence"]) == ("SIDEWAYS", "UNKNOWN", 0.0)


def test_cointegrated_pair_is_found(spark):
    rng = np.random.default_rng(42)
    a = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 120)))
    b = 2 * a + rng.normal(0, 0.5, 120)
    other = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 120)))
    d = align.with_returns(bars(spark, {"A": list(a), "B": list(b), "C": list(other)}))
    got = {(r["symbol_a"], r["symbol_b"]): r for r in pairs.cointegrated_pairs(d).collect()}
    assert got["A", "B"]["is_cointegrated"] and len(got) == 3


COV = np.array([[0.052, 0.011, 0.017], [0.011, 0.083, 0.009], [0.017, 0.009, 0.031]])
NAMES = ["a", "b", "c"]


def long_cov(spark, cov=COV):
    return spark.createDataFrame([(NAMES[i], NAMES[j], float(cov[i, j])) for i in range(3) for j in range(3)], "symbol_row string, symbol_col string, value double")


def test_portfolio_algebra(spark):
    w = np.array([0.5, 0.3, 0.2])
    wf = spark.createDataFrame([("p", n, float(x)) for n, x in zip(NAMES, w, strict=True)], "portfolio string, symbol string, weight double")
    mu = spark.createDataFrame(list(zip(NAMES, (0.15, 0.2, 0.1), strict=True)), "symbol string, mean_return double")
    s = portfolio.portfolio_stats(wf, mu, long_cov(spark)).first()
    assert s["variance"] == pytest.approx(w @ COV @ w) and s["weights_ok"]
    assert s["sharpe"] == pytest.approx((0.155 - 0.05) / math.sqrt(w @ COV @ w))
    rc = portfolio.risk_contributions(wf, long_cov(spark))
    assert rc.agg(F.sum("pct_contribution")).first()[0] == pytest.approx(1.0)
    bad = wf.withColumn("weight", F.col("weight") * 2)
    with pytest.raises(Exception, match="weights do not sum to 1"):
        portfolio.evaluate(bad, mu, long_cov(spark))[0].collect()
    extra = wf.unionByName(spark.createDataFrame([("p", "zz", 0.0)], wf.schema))
    assert [r["symbol"] for r in portfolio.evaluate(extra, mu, long_cov(spark))[2].collect()] == ["zz"]


def test_grid_holds_every_split_once(spark):
    mu = spark.createDataFrame(list(zip(NAMES, (0.15, 0.2, 0.1), strict=True)), "symbol string, mean_return double")
    g = grid.scored(grid.candidates(grid.universe(mu, long_cov(spark)), 3, 10), 3, 10).cache()
    assert g.count() == math.comb(12, 2) == g.select("candidate").distinct().count()
    w = {r["objective"]: np.array(r["parts"]) / 10 for r in grid.best(g).collect()}
    assert w["min_variance"] @ COV @ w["min_variance"] == pytest.approx(min(
        np.array(r["parts"]) @ COV @ np.array(r["parts"]) / 100 for r in g.collect()))
    with pytest.raises(ValueError, match="unknown objective"):
        grid.best(g, objectives=["nope"])


def test_a_grid_of_another_size_than_the_universe_is_an_error(spark):
    mu = spark.createDataFrame(list(zip(NAMES, (0.15, 0.2, 0.1), strict=True)), "symbol string, mean_return double")
    for k in (2, 4):
        with pytest.raises(Exception, match="the universe has 3 symbols"):
            grid.candidates(grid.universe(mu, long_cov(spark)), k, 10).collect()


def test_infeasible_bounds_are_an_error(spark):
    names = spark.createDataFrame([(n,) for n in NAMES], "symbol string")
    assert grid.checked(names, {NAMES[0]: 0.5}, {}).first()["is_feasible"]
    for low, high in (({NAMES[0]: 0.7, NAMES[1]: 0.6}, {}), ({}, dict.fromkeys(NAMES, 0.2))):
        with pytest.raises(Exception, match="infeasible bounds"):
            grid.checked(names, low, high).collect()


def test_the_capital_line_touches_the_best_ratio(spark):
    mu = spark.createDataFrame(list(zip(NAMES, (0.15, 0.2, 0.1), strict=True)), "symbol string, mean_return double")
    rows = grid.frontier(grid.scored(grid.candidates(grid.universe(mu, long_cov(spark)), 3, 10), 3, 10)).collect()
    line = {r["name"]: r for r in rows if r["kind"] == "capital_line"}
    best = next(r for r in rows if r["kind"] == "optimum" and r["name"] == "max_sharpe")
    slope = (line["end"]["expected_return"] - line["start"]["expected_return"]) / line["end"]["volatility"]
    assert line["start"]["expected_return"] == pytest.approx(0.05) and line["start"]["volatility"] == 0
    assert 0.05 + slope * best["volatility"] == pytest.approx(best["expected_return"])


def test_repeated_bars_do_not_make_a_date_common(spark):
    day = [datetime(2024, 5, d) for d in (1, 2, 3)]
    rows = [("x", day[0], 1.0, 1), ("y", day[0], 2.0, 1), ("x", day[1], 3.0, 1), ("x", day[1], 2.5, 2), ("y", day[2], 4.0, 1), ("x", day[2], 7.0, 2), ("x", day[2], 9.0, 1)]
    schema = "symbol string, ts timestamp_ntz, close double, arrival long"
    got = {(r["symbol"], r["ts"].day): r["close"] for r in align.common_dates(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("x", 1): 1.0, ("y", 1): 2.0, ("x", 3): 7.0, ("y", 3): 4.0}
    with pytest.raises(Exception, match="no date in common"):
        align.common_dates(spark.createDataFrame([rows[0], rows[4]], schema)).collect()


def test_a_flat_symbol_has_an_inverse_volatility_weight(spark):
    vol = spark.createDataFrame([("a", 0.0), ("b", 0.3)], "symbol string, volatility double")
    w = {r["symbol"]: r["weight"] for r in portfolio.inverse_volatility_weights(vol).collect()}
    assert w["a"] + w["b"] == pytest.approx(1) and w["a"] > 0.99


def test_too_few_dates_is_an_error(spark):
    d = spark.createDataFrame([(datetime(2024, 1, 1) + timedelta(days=i), i + 1) for i in range(20)], "ts timestamp_ntz, pos int")
    assert walkforward.windows(d, 10, 5).count() == 2
    with pytest.raises(Exception, match="too few dates"):
        walkforward.windows(d, 18, 5).collect()


def test_bronze_contract_and_stages(spark):
    rules = {r["rule"]: r["violations"] for r in quality.bronze_contract(bars(spark, {"A": [1, 2], "B": [3]})).collect()}
    assert rules["min_records"] == 1 and rules["positive_close"] == 0 and len(rules) == 7
    with pytest.raises(ValueError, match="unknown stage"):
        quality.check_stage("tin", {})
    assert not quality.check_stage("gold", {"sharpness": bars(spark, {"A": [1]})}).first()["passed"]


def test_ranking_table(spark):
    cell = '<td><a><span class="coin-name">Quill</span> <b class="x symbol">qul</b></a></td>'
    row = f"<tr><td>1</td>{cell}<td>$7,310.25</td><td>▼ 2.5%</td><td>$36B</td><td>$4.5M</td></tr>"
    bare = "<tr><td>2</td><td>plain</td><td>$3</td><td>1%</td><td>9K</td></tr>"
    html = f"<p>x</p><table><tr><th>h</th></tr>{row}{bare}<tr><td>short</td></tr></table><table>{row}</table>"
    got = lifecycle.ranking_table(spark.createDataFrame([(1, html)], "page_id int, html string")).orderBy("rank").collect()
    assert [tuple(r)[1:] for r in got] == [(1, "Quill", "QUL", 7310.25, -2.5, 3.6e10, 4.5e6), (2, "Unknown", "UNK", 3.0, 1.0, 9000.0, 0.0)]


@pytest.mark.parametrize(("text", "want"), [("$1.5B", 1.5e9), ("2,000", 2000.0), ("3K", 3000.0), ("", 0.0), ("n/a", 0.0), ("1.5X", 0.0), (None, 0.0)])
def test_magnitude_text(spark, text, want):
    d = spark.createDataFrame([(text,)], "t string")
    assert d.select(magnitude_number("t").alias("v")).first()["v"] == want


@pytest.mark.parametrize(("text", "want"), [("1.5%", 1.5), ("-2 %", -2.0), ("▼3%", -3.0), ("▲3%", 3.0), ("x", 0.0)])
def test_percent_text(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(percent_number("t").alias("v")).first()["v"] == want


def test_unknown_range(spark):
    with pytest.raises(ValueError, match="unknown range"):
        range_cutoff("2Y", F.lit("2024-01-01").cast("timestamp_ntz"))


def test_write_replaces_only_touched_months(spark, tmp_path):
    path = str(tmp_path / "lake")
    writers.write_bars(bars(spark, {"A": list(range(1, 61)), "B": [1, 2]}), path)
    writers.write_bars(bars(spark, {"A": [7]}), path)
    got = {r["symbol"]: r["n"] for r in readers.read_bars(spark, path).groupBy("symbol").agg(F.count("*").alias("n")).collect()}
    assert got == {"A": 60 - 31 + 1, "B": 2}
    with pytest.raises(FileNotFoundError):
        readers.read_bars(spark, path, ["none"])


def test_appending_a_batch_twice_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "lake")
    b = bars(spark, {"A": [1, 2, 3]})
    append_new_bars(b.unionByName(b), path)
    append_new_bars(b.withColumn("close", F.lit(9.0)).unionByName(bars(spark, {"A": [1, 2, 3, 4]}).filter("close = 4")), path)
    assert sorted(r["close"] for r in readers.read_bars(spark, path).collect()) == [1.0, 2.0, 3.0, 4.0]


def test_bars_break_ties_by_id(spark):
    t = datetime(2024, 1, 1)
    d = spark.createDataFrame([("a", t, 5.0, 2), ("a", t, 7.0, 1), ("a", t + timedelta(hours=1), 6.0, 0)], "s string, ts timestamp_ntz, p double, id long")
    r = build_bars(d, symbol="s", ts="ts", price="p", bucket="day", tie="id").first()
    assert (r["open"], r["high"], r["low"], r["close"], r["volume"]) == (7.0, 7.0, 5.0, 6.0, 3.0)


def test_dimension_ids_of_short_names(spark):
    names = [f"{chr(97 + i % 26)}{i // 26}" for i in range(300)]
    got = {r["symbol"]: r["symbol_id"] for r in lifecycle.dimension_type1(spark.createDataFrame([(n,) for n in names + names[:9]], "symbol string")).collect()}
    assert got == {n: i for i, n in enumerate(sorted(names), 1)}


def test_file_sizes_are_those_of_a_listing(spark, sf, tmp_path, monkeypatch):
    """f17_file_sizes and f18_zone_bytes count every data file of the lake they wrote."""
    from tickweave.plans import catalog, q_warehouse

    for name in ("f17_file_sizes", "f18_zone_bytes"):
        at = tmp_path / name
        monkeypatch.setattr(q_warehouse, "shared_dir", lambda spark, what, at=at: str(at))
        got, want = catalog.QUERIES[name](spark, sf).collect(), {}
        for f in at.rglob("*"):
            parts = f.relative_to(at).parts
            if f.is_file() and not any(p.startswith(("_", ".")) for p in parts):
                symbol, year, month = (p.split("=")[1] for p in parts[:3])
                n, size = want.get((symbol, int(year), int(month)), (0, 0))
                want[symbol, int(year), int(month)] = (n + 1, size + f.stat().st_size)
        if name == "f17_file_sizes":
            assert want and {(g["symbol"], g["year"], g["month"]): (g["n_files"], g["n_bytes"]) for g in got} == want
        else:
            assert tuple(got[0]) == (sum(n for n, _ in want.values()), sum(b for _, b in want.values()))


def test_failing_strategies_leave_the_others_alone(spark):
    mu = spark.createDataFrame([(w, s, 0.1, 0.2) for w in (0, 1) for s in ("a", "b")], "window_id long, symbol string, mean_return double, volatility double")
    cov = spark.createDataFrame([(w, a, b, 0.04 if a == b else 0.01) for w in (0, 1) for a in "ab" for b in "ab"], "window_id long, symbol_row string, symbol_col string, value double")

    @walkforward.strategy("raises")
    def _(mu, cov, **_):
        raise RuntimeError("no data today")

    @walkforward.strategy("nothing in one window")
    def _(mu, cov, **_):
        return walkforward.rule_weights(mu, "equal_weight").where("window_id = 1")

    @walkforward.strategy("nulls")
    def _(mu, cov, **_):
        return mu.select("window_id", "symbol", F.lit(None).cast("double").alias("weight"))

    names = ["equal_weight", "min_variance", "raises", "nothing in one window", "nulls"]
    weights, failures = walkforward.strategy_weights(mu, cov, names, units=4)
    got = {(r["strategy"], r["window_id"]): r["error"] for r in failures.collect()}
    assert got == {("raises", 0): "no data today", ("raises", 1): "no data today", ("nothing in one window", 0): "no weights",
                   ("nulls", 0): "2 weights are null or not finite", ("nulls", 1): "2 weights are null or not finite"}
    assert {(r["strategy"], r["window_id"], r["symbol"], r["weight"]) for r in weights.collect()} == {
        *((n, w, s, 0.5) for n in names[:2] for w in (0, 1) for s in "ab"), *(("nothing in one window", 1, s, 0.5) for s in "ab")}
    with pytest.raises(ValueError, match="unknown strategy"):
        walkforward.strategy_weights(mu, cov, ["nope"])
    none = walkforward.strategy_weights(mu, cov, [])
    assert none[0].count() == none[1].count() == 0


def test_no_names_are_left_in_the_session(spark, sf):
    """Queries in SQL text leave neither views nor functions behind."""
    from tickweave.plans.catalog import QUERIES

    spark.sql("CREATE TEMPORARY FUNCTION log_return(c DOUBLE) RETURNS DOUBLE RETURN c + 1")
    before = {t.name for t in spark.catalog.listTables()}
    for name in ("c1_free_sql", "n1_macro_column"):
        assert QUERIES[name](spark, sf).count() >= 0
    assert {t.name for t in spark.catalog.listTables()} == before and spark.sql("SELECT log_return(1D)").first()[0] == 2
    spark.sql("DROP TEMPORARY FUNCTION log_return")


@pytest.mark.parametrize("level", [0.0, 1e6])
def test_closed_form_of_the_residual_test(spark, level):
    """Slope, intercept and statistic from moments are those of the residuals themselves, on prices near 1e6, too."""
    rng = np.random.default_rng(9)
    x = level + np.cumsum(rng.normal(size=(200, 3)), axis=0)
    x[:, 2] = 3 * x[:, 0] + rng.normal(size=200) - 2 * level
    days = [datetime(2024, 1, 1) + timedelta(days=i) for i in range(200)]
    d = spark.createDataFrame([(s, t, i + 1, float(x[i, j])) for j, s in enumerate("abc") for i, t in enumerate(days)], "symbol string, ts timestamp, pos int, price double")
    got = pairs.residual_statistic(pairs.lagged_moments(d))
    plan = got._jdf.queryExecution().executedPlan().toString()
    for r in got.collect():
        a, b = x[:, "abc".index(r["symbol_a"])], x[:, "abc".index(r["symbol_b"])]
        slope, intercept = np.polyfit(b - b.mean(), a, 1)
        e = a - intercept - slope * (b - b.mean())
        design = np.stack([np.ones(199), e[:-1]], axis=1)
        beta, rest, *_ = np.linalg.lstsq(design, np.diff(e), rcond=None)
        t = beta[1] / np.sqrt(rest[0] / 197 * np.linalg.inv(design.T @ design)[1, 1])
        assert r["slope"] == pytest.approx(slope, rel=1e-8) and r["statistic"] == pytest.approx(t, rel=1e-5)
    assert plan.count("hashpartitioning(symbol_a") == 1 and plan.count("Window") == plan.count("Window [lag(price")


def test_retention_rewrites_one_month(spark, tmp_path):
    """Months before the limit go, the month it falls in keeps its later rows, files of later months stay as they are."""
    from tickweave.sources import readers, writers

    path = str(tmp_path / "zone")
    rows = [(s, datetime(2024, 1, 1) + timedelta(days=3 * i), float(i)) for s in ("a b", "c") for i in range(60) if s == "c" or not 20 <= i <= 30]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double")
    writers.write_bars(df, path)
    before = {r["path"] for r in readers.stored_files(spark, path).collect()}
    gone = writers.retain(spark, path, "ts TIMESTAMP_NTZ, close DOUBLE", 110, str(tmp_path / "one"))
    limit = max(t for _, t, _ in rows) - timedelta(days=110)
    kept = sorted((s, t, c) for s, t, c in rows if t > limit)
    got = spark.read.schema("ts TIMESTAMP_NTZ, close DOUBLE, symbol STRING, year INT, month INT").parquet(path)
    assert sorted((r["symbol"], r["ts"], r["close"]) for r in got.collect()) == kept and gone > 0
    same = {r["path"] for r in readers.stored_files(spark, path).collect()} & before
    assert {tuple(p.split("month=")[1].split("/")[:1]) for p in same} == {(str(m),) for m in range(limit.month + 1, 7)}
    assert writers.retain(spark, path, "ts TIMESTAMP_NTZ, close DOUBLE", 110, str(tmp_path / "two")) == 0
    assert writers.retain(spark, str(tmp_path / "none"), "ts TIMESTAMP_NTZ, close DOUBLE", 1, str(tmp_path / "three")) == 0
    assert readers.stored_names(spark, str(tmp_path), {"x": "nothing"}).count() == 0


def test_the_rest_works_without_the_training_data_package(tmp_path):
    """A copy without the llm folders and the pipeline still imports, and lists its queries and their SQL."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    for keep_pipeline in (False, True):
        copy = tmp_path / f"copy{keep_pipeline}"
        shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if keep_pipeline else ["corpus_pipeline.py"])))
        code = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') or n == 'pipeline' for n in q), set(e.oracle_sql()) <= set(q))"
        out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
        assert out.returncode == 0 and out.stdout.split()[1:] == ["0", "True"] and int(out.stdout.split()[0]) > 200, out.stderr
