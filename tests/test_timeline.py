"""The ordered primitives against brute force, with blocks small enough that every case crosses many of them."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickweave.timeline import lowest_mean, nth, number_rows, running, smoothed, trailing, value_ladder, wealth


def series(spark, sizes: dict[str, int], seed: int = 1):
    rnd = random.Random(seed)
    rows = []
    for s, n in sizes.items():
        for i in range(n):
            rows.append((s, datetime(2020, 1, 1) + timedelta(days=17 * i), i + 1, rnd.uniform(-0.2, 0.3)))
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, want long, x double")


def by_symbol(df, *cols):
    out: dict[str, list] = {}
    for r in df.orderBy("symbol", "pos").collect():
        out.setdefault(r["symbol"], []).append(tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]])
    return out


def test_number_rows_counts_over_calendar_slices(spark):
    d = number_rows(series(spark, {"hot": 400, "cold": 3}))
    assert d.filter("pos <> want").count() == 0
    assert d.count() == 403


@pytest.mark.parametrize("block", [1, 7, 50])
def test_trailing_equals_plain_window(spark, block):
    d = series(spark, {"hot": 200, "cold": 5}).withColumnRenamed("want", "pos")
    got = by_symbol(trailing(d, 6, lambda w: {"m": F.avg("x").over(w.rowsBetween(-6, 0)), "l": F.lag("x").over(w)}, block=block), "x", "m", "l")
    for rows in got.values():
        xs = [r[0] for r in rows]
        for i, (_, m, lag) in enumerate(rows):
            part = xs[max(0, i - 6) : i + 1]
            assert m == pytest.approx(sum(part) / len(part))
            assert lag == (xs[i - 1] if i else None)


def test_running_totals_cross_blocks(spark):
    d = series(spark, {"hot": 120, "cold": 2}).withColumnRenamed("want", "pos")
    got = by_symbol(running(d, {"s": ("sum", F.col("x")), "p": ("product", 1 + F.col("x")), "m": ("max", F.col("x"))}, block=11), "x", "s", "p", "m")
    for rows in got.values():
        s, p, m = 0.0, 1.0, -math.inf
        for x, gs, gp, gm in rows:
            s, p, m = s + x, p * (1 + x), max(m, x)
            assert (gs, gp, gm) == (pytest.approx(s), pytest.approx(p), m)


@pytest.mark.parametrize("scale", [1, 9])
def test_wealth_and_peak_cross_blocks(spark, scale):
    """Scaled up, some growth factors are negative."""
    d = series(spark, {"hot": 150, "cold": 4}, seed=5).withColumnRenamed("want", "pos").withColumn("x", (F.col("x") - 0.05) * scale)
    for rows in by_symbol(wealth(d, 1 + F.col("x"), block=13), "x", "value", "peak").values():
        v = peak = 1.0
        for x, gv, gp in rows:
            v *= 1 + x
            peak = max(peak, v)
            assert gv == pytest.approx(v) and gp == pytest.approx(peak)


@pytest.mark.parametrize(("alpha", "seed", "n"), [(0.9, 3, 1000), (2 / 13, 12, 4200), (1 / 14, 14, 40)])
def test_smoothed_equals_recursion(spark, alpha, seed, n):
    d = series(spark, {"a": n, "short": seed - 1}, seed=3).withColumnRenamed("want", "pos")
    got = by_symbol(smoothed(d, {"e": ("x", alpha, seed), "slow": ("x", 0.001, seed)}).drop("slow"), "x", "e")
    assert all(e is None for _, e in got["short"])
    xs = [x for x, _ in got["a"]]
    e = None
    for i, (x, have) in enumerate(got["a"]):
        if i + 1 < seed:
            assert have is None
            continue
        e = sum(xs[:seed]) / seed if i + 1 == seed else (x - e) * alpha + e
        assert have == pytest.approx(e, rel=1e-9, abs=1e-12)


def test_value_ladder_with_a_hot_value(spark):
    rnd = random.Random(9)
    values = [0.0] * 300 + [rnd.gauss(0, 1e-5) for _ in range(500)] + [5.0]
    d = spark.createDataFrame([("a", v) for v in values] + [("one", 2.0)], "symbol string, r double")
    k = 40
    got = {r["symbol"]: r for r in value_ladder(d, "r").groupBy("symbol").agg(
        nth("r", F.lit(k)).alias("kth"), nth("r", F.lit(0)).alias("low"), lowest_mean("r", F.lit(k)).alias("m"), F.max("size").alias("n")).collect()}
    s = sorted(values)
    assert got["a"]["kth"] == s[k] and got["a"]["n"] == len(s)
    assert got["a"]["m"] == pytest.approx(sum(s[:k]) / k)
    assert got["one"]["low"] == 2.0


def test_value_ladder_takes_part_of_a_tie(spark):
    d = spark.createDataFrame([("a", v) for v in (-1.0, -1.0, -1.0, 0.0)], "symbol string, r double")
    r = value_ladder(d, "r").groupBy("symbol").agg(lowest_mean("r", F.lit(2)).alias("m"), nth("r", F.lit(3)).alias("top")).first()
    assert (r["m"], r["top"]) == (-1.0, 0.0)


@pytest.mark.parametrize(("alpha", "seed", "block"), [(0.001, 5, None), (0.5, 1, 7), (0.5, 12, 3), (0.9, 60, None), (0.95, 60, 40), (0.2, 30, 11)])
def test_smoothing_is_the_recurrence_for_any_seed_and_block(spark, alpha, seed, block):
    d = series(spark, {"hot": 130, "cold": 3}, seed=9).withColumnRenamed("want", "pos").withColumn("x", F.col("x") * 1e12 + 1e12)
    for rows in by_symbol(smoothed(d, {"e": ("x", alpha, seed)}, block=block), "x", "e").values():
        e = None
        for i, (x, got) in enumerate(rows, 1):
            e = sum(r[0] for r in rows[:seed]) / seed if i == seed else alpha * x + (1 - alpha) * e if e is not None else None
            assert got == (pytest.approx(e, rel=1e-9) if e is not None else None)


def test_unlike_rates_are_smoothed_together(spark):
    d = series(spark, {"hot": 90}, seed=4).withColumnRenamed("want", "pos")
    both = smoothed(d, {"slow": ("x", 0.001, 2), "fast": ("x", 0.95, 3)})
    for name, alpha, seed in (("slow", 0.001, 2), ("fast", 0.95, 3)):
        one = by_symbol(smoothed(d, {"e": ("x", alpha, seed)}), "e")["hot"]
        assert by_symbol(both, name)["hot"][seed:] == pytest.approx(one[seed:])


def test_shared_dir_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from tickweave.session import shared_dir

    conf = SimpleNamespace(get=lambda *a: None, set=lambda *a: None)
    far = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: conf))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(far, "x")


def test_chained_smoothing_has_one_exchange_for_each_call(spark):
    """Signals of all kinds: a pass of plain frames, and one exchange for each level of smoothing; no join."""
    from tickweave.operators.signals import all_signals

    d = spark.createDataFrame([("a", i, 100.0 + i % 7) for i in range(1, 200)], "symbol string, pos long, close double")
    plan = all_signals(d)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") <= 4 and "Join" not in plan
