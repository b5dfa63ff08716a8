"""Data contracts: each rule is one row with its violation count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBERS = ("open", "high", "low", "close", "volume")


def _rules(df: DataFrame, counts: dict[str, Column]) -> DataFrame:
    one = df.agg(*[F.coalesce(c, F.lit(0)).cast("bigint").alias(n) for n, c in counts.items()])
    return one.unpivot([], list(counts), "rule", "violations").withColumn("passed", F.col("violations") == 0)


def _bad(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


# The rule names are fixed values: results carry them.


def bronze_contract(bars: DataFrame, min_rows: int = 2) -> DataFrame:
    """Seven rules in one pass: rules are folded per symbol, then over symbols."""
    missing = [c for c in ("ts", *NUMBERS) if c not in bars.columns]
    any_null = F.lit(False)
    for c in NUMBERS:
        any_null = any_null | F.col(c).isNull()
    per = bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), _bad(any_null).alias("nulls"), _bad(F.col("close") <= 0).alias("close"),
        _bad(F.col("volume") < 0).alias("volume"), _bad(F.col("high") < F.col("low")).alias("range"),
        _bad(F.col("ts").isNull()).alias("ts"),
    )
    return _rules(per, {
        "ohlcv_schema": F.lit(len(missing)), "no_null_ohlcv": F.sum("nulls"), "positive_close": F.sum("close"),
        "non_negative_volume": F.sum("volume"), "high_gte_low": F.sum("range"), "timestamp_not_empty": F.sum("ts"),
        "min_records": _bad(F.col("n") < min_rows),
    })


def returns_in_range(returns: DataFrame, value: str = "r") -> DataFrame:
    return _rules(returns, {"returns_in_range": _bad(F.abs(value) > 1)})


def positive_volatility(vol: DataFrame) -> DataFrame:
    return _rules(vol, {"volatility_positive": _bad(F.col("vol").isNull() | (F.col("vol") <= 0))})


def _mirrored(matrix: DataFrame) -> DataFrame:
    m = matrix.select("symbol_row", "symbol_col", "value")
    t = m.select(F.col("symbol_row").alias("symbol_col"), F.col("symbol_col").alias("symbol_row"),
                 F.col("value").alias("mirror"))
    return m.join(t, ["symbol_row", "symbol_col"], "left")


def correlation_rules(corr: DataFrame, tol: float = 1e-9) -> DataFrame:
    diagonal = F.col("symbol_row") == F.col("symbol_col")
    return _rules(_mirrored(corr), {
        "correlation_symmetric": _bad(F.col("mirror").isNull() | (F.abs(F.col("value") - F.col("mirror")) > tol)),
        "correlation_diagonal_one": _bad(diagonal & (F.abs(F.col("value") - 1) > tol)),
        "correlation_in_range": _bad(F.abs("value") > 1 + tol),
    })


def covariance_rules(cov: DataFrame, tol: float = 1e-9) -> DataFrame:
    return _rules(_mirrored(cov), {
        "covariance_symmetric": _bad(F.col("mirror").isNull() | (F.abs(F.col("value") - F.col("mirror")) > tol)),
    })


#: The fields a stored result must have, each a rule of its own.
REQUIRED = ("expected_return", "volatility", "sharpe_ratio")


def gold_contract(weights: DataFrame, result: DataFrame | None = None) -> DataFrame:
    """Weights sum to 1, are not negative and lie in [0, 1]; the stored result, if given, has every required field in all its rows."""
    return _rules(weights, {
        "weights_sum_to_one": F.when(F.abs(F.sum("weight") - 1) > 1e-6, 1).otherwise(0),
        "weights_non_negative": _bad(F.col("weight") < 0),
        "weights_bounded": _bad((F.col("weight") < 0) | (F.col("weight") > 1)),
    }) if result is None else gold_contract(weights).unionByName(_rules(result, {
        f"has_{c}": _bad(F.col(c).isNull()) if c in result.columns else F.lit(1) for c in REQUIRED
    }))


STAGES = {
    "bronze": {"bars": bronze_contract},
    "silver": {"returns": returns_in_range, "volatility": positive_volatility, "correlation": correlation_rules,
               "covariance": covariance_rules},
    "gold": {"weights": gold_contract},
}


def check_stage(stage: str, inputs: dict[str, DataFrame]) -> DataFrame:
    """All rules of a stage; an unknown input name is reported as a failed rule."""
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage!r}; known: {', '.join(STAGES)}")
    out = None
    for name, df in inputs.items():
        rule = STAGES[stage].get(name)
        part = rule(df) if rule else _rules(df, {"known_metric": F.lit(1)})
        part = part.withColumn("stage", F.lit(stage))
        out = part if out is None else out.unionByName(part)
    return out


def check_summary(rules: DataFrame) -> DataFrame:
    ok = F.sum(F.col("passed").cast("int"))
    n = F.count(F.lit(1))
    return rules.groupBy("stage").agg(
        (ok == n).alias("passed"), F.concat(ok.cast("string"), F.lit("/"), n.cast("string"), F.lit(" checks passed")).alias("summary")
    )


def column_tests(df: DataFrame, not_null: list[str], unique: list[str]) -> DataFrame:
    """``not_null`` in one scan; ``unique`` per column by a two-step count that partial-aggregates hot values."""
    out = _rules(df, {f"not_null_{c}": _bad(F.col(c).isNull()) for c in not_null})
    for c in unique:
        repeated = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(_rules(repeated, {f"unique_{c}": _bad(F.col("n") > 1)}))
    return out


def negative_volumes(bars: DataFrame) -> DataFrame:
    return bars.filter(F.col("volume") < 0)


def completeness(bars: DataFrame, now: str, min_rows: int) -> DataFrame:
    """Freshness, share of expected (day, symbol) cells with a close, and row floor, per symbol."""
    span = bars.agg(F.date_diff(F.max("ts"), F.min("ts")).alias("d")).select(F.col("d") + 1)
    moment = F.unix_micros(F.lit(now).cast("timestamp"))
    days = bars.filter(F.col("close").isNotNull()).groupBy("symbol", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    per = days.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_days"), F.sum("n").alias("n_rows"),
                                     F.max("last").alias("last_ts"))
    hours = (moment - F.unix_micros(F.col("last_ts").cast("timestamp"))) / 3_600_000_000
    return per.select(
        "symbol", (hours < 24).alias("is_fresh"), (F.col("n_days") / span.scalar()).alias("completeness"),
        (F.col("n_rows") >= min_rows).alias("enough_rows"),
    )


def accepted(bars: DataFrame) -> Column:
    ok = F.col("ts").isNotNull()
    for c in NUMBERS:
        ok = ok & F.col(c).isNotNull()
    return F.coalesce(ok & (F.col("close") > 0) & (F.col("volume") >= 0) & (F.col("high") >= F.col("low")), F.lit(False))


def quarantine(bars: DataFrame) -> DataFrame:
    """Every bar with whether it is accepted; write it partitioned by that flag to split the sinks."""
    return bars.withColumn("accepted", accepted(bars))


def write_quarantine(bars: DataFrame, good: str, bad: str) -> None:
    """Two sinks: accepted rows and the others."""
    marked = quarantine(bars)
    for path, ok in ((good, F.col("accepted")), (bad, ~F.col("accepted"))):
        marked.filter(ok).drop("accepted").write.parquet(path)
