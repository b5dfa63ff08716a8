"""Column functions shared by the operators; all run inside Spark's generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rational approximation of the normal quantile.
QUANTILE_NUMERATOR = (2.515517, 0.802853, 0.010328)
QUANTILE_DENOMINATOR = (1.0, 1.432788, 0.189269, 0.001308)

CRYPTO_SUFFIXES = ("USDT", "BUSD")


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rounded(x: str | Column, places: int = 6) -> Column:
    return F.round(_c(x), places)


def log_return(price: str | Column, previous: str | Column) -> Column:
    """ln(price/previous); null without a positive previous price."""
    p = _c(previous)
    return F.when(p > 0, F.log(_c(price) / p))


def simple_return(price: str | Column, previous: str | Column) -> Column:
    """price/previous - 1, and 0 where the previous price is not positive."""
    p = _c(previous)
    return F.when(p.isNotNull(), F.when(p > 0, _c(price) / p - 1.0).otherwise(F.lit(0.0)))


def null_safe_return(price: str | Column, previous: str | Column) -> Column:
    p = F.nullif(_c(previous), F.lit(0.0))
    return (_c(price) - p) / p


def finite(x: str | Column, default: float = 0.0) -> Column:
    v = _c(x)
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(default)).otherwise(v)


def guarded_ratio(num: Column, den: Column, default: float | None = 0.0, floor: float = 0.0) -> Column:
    """num/den where den exceeds ``floor``; ``default`` otherwise."""
    return F.when(den > floor, num / den).otherwise(F.lit(default).cast("double"))


def clip(x: str | Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), _c(x)))


def _poly(t: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * t + c
    return out


def normal_quantile(p: str | Column) -> Column:
    """Standard normal quantile; null outside (0, 1)."""
    p = _c(p)
    t = F.sqrt(F.log(F.least(p, 1.0 - p)) * -2.0)
    upper = t - _poly(t, QUANTILE_NUMERATOR) / _poly(t, QUANTILE_DENOMINATOR)
    return F.when((p > 0) & (p < 1), F.when(p < 0.5, -upper).otherwise(upper))


def normal_density(x: str | Column) -> Column:
    x = _c(x)
    return F.exp(x * x * -0.5) / math.sqrt(2.0 * math.pi)


def is_crypto(symbol: str | Column) -> Column:
    s = _c(symbol)
    return s.endswith(CRYPTO_SUFFIXES[0]) | s.endswith(CRYPTO_SUFFIXES[1])


def asset_class(symbol: str | Column) -> Column:
    return F.when(_c(symbol).endswith("USDT"), "crypto").otherwise("traditional")


def day_of_week(ts: str | Column) -> Column:
    """Sunday is 0."""
    return F.dayofweek(_c(ts)) - 1


def calendar(ts: str | Column) -> dict[str, Column]:
    t = _c(ts)
    d = day_of_week(t)
    return {
        "year": F.year(t),
        "month": F.month(t),
        "day": F.dayofmonth(t),
        "day_of_week": d,
        "is_weekend": d.isin(0, 6),
    }


def calendar_extended(ts: str | Column) -> dict[str, Column]:
    t = _c(ts)
    day = t.cast("date")
    return {
        "quarter": F.quarter(t),
        "week": F.weekofyear(t),
        "day_name": F.date_format(t, "EEEE"),
        "is_month_end": F.last_day(day) == day,
        "is_quarter_end": (F.last_day(day) == day) & (F.month(day) % 3 == 0),
    }


RANGES = ("1D", "3D", "5D", "1W", "MTD", "1M", "3M", "6M", "YTD", "1Y", "All")


def range_cutoff(name: str, latest: Column) -> Column | None:
    """First moment shown by a named range that ends at ``latest``; None for all data."""
    day = latest.cast("date")
    since_midnight = latest - F.date_trunc("day", latest).cast("timestamp_ntz")

    def months(n: int) -> Column:
        return F.add_months(day, -n).cast("timestamp_ntz") + since_midnight

    def at_day(d: Column) -> Column:
        return d.cast("timestamp_ntz") + since_midnight

    if name in ("1D", "3D", "5D"):
        return latest - F.expr(f"INTERVAL {name[0]} DAY")
    match name:
        case "1W":
            return latest - F.expr("INTERVAL 7 DAY")
        case "MTD":
            return at_day(F.trunc(day, "month"))
        case "1M" | "3M" | "6M":
            return months(int(name[0]))
        case "YTD":
            return at_day(F.trunc(day, "year"))
        case "1Y":
            return months(12)
        case "All":
            return None
    raise ValueError(f"unknown range {name!r}; known: {', '.join(RANGES)}")


def invested(weight: str | Column, threshold: float = 1e-4) -> Column:
    return F.abs(_c(weight)) >= threshold
