"""Columns that turn scraped text into numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Magnitude suffixes.
MAGNITUDES = {"B": 1e9, "M": 1e6, "K": 1e3}
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _number(text: Column) -> Column:
    return F.when(text.rlike(NUMBER), text.cast("double"))


def magnitude_number(text: str | Column) -> Column:
    """'$1,234.5M' -> 1234500000.0; 0.0 for text that is no number."""
    t = F.trim(F.regexp_replace(F.col(text) if isinstance(text, str) else text, "[$, ]", ""))
    factor, body = F.lit(1.0), t
    for suffix, size in MAGNITUDES.items():
        hit = t.endswith(suffix)
        factor = F.when(hit, F.lit(size)).otherwise(factor)
        body = F.when(hit, F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(body)
    return F.coalesce(_number(body) * factor, F.lit(0.0))


def percent_number(text: str | Column) -> Column:
    """'▼ 1.5%' -> -1.5; 0.0 for text that is no number."""
    t = F.trim(F.regexp_replace(F.col(text) if isinstance(text, str) else text, "[% ]", ""))
    value = _number(F.regexp_replace(t, "[-▼▲]", ""))
    return F.coalesce(F.when(t.contains("-") | t.contains("▼"), -value).otherwise(value), F.lit(0.0))
