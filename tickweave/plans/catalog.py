"""All registered queries; importing the modules fills the registry."""

from . import q_portfolio, q_quality, q_risk, q_search, q_signals, q_sources, q_streaming, q_walkforward, q_warehouse  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
