"""All queries of this package; importing the modules fills the registry."""

from . import q_labels, q_rows, q_words  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
