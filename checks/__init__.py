"""Named queries over the test tables, each beside the plain SQL that gives the same rows.

The SQL is brute force on purpose: it shares no method with the Spark side.
"""

from checks import masks, neighbors, scores, tables, texts, training  # noqa: F401
from checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
