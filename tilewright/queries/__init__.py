"""The engine's own queries over the driver's tables."""

from tilewright.queries import ingest, linear_algebra, more_planning, planning, predictors, run_log, transfers  # noqa: F401
from tilewright.queries.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
