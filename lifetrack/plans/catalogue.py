"""All registered queries."""

from . import queries_relational, queries_movement, queries_covariates, queries_analysis  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
