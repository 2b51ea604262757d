"""Queries over the given tables, one or more per operator, with the SQL each must agree with."""

from tieout.queries import checks, reconcile, shape, star, time  # noqa: F401
from tieout.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
