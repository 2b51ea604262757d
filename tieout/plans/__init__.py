"""Whole jobs put together from the operators: suites of checks, proposals, gates."""
