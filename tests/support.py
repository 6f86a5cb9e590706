"""Helpers that tests import by name; fixtures are in ``conftest.py``."""

from __future__ import annotations


def rows(df):
    """All rows as plain tuples, in a stable order."""
    return sorted((tuple(r) for r in df.collect()), key=str)


def plan_of(df):
    """The physical plan as text."""
    return df._jdf.queryExecution().executedPlan().toString()
