"""The physical plan of a result, for tests that look at it."""

from __future__ import annotations


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
