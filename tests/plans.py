"""What tests ask of plans."""

from __future__ import annotations


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
