"""Toxicity and injection scores on native patterns.

All scorers share one contract: text in, DOUBLE in 0..1 out.  Model scorers with the same
contract are in :mod:`textward.operators.models`.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import catalog
from ..catalog import WeightedPattern
from ..functions.text import _col, any_match, unicode_pattern


def has_weighted_hit(text: Column | str, patterns: Sequence[WeightedPattern]) -> Column:
    """True where any of the patterns has a hit."""
    return any_match(text, [(p.pattern, p.starts) for p in patterns])


def weighted_hits(
    text: Column | str, patterns: Sequence[WeightedPattern], guard: Column | None = None
) -> Column:
    """Sum of weight times hits, in catalogue order; null text has none.

    ``guard`` tells texts that can have a hit; by default one pass over the text finds out.
    """
    value = _col(text)
    if not patterns:
        return F.lit(0.0)
    terms = [
        F.regexp_count(value, F.lit(unicode_pattern(p.pattern))) * F.lit(float(p.weight))
        for p in patterns
    ]
    guard = has_weighted_hit(value, patterns) if guard is None else guard
    return F.when(guard, reduce(lambda a, b: a + b, terms, F.lit(0.0))).otherwise(0.0)


def saturate(hits: Column, rate: float) -> Column:
    """``1 - exp(-rate * hits)``: no hit gives 0, many hits approach 1."""
    return F.lit(1.0) - F.exp(F.lit(-float(rate)) * hits)


def score_toxicity(
    text: Column | str,
    terms: Sequence[WeightedPattern] = catalog.TOXIC_TERMS,
    rate: float = catalog.TOXIC_RATE,
    guard: Column | None = None,
) -> Column:
    """Toxicity by lexicon."""
    return saturate(weighted_hits(text, terms, guard), rate)


def score_injection(
    text: Column | str,
    cues: Sequence[WeightedPattern] = catalog.INJECTION_CUES,
    rate: float = catalog.INJECTION_RATE,
    guard: Column | None = None,
) -> Column:
    """Injection probability by cue phrases, over the whole text."""
    return saturate(weighted_hits(text, cues, guard), rate)


def injection_verdict(score: Column | str) -> Column:
    """``{label, score}``: the score is the confidence in the label."""
    s = _col(score)
    hit = s > catalog.INJECTION_LABEL_ABOVE
    return F.struct(
        F.when(hit, catalog.INJECTION_LABEL).otherwise(catalog.NO_INJECTION_LABEL).alias("label"),
        F.when(hit, s).otherwise(1.0 - s).alias("score"),
    )
