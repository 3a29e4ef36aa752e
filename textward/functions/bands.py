"""Score bands: distance ratings and groundedness assessments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col

# Upper bound (strict), points and name of each cosine distance band.
DISTANCE_BANDS = (
    (0.20, 8, "STRONG"),
    (0.45, 5, "GOOD"),
    (0.60, 1, "WEAK"),
)
DISTANCE_REST = (0, "IRRELEVANT")
STRONG_ENOUGH = 8

# Lower bound (inclusive) and text of each groundedness band.
ASSESSMENT_BANDS = (
    (0.7, "Response is highly consistent with the provided context."),
    (0.5, "Response shows moderate consistency with context."),
    (0.3, "Response shows weak consistency. Potential partial hallucination."),
)
ASSESSMENT_REST = "Response appears to be hallucinated or unrelated to context."
ASSESSMENT_NO_CONTEXT = "No RAG context provided for comparison."
HALLUCINATION_BELOW = 0.4


def distance_points(distance: Column | str) -> Column:
    """Rating of a cosine distance in points; no distance gives no points."""
    d = _col(distance)
    out = None
    for bound, points, _ in DISTANCE_BANDS:
        out = F.when(d < bound, points) if out is None else out.when(d < bound, points)
    return out.otherwise(DISTANCE_REST[0]).cast("int")


def distance_band(distance: Column | str) -> Column:
    """Name of the rating of a cosine distance."""
    d = _col(distance)
    out = None
    for bound, _, name in DISTANCE_BANDS:
        out = F.when(d < bound, name) if out is None else out.when(d < bound, name)
    return out.otherwise(DISTANCE_REST[1])


def strong_enough(points: Column | str) -> Column:
    return F.coalesce(_col(points) >= STRONG_ENOUGH, F.lit(False))


def assessment_band(score: Column | str) -> Column:
    """Text for a groundedness score; a null score means there was no context."""
    s = _col(score)
    out = F.when(s.isNull(), ASSESSMENT_NO_CONTEXT)
    for bound, text in ASSESSMENT_BANDS:
        out = out.when(s >= bound, text)
    return out.otherwise(ASSESSMENT_REST)


def is_hallucination(score: Column | str) -> Column:
    """Flag below the bound; an answer without context (null score) is flagged too."""
    s = _col(score)
    return F.coalesce(s < HALLUCINATION_BELOW, F.lit(True))
