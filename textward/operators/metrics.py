"""Confusion matrix, precision, recall and F1; positive means filtered."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _counts(predicted: str, actual: str) -> list[Column]:
    p, a = F.col(predicted), F.col(actual)
    return [
        F.count_if(p & a).alias("tp"),
        F.count_if(p & ~a).alias("fp"),
        F.count_if(~p & a).alias("fn"),
        F.count_if(~p & ~a).alias("tn"),
    ]


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def _with_rates(df: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = df.withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", _ratio(2 * (p * r), p + r))


def confusion_metrics(
    df: DataFrame, predicted: str = "is_filtered", actual: str = "malicious"
) -> DataFrame:
    """One row ``(tp, fp, fn, tn, precision, recall, f1)``; an empty denominator gives 0."""
    return _with_rates(df.agg(*_counts(predicted, actual)))


def metrics_by_slice(
    df: DataFrame,
    slices: Sequence[str],
    predicted: str = "is_filtered",
    actual: str = "malicious",
    total: str = "(all)",
) -> DataFrame:
    """The same per value of each slice column and for all rows together.

    ``(slice, value, tp, ...)``; the counts of all slices come from one pass with grouping sets.
    """
    sets = [[s] for s in slices] + [[]]
    counted = df.groupingSets(sets, *slices).agg(
        *_counts(predicted, actual), F.grouping_id().alias("_gid")
    )
    # a set bit marks a column that was aggregated away; the first column has the highest bit
    full = 2 ** len(slices) - 1
    name, value = F.lit(total), F.lit(None).cast("string")
    for i, s in enumerate(slices):
        here = F.col("_gid") == full ^ (1 << (len(slices) - 1 - i))
        name = F.when(here, F.lit(s)).otherwise(name)
        value = F.when(here, F.col(s).cast("string")).otherwise(value)
    named = counted.select(
        name.alias("slice"), value.alias("value"), "tp", "fp", "fn", "tn"
    )
    return _with_rates(named)


def join_labels(
    decisions: DataFrame, labels: DataFrame, key: str, actual: Column
) -> DataFrame:
    """Decisions with the truth per text: ``is_filtered`` and ``malicious``."""
    truth = labels.select(key, actual.alias("malicious"))
    return decisions.join(truth, key).withColumn("is_filtered", F.col("action") == "filter")


def filter_rates(
    events: DataFrame,
    filtered: Column,
    window: str = "1 hour",
    watermark: str = "10 minutes",
    ts: str = "ts",
) -> DataFrame:
    """Decisions and filtered share per time window, for a table or a stream."""
    timed = events.withWatermark(ts, watermark) if events.isStreaming else events
    return (
        timed.groupBy(F.window(ts, window).alias("w"))
        .agg(F.count(F.lit(1)).alias("decisions"), F.count_if(filtered).alias("filtered"))
        .select(
            F.col("w.start").alias("window_start"),
            "decisions",
            "filtered",
            (F.col("filtered") / F.col("decisions")).alias("rate"),
        )
    )
