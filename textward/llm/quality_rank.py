"""Quality scores by Bradley-Terry ranking of preference pairs.

A document labelled good is preferred to one labelled bad.  The score is linear in features of
the text, and the probability that one document is preferred to another is the logistic
function of the difference of their scores; weights minimise the logistic loss on feature
differences.  The cut lies at the score quantile that equals the share of bad labels.

Cases: a null or empty text has features of an empty text and gets a score like any other; a
label of a missing document, or without value, is not used; rows that repeat get equal scores,
and several labels of one id count by their mean; without labels of both kinds every score is
0.5; an empty table gives an empty result.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, binary_column, stage

#: Labelled documents that the weights are fitted to, at most (picked by hash of the id).
LABELLED = 20_000
PAIRS = 60_000
STEPS = 300
RATE = 0.3
RIDGE = 1e-3

FEATURES = (
    "log_words",
    "no_words",
    "symbols_per_word",
    "bars_per_word",
    "marks_per_word",
    "upper_part",
    "digit_part",
    "other_part",
    "mean_word",
    "distinct_words",
    "stutter",
    "common_word",
    "words_per_line",
    "distinct_lines",
    "stops_per_word",
)
_LOWER, _UPPER, _DIGITS = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"


def held_out(key: Column) -> Column:
    """True for documents whose labels are never learned: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(3)) == 1, F.lit(False))


def features(text: bytes) -> list[float]:
    """Measures of a UTF-8 text in the order of ``FEATURES``."""

    def many(chars: bytes) -> int:
        return len(text) - len(text.translate(None, chars))

    words = text.split()
    n = len(words)
    size = max(len(text), 1)
    low = [w.lower() for w in words]
    tally: dict[bytes, int] = {}
    for w in low:
        tally[w] = tally.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    upper = many(_UPPER)
    letters = upper + many(_LOWER)
    per = max(n, 1)
    return [
        float(np.log1p(n)),
        float(n == 0),
        min(many(b"#*$%&<>") / per, 4.0),
        min(many(b"|") / per, 2.0),
        min(many(b"!?") / per, 2.0),
        upper / max(letters, 1),
        many(_DIGITS) / size,
        (size - letters) / size,
        min(sum(map(len, words)) / per, 40.0),
        len(tally) / per,
        sum(map(eq, low, low[1:])) / per,
        max(tally.values(), default=0) / per,
        float(np.log1p(n / max(len(lines), 1))),
        len(set(lines)) / max(len(lines), 1),
        min(many(b".,;:") / per, 2.0),
    ]


def feature_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, f) of every row: one pass over the texts."""
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames):
            f = pa.array([features(t) for t in binary_column(b, "text")], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), f], ["id", "f"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, f array<double>")


@dataclass
class Ranking:
    """Weights over standardised features, and the score at the cut."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8) @ self.weights - self.cut

    @classmethod
    def fit(cls, x: np.ndarray, good: np.ndarray, seed: int = 11) -> Ranking:
        """Learn from rows of features and their labels."""
        k = x.shape[1]
        if good.all() or not good.any():
            return cls(np.zeros(k), np.ones(k), np.zeros(k), 0.0)
        rng = np.random.default_rng(seed)
        mean, spread = x.mean(0), np.maximum(x.std(0), 1e-6)
        z = np.clip((x - mean) / spread, -8, 8)
        better = z[rng.choice(np.flatnonzero(good), PAIRS)]
        worse = z[rng.choice(np.flatnonzero(~good), PAIRS)]
        difference = better - worse
        w, history = np.zeros(k), np.full(k, 1e-8)
        for _ in range(STEPS):
            lost = 1 / (1 + np.exp(np.clip(difference @ w, -30, 30)))
            g = RIDGE * w - (lost[:, None] * difference).mean(0)
            history += g * g
            w -= RATE * g / np.sqrt(history)
        s = np.sort(z @ w)
        below = int(round((~good).mean() * len(s)))
        below = min(max(below, 1), len(s) - 1)
        return cls(mean, spread, w, float((s[below - 1] + s[below]) / 2))


def fit(rows: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", most: int = LABELLED) -> Ranking:
    """Fit to the labelled rows of (id, f) that are not held out, at most about ``most``."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    known = known.groupBy(F.col(key).alias("label_id")).agg((F.avg(label) >= 0.5).alias("good"))
    n = known.count()
    part = min(1.0, most / max(n, 1))
    picked = known.where(F.pmod(F.xxhash64("label_id"), F.lit(1_000_000)) < int(part * 1_000_000))
    # rows that share an id count once, or they could outgrow the bound
    table = picked.join(rows.groupBy("id").agg(F.min("f").alias("f")), F.col("label_id") == F.col("id")).select("id", "f", "good").toPandas()
    table = table.sort_values("id", kind="stable")
    if not len(table):
        k = len(FEATURES)
        return Ranking(np.zeros(k), np.ones(k), np.zeros(k), 0.0)
    return Ranking.fit(np.array(table["f"].tolist()), table["good"].to_numpy(bool))


def score(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = LABELLED) -> DataFrame:
    """(key, held_out, score, predicted) of every row."""
    rows = stage(feature_rows(df, key, text), "rank-features")
    ranking = fit(rows, labels, key, label, most)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames):
            x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
            s = 1 / (1 + np.exp(-np.clip(ranking.margin(x), -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["id", "score"])

    scored = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return scored.select(
        F.col("id").alias(key),
        held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
