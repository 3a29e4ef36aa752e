"""Screening policy: switches, thresholds and weights in one frozen record."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import PII_LABELS


@dataclass(frozen=True)
class ScreeningPolicy:
    """All settings of the gate chain.  A negative threshold switches its gate off.

    ``mode`` is ``fixed`` (documented behaviour) or ``compat``: the injection gate then tests
    its label against a fixed bound, and the output gate filters answers *above* its threshold.
    """

    # Defaults of switches, thresholds and weights.
    case_insensitive: bool = True
    redact_person: bool = False
    redact_location: bool = False
    redact_other: bool = False
    enable_context: bool = True
    enable_reword: bool = True
    banned_word_tolerance: int = 3
    threshold_injection: float = 0.5
    threshold_pii: int = 2
    max_context_distance: float | None = None
    threshold_similarity: float = 0.5
    threshold_toxicity: float = 0.9
    weight_banned_word: float = 0.4
    weight_pii: float = 0.4
    weight_toxicity: float = 0.4
    weight_overall: float = 0.8
    reword_factor: float = 0.5
    # Additions
    name: str = "default"
    mode: str = "fixed"
    languages: tuple[str, ...] | None = ("english", "filipino")
    pii_labels: tuple[str, ...] = PII_LABELS

    def __post_init__(self) -> None:
        problems = self.problems()
        if problems:
            raise ValueError("invalid policy: " + "; ".join(problems))

    def problems(self) -> list[str]:
        """Every violated bound."""
        out = []
        if self.mode not in ("fixed", "compat"):
            out.append(f"mode must be fixed or compat, found {self.mode!r}")
        for key in ("banned_word_tolerance", "threshold_pii"):
            value = getattr(self, key)
            if isinstance(value, bool) or not isinstance(value, int):
                out.append(f"{key} must be an integer, found {value!r}")
        for key in _THRESHOLDS:
            if not getattr(self, key) <= 1:
                out.append(f"{key} must not exceed 1, found {getattr(self, key)!r}")
        for key in _FACTORS:
            if not 0 <= getattr(self, key) <= 1:
                out.append(f"{key} must lie in 0..1, found {getattr(self, key)!r}")
        return out


_THRESHOLDS = ("threshold_injection", "threshold_similarity", "threshold_toxicity")
_FACTORS = (
    "weight_banned_word", "weight_pii", "weight_toxicity", "weight_overall", "reword_factor",
)
_NUMBERS = {
    "banned_word_tolerance": "int", "threshold_pii": "int",
    **dict.fromkeys(_THRESHOLDS, "double"), **dict.fromkeys(_FACTORS, "double"),
}


def policies_frame(spark: SparkSession, policies: Sequence[ScreeningPolicy]) -> DataFrame:
    """One row per policy, for reports over many tenants."""
    names = [f.name for f in fields(ScreeningPolicy) if f.name in _NUMBERS]
    ddl = "name string, " + ", ".join(f"{n} {_NUMBERS[n]}" for n in names)
    rows = []
    for policy in policies:
        values = asdict(policy)
        rows.append(
            tuple(
                [policy.name]
                + [float(values[n]) if _NUMBERS[n] == "double" else values[n] for n in names]
            )
        )
    return spark.createDataFrame(rows, ddl)


def policy_problems(df: DataFrame) -> DataFrame:
    """Report of a table of policies: adds ``problems``, the names of the columns out of bounds."""

    def bad(name: str, ok: Column) -> Column:
        return F.when(F.coalesce(~ok, F.lit(True)), F.lit(name))

    checks = [bad(n, F.col(n) <= 1) for n in _THRESHOLDS if n in df.columns]
    checks += [bad(n, F.col(n).between(0, 1)) for n in _FACTORS if n in df.columns]
    checks += [
        bad(n, F.col(n) == F.floor(F.col(n)))
        for n in ("banned_word_tolerance", "threshold_pii")
        if n in df.columns
    ]
    return df.withColumn("problems", F.array_compact(F.array(*checks)))
