"""The gate chain: score against threshold, first filter decides."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog
from ..catalog import Recogniser, Rule
from ..config import ScreeningPolicy
from ..functions.text import _col, any_match, is_filtered_marker, strip
from . import pii, rules, scores

# Gate names, the fixed injection bound and the score of an injection label.
BANNED_WORDS = "Banned_Words"
TOXICITY = "Toxicity_Score"
PII = "Personable_Interifiable_Information"
INJECTION = "Prompt_Injection"
OVERALL = "Overall_Score"
HALLUCINATION = "Hallucination"
INPUT_GATES = (BANNED_WORDS, TOXICITY, PII, INJECTION, OVERALL)
COMPAT_INJECTION_BOUND = 0.99
COMPAT_INJECTION_SCORE = 99999.0

FILTER, FLAG, PASS = "filter", "flag", "pass"


def decide_action(
    score: Column | str,
    threshold: Column | float,
    gate: str,
    policy: ScreeningPolicy,
    filter_below: bool = False,
) -> Column:
    """Null when switched off, else ``filter``, ``flag`` or ``pass``; both bounds are strict.

    ``filter_below`` turns the first test round, for scores where low is bad.
    """
    s = _col(score)
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    over = s < limit if filter_below else s > limit
    out = F.when(limit < 0, F.lit(None).cast("string")).when(over, FILTER)
    if policy.enable_reword and gate != HALLUCINATION:
        out = out.when(s > limit * F.lit(policy.reword_factor), FLAG)
    return out.otherwise(PASS)


def overall_score(banned: Column, toxicity: Column, pii_count: Column, p: ScreeningPolicy) -> Column:
    """Weighted score; the evaluation order is part of the definition."""
    base = 1 + (banned * p.weight_banned_word + pii_count * p.weight_pii)
    return base * ((1 + toxicity) * p.weight_toxicity)


def overall_threshold(
    banned: Column, toxicity: Column, pii_count: Column, p: ScreeningPolicy
) -> Column:
    return p.weight_overall * ((1 + (banned + pii_count)) * (1 + toxicity))


def with_scores(
    df: DataFrame,
    policy: ScreeningPolicy,
    rule_list: Sequence[Rule] | None = None,
    recognisers: Sequence[Recogniser] = catalog.RECOGNISERS,
    text: str = "text",
    toxicity: Column | None = None,
    injection: Column | None = None,
) -> DataFrame:
    """Add ``banned_words``, ``toxicity``, ``pii_count`` and ``injection``.

    A gate that is off gives 0 and costs nothing.  ``toxicity`` and ``injection`` take the
    place of the native scorers (a column of scores that is already there).
    """
    chosen = catalog.select_languages(
        catalog.default_rules() if rule_list is None else rule_list, policy.languages
    )
    zero = F.lit(0.0)
    use_rules = policy.banned_word_tolerance >= 0
    use_toxicity = policy.threshold_toxicity > 0
    use_injection = policy.mode == "compat" or policy.threshold_injection >= 0
    # one pass tells the texts with any word of interest; only they meet the single patterns
    watched = [(r.pattern, r.starts) for r in chosen] if use_rules else []
    if use_toxicity and toxicity is None:
        watched += [(p.pattern, p.starts) for p in catalog.TOXIC_TERMS]
    if use_injection and injection is None:
        watched += [(p.pattern, p.starts) for p in catalog.INJECTION_CUES]
    # patterns that match in their own case are found regardless of case too
    hit = any_match(text, watched) if watched else F.lit(False)
    guarded = df.withColumn("_hit", hit)
    guard = F.col("_hit")

    banned, personal, toxic, inject = F.lit(0), F.lit(0), zero, zero
    if use_rules:
        banned = rules.detection_count(text, chosen, policy.case_insensitive, guard=guard)
    if use_toxicity:
        toxic = scores.score_toxicity(text, guard=guard) if toxicity is None else toxicity
    if policy.threshold_pii >= 0:
        found = F.col("entities") if "entities" in df.columns else pii.entities(text, recognisers)
        personal = pii.count_pii(found, policy.pii_labels)
    if use_injection:
        inject = scores.score_injection(text, guard=guard) if injection is None else injection
    return guarded.withColumns(
        {
            "banned_words": banned.cast("int"),
            "toxicity": F.coalesce(toxic, zero),
            "pii_count": personal.cast("int"),
            "injection": F.coalesce(inject, zero),
        }
    ).drop("_hit")


def gate_table(
    policy: ScreeningPolicy, used: dict[str, Column] | None = None
) -> dict[str, tuple[Column, Column]]:
    """Score and threshold of each input gate over the columns of :func:`with_scores`."""
    names = ("banned_words", "toxicity", "pii_count", "injection")
    b, t, p, i = (F.col(n) if used is None else used[n] for n in names)
    toxicity_limit = policy.threshold_toxicity if policy.threshold_toxicity > 0 else -1.0
    if policy.mode == "compat":
        is_injection = i > catalog.INJECTION_LABEL_ABOVE
        inject = F.when(is_injection, COMPAT_INJECTION_SCORE).otherwise(0.0)
        inject_limit = COMPAT_INJECTION_BOUND
    else:
        inject, inject_limit = i, policy.threshold_injection
    return {
        BANNED_WORDS: (b.cast("double"), F.lit(float(policy.banned_word_tolerance))),
        TOXICITY: (t, F.lit(float(toxicity_limit))),
        PII: (p.cast("double"), F.lit(float(policy.threshold_pii))),
        INJECTION: (inject, F.lit(float(inject_limit))),
        OVERALL: (overall_score(b, t, p, policy), overall_threshold(b, t, p, policy)),
    }


def decision_reason(gate: Column | str, score: Column | str, threshold: Column | str) -> Column:
    """Text of a filter decision; counts are whole numbers, the rest has six decimals."""
    name, s, limit = _col(gate), _col(score), _col(threshold)
    whole = name.isin(BANNED_WORDS, PII)
    sign = F.when(name == HALLUCINATION, "<").otherwise(">")
    return F.when(
        whole,
        F.concat(
            F.lit("Filtered due to "), name, F.lit(", "), s.cast("long").cast("string"),
            F.lit(" > "), limit.cast("long").cast("string"),
        ),
    ).otherwise(
        F.concat(
            F.lit("Filtered due to "), name, F.lit(", "), F.format_string("%.6f", s),
            F.lit(" "), sign, F.lit(" "), F.format_string("%.6f", limit),
        )
    )


def _decision(gates: Sequence[str], states: dict[str, Column], table) -> dict[str, Column]:
    def pick(kind: str) -> list[Column]:
        return [
            F.when(
                states[g] == kind,
                F.struct(
                    F.lit(kind).alias("action"), F.lit(g).alias("gate"),
                    table[g][0].alias("score"), table[g][1].alias("threshold"),
                ),
            )
            for g in gates
        ]

    nothing = F.struct(
        F.lit(PASS).alias("action"),
        F.lit(None).cast("string").alias("gate"),
        F.lit(None).cast("double").alias("score"),
        F.lit(None).cast("double").alias("threshold"),
    )
    # a filter anywhere beats a flag; within a kind the earliest gate counts
    return {"decision": F.coalesce(*pick(FILTER), *pick(FLAG), nothing)}


def decide(
    df: DataFrame, policy: ScreeningPolicy, gates: Sequence[str] = INPUT_GATES
) -> DataFrame:
    """Add ``action``, ``gate``, ``score``, ``threshold`` and ``reason`` to scored rows.

    ``gates`` is the order of the chain: the first gate that filters is the one reported.
    """
    table = gate_table(policy)
    states = {g: decide_action(*table[g], g, policy) for g in gates}
    out = df.withColumns(_decision(gates, states, table))
    out = out.withColumns(
        {k: F.col("decision")[k] for k in ("action", "gate", "score", "threshold")}
    ).drop("decision")
    return out.withColumn(
        "reason",
        F.when(F.col("action") == FILTER, decision_reason("gate", "score", "threshold")),
    )


def screen_input(
    df: DataFrame,
    policy: ScreeningPolicy | None = None,
    rule_list: Sequence[Rule] | None = None,
    recognisers: Sequence[Recogniser] = catalog.RECOGNISERS,
    text: str = "text",
    gates: Sequence[str] = INPUT_GATES,
) -> DataFrame:
    """Run the whole chain with native scorers: one narrow pass over the rows, no shuffle."""
    policy = policy or ScreeningPolicy()
    return decide(with_scores(df, policy, rule_list, recognisers, text), policy, gates)


def screen_policies(
    df: DataFrame, policies: Sequence[ScreeningPolicy], text: str = "text", **native
) -> DataFrame:
    """Every text under every policy: one row per pair, with ``policy`` and its decision.

    The scores are computed once; policies (a short list in the program) differ in switches,
    thresholds and weights, and must agree on what is scored.
    """
    first = policies[0]
    shared = ("languages", "pii_labels", "case_insensitive")
    for p in policies:
        if any(getattr(p, key) != getattr(first, key) for key in shared):
            raise ValueError(f"policies screened together must agree on {', '.join(shared)}")
    widest = replace(
        first, mode="fixed", banned_word_tolerance=0, threshold_toxicity=1.0, threshold_pii=0,
        threshold_injection=1.0,
    )
    scored = with_scores(df, widest, text=text, **native)
    # a gate that is off counts as 0 under its own policy
    decided = scored.withColumns({f"_d{i}": _under(p) for i, p in enumerate(policies)})
    named = [
        F.struct(F.lit(p.name).alias("policy"), F.col(f"_d{i}").alias("d"))
        for i, p in enumerate(policies)
    ]
    rows = decided.select(*df.columns, F.explode(F.array(*named)).alias("_p"))
    out = rows.select(
        *df.columns,
        F.col("_p.policy").alias("policy"),
        *[F.col(f"_p.d.{k}").alias(k) for k in ("action", "gate", "score", "threshold")],
    )
    reason = decision_reason("gate", "score", "threshold")
    return out.withColumn("reason", F.when(F.col("action") == FILTER, reason))


def _under(policy: ScreeningPolicy) -> Column:
    on = {
        "banned_words": policy.banned_word_tolerance >= 0,
        "toxicity": policy.threshold_toxicity > 0,
        "pii_count": policy.threshold_pii >= 0,
        "injection": policy.mode == "compat" or policy.threshold_injection >= 0,
    }
    used = {k: F.col(k) if v else F.lit(0).cast("double") for k, v in on.items()}
    table = gate_table(policy, used)
    states = {g: decide_action(*table[g], g, policy) for g in INPUT_GATES}
    return _decision(INPUT_GATES, states, table)["decision"]


def screen_output(
    df: DataFrame,
    policy: ScreeningPolicy | None = None,
    answer: str = "answer",
    context: str = "context",
    similarity: str = "similarity",
) -> DataFrame:
    """Output gate on a ``similarity`` column; blank context or a filtered answer passes."""
    policy = policy or ScreeningPolicy()
    limit = float(policy.threshold_similarity)
    below = policy.mode == "fixed"
    no_context = F.coalesce(strip(context), F.lit("")) == ""
    state = decide_action(similarity, limit, HALLUCINATION, policy, filter_below=below)
    action = (
        F.when(is_filtered_marker(answer) | no_context, PASS)
        .otherwise(F.coalesce(state, F.lit(PASS)))
    )
    out = df.withColumn("action", action)
    filtered = F.col("action") == FILTER
    sign_gate = F.lit(HALLUCINATION)
    reason = decision_reason(sign_gate, similarity, F.lit(limit))
    if not below:
        reason = F.replace(reason, F.lit(" < "), F.lit(" > "))
    return out.withColumns(
        {
            "gate": F.when(filtered, HALLUCINATION),
            "score": F.when(filtered, F.col(similarity)),
            "threshold": F.when(filtered, F.lit(limit)),
            "reason": F.when(filtered, reason),
        }
    )


def gate_funnel(decisions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Texts per action and deciding gate."""
    return decisions.groupBy(*by, "action", F.coalesce("gate", F.lit("none")).alias("gate")).agg(
        F.count(F.lit(1)).alias("texts")
    )
