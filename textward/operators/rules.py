"""Rule hits of language packs and the policy that follows from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog
from ..catalog import Rule
from ..functions.text import _col, any_match, exploded, find_all, unicode_pattern
from ..schemas import DETECTIONS


def _applies(rule: Rule, lang: Column | None) -> Column | None:
    return None if lang is None else lang == catalog.LANGUAGE_CODES.get(rule.language, rule.language)


def rule_hits(
    text: Column | str, rule: Rule, case_insensitive: bool = True, lang: Column | None = None
) -> Column:
    """Matched strings of one rule; with ``lang`` only where the row has the pack's language."""
    hits = find_all(text, unicode_pattern(rule.pattern, case_insensitive))
    applies = _applies(rule, lang)
    if applies is None:
        return hits
    return F.when(applies, hits).otherwise(F.array().cast("array<string>"))


def detections(
    text: Column | str,
    rules: Sequence[Rule],
    case_insensitive: bool = True,
    lang: Column | None = None,
) -> Column:
    """Hits of all rules: by language, then rule, then position in the text."""
    def hits(rule: Rule) -> Column:
        return F.transform(
            rule_hits(text, rule, case_insensitive, lang),
            lambda m: F.struct(
                F.lit(rule.language).alias("language"),
                F.lit(rule.rule).alias("rule"),
                m.alias("match"),
            ),
        )

    empty = F.array().cast(DETECTIONS)
    if not rules:
        return empty
    found = F.concat(empty, *[hits(rule) for rule in rules])
    return F.when(has_rule_hit(text, rules, case_insensitive), found).otherwise(empty)


def has_rule_hit(
    text: Column | str, rules: Sequence[Rule], case_insensitive: bool = True
) -> Column:
    """True where any rule has a hit."""
    return any_match(text, [(r.pattern, r.starts) for r in rules], case_insensitive)


def detection_count(
    text: Column | str,
    rules: Sequence[Rule],
    case_insensitive: bool = True,
    lang: Column | None = None,
    guard: Column | None = None,
) -> Column:
    """Number of hits of all rules, without building them.

    ``guard`` tells texts that can have a hit; by default one pass over the text finds out.
    """
    counts = []
    for rule in rules:
        n = F.coalesce(
            F.regexp_count(_col(text), F.lit(unicode_pattern(rule.pattern, case_insensitive))),
            F.lit(0),
        )
        applies = _applies(rule, lang)
        counts.append(n if applies is None else F.when(applies, n).otherwise(0))
    if not rules:
        return F.lit(0)
    guard = has_rule_hit(text, rules, case_insensitive) if guard is None else guard
    return F.when(guard, reduce(lambda a, b: a + b, counts)).otherwise(0)


def actions(found: Column | str, policies: Mapping[str, str] = catalog.POLICIES) -> Column:
    """Action of each hit, in order and with repeats; rules without a policy give none."""
    if not policies:
        return F.array().cast("array<string>")
    pairs = [F.lit(x) for kv in policies.items() for x in kv]
    table = F.create_map(*pairs)
    return F.filter(
        F.transform(_col(found), lambda d: F.try_element_at(table, d["rule"])),
        lambda a: a.isNotNull(),
    )


def detect_rules(
    df: DataFrame,
    rules: Sequence[Rule] | None = None,
    text: str = "text",
    case_insensitive: bool = True,
    lang: str | None = None,
) -> DataFrame:
    """Add ``detections``."""
    rules = catalog.default_rules() if rules is None else rules
    language = None if lang is None else F.col(lang)
    return df.withColumn("detections", detections(text, rules, case_insensitive, language))


def apply_policies(df: DataFrame, policies: Mapping[str, str] = catalog.POLICIES) -> DataFrame:
    """Add ``actions`` for the ``detections`` of each row."""
    return df.withColumn("actions", actions("detections", policies))


def analyze_prompt(
    df: DataFrame,
    rules: Sequence[Rule] | None = None,
    text: str = "text",
    policies: Mapping[str, str] = catalog.POLICIES,
    case_insensitive: bool = True,
    lang: str | None = None,
) -> DataFrame:
    """Add ``detections``, ``actions`` and ``is_safe`` (no action at all)."""
    found = apply_policies(detect_rules(df, rules, text, case_insensitive, lang), policies)
    return found.withColumn("is_safe", F.size("actions") == 0)


def detection_rows(df: DataFrame, *keys: str) -> DataFrame:
    """One row per hit: keys, ``hit_no`` (from 0), language, rule, match."""
    return exploded(df, keys, "detections", "hit_no", "d").select(
        *keys, "hit_no", "d.language", "d.rule", "d.match"
    )


def detections_by_rule(
    df: DataFrame,
    rules: Sequence[Rule],
    text: str = "text",
    case_insensitive: bool = True,
    by: Sequence[str] = (),
) -> DataFrame:
    """Hits and texts with a hit for each rule, over the whole input.

    One row is one text, so the number of texts needs no distinct count: hits are counted in
    the row and summed, one column per rule, and only the sums become rows.
    """
    guarded = df.withColumn("_hit", has_rule_hit(text, rules, case_insensitive))
    numbers = [
        detection_count(text, [r], case_insensitive, guard=F.col("_hit")).alias(f"_n{i}")
        for i, r in enumerate(rules)
    ]
    sums = []
    for i in range(len(rules)):
        hits = F.coalesce(F.sum(f"_n{i}"), F.lit(0)).cast("long")
        sums += [hits.alias(f"_h{i}"), F.count_if(F.col(f"_n{i}") > 0).alias(f"_t{i}")]
    each = [
        F.struct(
            F.lit(r.language).alias("language"),
            F.lit(r.rule).alias("rule"),
            F.col(f"_h{i}").alias("hits"),
            F.col(f"_t{i}").alias("texts"),
        )
        for i, r in enumerate(rules)
    ]
    summed = guarded.select(*by, *numbers).groupBy(*by).agg(*sums)
    return summed.select(*by, F.inline(F.array(*each)))
