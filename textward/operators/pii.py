"""Personal data: entities with offsets, counts, redaction."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog
from ..catalog import Recogniser
from ..config import ScreeningPolicy
from ..functions.checks import CHECKS
from ..functions.text import (
    SPAN_TYPE,
    _col,
    any_match,
    exploded,
    find_all,
    find_spans,
    hit_ends,
    let,
    unicode_pattern,
)


_DIGITS = "0123456789"


def _none() -> Column:
    return F.array().cast(SPAN_TYPE)


def _looks_first(item: Recogniser) -> str:
    """The whole pattern, with a look at its first characters before any word boundary.

    A Unicode boundary costs far more than a character, so most positions are left at the look.
    """
    whole = (item.lead or "") + item.pattern
    if item.starts:
        return "(?=[" + re.sub(r"([^A-Za-z0-9])", r"\\\1", item.starts) + "])" + whole
    return whole


def candidate_spans(text: Column | str, recognisers: Sequence[Recogniser]) -> Column:
    """Hits of every recogniser, overlaps included."""
    value = _col(text)

    def hits(item: Recogniser, numeric_hit: Column) -> Column:
        pattern = _looks_first(item)

        def values(found: Column) -> Column:
            """Values of the hits without their lead; null where the check fails."""
            if not item.lead and not item.check:
                return found
            lead = unicode_pattern("^" + item.lead, case_insensitive=False) if item.lead else None

            def tested(hit: Column) -> Column:
                v = F.regexp_replace(hit, lead, "") if lead else hit
                return v if not item.check else let(v, lambda x: F.when(CHECKS[item.check](x), x))

            return F.transform(found, tested)

        def placed(proved: Column) -> Column:
            # most hits of a checked pattern fail: their places are not looked for
            some = F.exists(proved, lambda v: v.isNotNull())
            return F.when(
                some,
                F.struct(
                    F.lit(item.label).alias("label"),
                    proved.alias("values"),
                    hit_ends(value, pattern).alias("parts"),
                ),
            )

        found = find_all(value, unicode_pattern(pattern, case_insensitive=False))
        row = let(found, lambda f: F.when(F.size(f) > 0, let(values(f), placed)))
        # CASE WHEN is lazy for native expressions: without its guard a pattern is not run
        if item.guard is not None:
            return F.when(value.contains(item.guard), row)
        return F.when(numeric_hit, row) if item.digit_led else row

    def located(numeric_hit: Column) -> Column:
        rows = F.array(*[hits(item, numeric_hit) for item in recognisers])
        # most texts hold no entity: they need neither places nor fold
        return find_spans(F.filter(rows, lambda r: r.isNotNull()))

    if not recognisers:
        return _none()
    numeric = [
        ((r.lead or "") + r.pattern, None if r.lead else _DIGITS)
        for r in recognisers
        if r.digit_led and r.guard is None
    ]
    numeric_hit = any_match(value, numeric, case_insensitive=False) if numeric else F.lit(False)
    return let(numeric_hit, located)


def resolve_overlaps(entities: Column | str, order: Sequence[str] = ()) -> Column:
    """Sort by start and drop overlaps: leftmost first, then longest, then catalogue order."""
    labels = F.array(*[F.lit(x) for x in order]) if order else F.array().cast("array<string>")

    def key(s: Column) -> Column:
        return F.struct(
            s["start"].alias("start"),
            (-s["end"]).alias("neg_end"),
            F.array_position(labels, s["label"]).alias("place"),
            s.alias("span"),
        )

    def step(acc: Column, k: Column) -> Column:
        s = k["span"]
        return F.when(
            s["start"] >= acc["pos"],
            F.struct(
                s["end"].alias("pos"),
                F.concat(acc["out"], F.array(s)).cast(SPAN_TYPE).alias("out"),
            ),
        ).otherwise(acc)

    def resolve(spans: Column) -> Column:
        start = F.struct(F.lit(0).alias("pos"), _none().alias("out"))
        ordered = F.sort_array(F.transform(spans, key))
        kept = F.aggregate(ordered, start, step, lambda acc: acc["out"])
        return F.when(F.size(spans) > 1, kept).otherwise(spans)

    return let(_col(entities), resolve)


def entities(
    text: Column | str, recognisers: Sequence[Recogniser] = catalog.RECOGNISERS
) -> Column:
    """Entities of a text, sorted by start and free of overlaps; null text has none."""
    value = _col(text)
    found = resolve_overlaps(
        candidate_spans(value, recognisers), [r.label for r in recognisers]
    )
    return F.when(value.isNull(), _none()).otherwise(found)


def count_pii(found: Column | str, labels: Sequence[str] = catalog.PII_LABELS) -> Column:
    """Entities whose label is in the set."""
    return F.size(F.filter(_col(found), lambda e: e["label"].isin(*labels)))


#: Characters of a block of a long text.
_BLOCK = 4096


def redact_entities(
    text: Column | str,
    found: Column | str,
    redact_person: bool = True,
    redact_location: bool = True,
    redact_other: bool = True,
) -> Column:
    """Put ``[REDACTED_<LABEL>]`` in place of the entities of the chosen groups.

    The output is built from pieces of the original text, so offsets never shift.
    """
    value = _col(text)
    wanted = [
        g
        for g, on in (("person", redact_person), ("location", redact_location))
        if on
    ]

    def keep(e: Column) -> Column:
        special = e["label"].isin("person", "location")
        return F.when(special, e["label"].isin(*wanted) if wanted else F.lit(False)).otherwise(
            F.lit(redact_other)
        )

    # a span is cut from the blocks it touches: looking for its start from the beginning of a
    # long text would make the work grow with hits times length
    last = F.floor(F.greatest(F.length(value) - 1, F.lit(0)) / _BLOCK).cast("int")
    in_blocks = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.substring(value, i * _BLOCK + 1, F.lit(_BLOCK))
    )

    def piece(blocks: Column, begin: Column, end: Column) -> Column:
        first = F.floor(begin / _BLOCK).cast("int")
        upto = F.floor(F.greatest(end - 1, begin) / _BLOCK).cast("int")
        near = F.array_join(F.slice(blocks, first + 1, upto - first + 1), "")
        return F.substring(near, begin - first * _BLOCK + 1, end - begin)

    def build(spans: Column) -> Column:
        begins = F.concat(F.array(F.lit(0)), F.transform(spans, lambda e: e["end"]))
        pairs = F.arrays_zip(F.slice(begins, 1, F.size(spans)).alias("prev"), spans.alias("e"))

        def joined(blocks: Column) -> Column:
            pieces = F.transform(
                pairs,
                lambda p: F.concat(
                    piece(blocks, p["prev"], p["e"]["start"]),
                    F.lit("[REDACTED_"),
                    F.upper(p["e"]["label"]),
                    F.lit("]"),
                ),
            )
            tail = piece(blocks, F.element_at(begins, -1), F.length(value))
            return F.concat(F.array_join(pieces, ""), tail)

        return F.when(F.size(spans) > 0, let(in_blocks, joined)).otherwise(value)

    chosen = F.coalesce(F.filter(resolve_overlaps(found), keep), _none())
    return let(chosen, build)


def redact_regex(text: Column | str) -> Column:
    """Email addresses, then local mobile numbers."""
    value = _col(text)
    out = value
    steps = zip(catalog.REGEX_REDACTIONS, catalog.REGEX_REDACTION_GUARDS, strict=True)
    for (pattern, replacement), guard in steps:
        # a replacement brings in no guard, so the guards look at the text as it came
        changed = F.regexp_replace(out, pattern, replacement)
        out = F.when(value.contains(guard), changed).otherwise(out)
    return out


def detect_pii(
    df: DataFrame,
    recognisers: Sequence[Recogniser] = catalog.RECOGNISERS,
    text: str = "text",
) -> DataFrame:
    """Add ``entities``."""
    return df.withColumn("entities", entities(text, recognisers))


def analyze_pii(
    df: DataFrame,
    redact_person: bool = True,
    redact_location: bool = True,
    redact_other: bool = True,
    recognisers: Sequence[Recogniser] = catalog.RECOGNISERS,
    labels: Sequence[str] = catalog.PII_LABELS,
    text: str = "text",
) -> DataFrame:
    """Add ``entities``, ``pii_count`` and ``redacted_text``.

    The count is taken before the replacement patterns run, so their hits do not count.  With an
    ``entities`` column already there (from a model, say) that one is used.
    """
    found = df if "entities" in df.columns else detect_pii(df, recognisers, text)
    redacted = redact_entities(
        text, "entities", redact_person, redact_location, redact_other
    )
    return found.withColumns(
        {"pii_count": count_pii("entities", labels), "redacted_text": redact_regex(redacted)}
    )


def redact_by_policy(df: DataFrame, policy: ScreeningPolicy, text: str = "text") -> DataFrame:
    """As :func:`analyze_pii`, with the switches and labels of a policy."""
    return analyze_pii(
        df,
        policy.redact_person,
        policy.redact_location,
        policy.redact_other,
        labels=policy.pii_labels,
        text=text,
    )


def entity_rows(df: DataFrame, *keys: str) -> DataFrame:
    """One row per entity: keys, ``entity_no`` (from 0), label, text, start, end, score."""
    return exploded(df, keys, "entities", "entity_no", "e").select(
        *keys,
        "entity_no",
        F.col("e.label").alias("label"),
        F.col("e.text").alias("entity"),
        F.col("e.start").alias("start"),
        F.col("e.end").alias("end"),
        F.col("e.score").alias("score"),
    )


def _has(label: str):
    return lambda e: e["label"] == label


def pii_by_label(df: DataFrame, labels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Entities and texts with an entity for each label, from an ``entities`` column.

    Entities of one text are counted in the row and summed, one column per label, so texts need
    no distinct count and only the sums become rows.
    """
    numbers = [
        F.size(F.filter("entities", _has(label))).alias(f"_n{i}")
        for i, label in enumerate(labels)
    ]
    sums = []
    for i in range(len(labels)):
        found = F.coalesce(F.sum(f"_n{i}"), F.lit(0)).cast("long")
        sums += [found.alias(f"_e{i}"), F.count_if(F.col(f"_n{i}") > 0).alias(f"_t{i}")]
    each = [
        F.struct(
            F.lit(label).alias("label"),
            F.col(f"_e{i}").alias("entities"),
            F.col(f"_t{i}").alias("texts"),
        )
        for i, label in enumerate(labels)
    ]
    return df.select(*by, *numbers).groupBy(*by).agg(*sums).select(*by, F.inline(F.array(*each)))
