"""Text expressions: Column in, Column out, all evaluated in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The published operators behave this way by default.
MIN_CLAIM_CHARS = 10
MIN_CHUNK_CHARS = 50
CHUNK_SEPARATOR = "\n\n"
FENCE = "```"

SPAN_TYPE = "array<struct<text:string,label:string,start:int,end:int,score:double>>"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def exploded(df: DataFrame, keys: Sequence[str], items: Column | str, pos: str, item: str):
    """One row per array item, with its place from 0.

    The outer form and a filter behind it: for the inner form the optimizer adds a size test
    below, which would compute the array a second time.
    """
    rows = df.select(*keys, F.posexplode_outer(items).alias(pos, item))
    return rows.where(F.col(pos).isNotNull())


def unicode_pattern(pattern: str, case_insensitive: bool = True) -> str:
    """Java flags that make a pattern behave as a Unicode text pattern.

    ``U`` makes word boundaries and classes Unicode aware, so an accented letter next to a
    word is part of the word.
    """
    return ("(?iU)" if case_insensitive else "(?U)") + pattern


def strip(c: Column | str) -> Column:
    """Remove all white space at both ends (``trim`` removes blanks only)."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def tokens(c: Column | str) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(r"[\p{L}0-9]+"), F.lit(0))


def find_all(c: Column | str, pattern: str, group: int = 0) -> Column:
    """Every non-overlapping hit from left to right; null text has none."""
    return F.coalesce(
        F.regexp_extract_all(_col(c), F.lit(pattern), F.lit(group)),
        F.array().cast("array<string>"),
    )


# Letters outside ASCII that fold to an ASCII letter in Unicode matching.
_FOLDED = ("\u017f", "\u212a", "\u0131", "\u0130")


def any_match(
    c: Column | str, patterns: Sequence[tuple[str, str | None]], case_insensitive: bool = True
) -> Column:
    """True exactly where at least one of ``(pattern, starts)`` has a hit: one pass for all.

    With the first characters of all patterns known, a look at one character rejects most
    positions before any pattern is tried.
    """
    text = _col(c)
    if any(re.search(r"\\[1-9]|\\k<|\(\?<[A-Za-z]", p) for p, _ in patterns):
        # numbered or named groups keep their meaning only in their own pattern
        alone = F.when(F.lit(False), F.lit(False))
        for p, _ in patterns:
            alone = alone.when(text.rlike(unicode_pattern(p, case_insensitive)), True)
        return alone.otherwise(False)
    bounded = [p[2:] for p, _ in patterns if _opens_with_boundary(p)]
    others = [p for p, _ in patterns if not _opens_with_boundary(p)]
    branches = [r"\b(?:" + "|".join(f"(?:{p})" for p in bounded) + ")"] if bounded else []
    branches += [f"(?:{p})" for p in others]
    union = unicode_pattern("(?:" + "|".join(branches) + ")", case_insensitive)
    starts = "".join(sorted({x for _, s in patterns for x in s or ""}))
    if not all(s and s.isascii() for _, s in patterns):
        return F.coalesce(text.rlike(union), F.lit(False))
    both = "".join(sorted(set(starts.lower() + starts.upper())))
    first = "(?=[" + re.sub(r"([^A-Za-z0-9])", r"\\\1", both) + "])"
    # CASE WHEN, not OR: its branches are lazy, common parts of an OR are computed ahead
    found = F.when(text.rlike(first + union), True)
    if case_insensitive:
        folded = reduce(lambda a, b: a | b, [text.contains(x) for x in _FOLDED])
        found = found.when(folded, text.rlike(union))
    return F.coalesce(found, F.lit(False))


def _opens_with_boundary(pattern: str) -> bool:
    """True if the pattern is a word boundary and one sequence (no ``|`` outside groups)."""
    plain = re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", "", pattern)
    while (inner := re.sub(r"\([^()]*\)", "", plain)) != plain:
        plain = inner
    return pattern.startswith(r"\b") and "|" not in plain


def hit_ends(c: Column | str, pattern: str) -> Column:
    """For each hit of :func:`find_all` the text from the end of the hit before to its own end.

    The pieces follow each other from the start of the text, so their lengths give the places.
    """
    # without the anchor the rest behind the last hit would be searched from each of its characters
    return find_all(c, unicode_pattern(rf"\G(?s:.*?)(?:{pattern})", case_insensitive=False))


def find_spans(found: Column, none: Column | None = None) -> Column:
    """Spans with character offsets for hits of several patterns in one text.

    ``found`` is an array of ``(label, values, parts)``: the parts as :func:`hit_ends` gives them,
    each ending with the value of the same place.  A null value takes its place and gives no span.
    """
    none = F.array().cast(SPAN_TYPE) if none is None else none

    def locate(row: Column) -> Column:
        def step(acc: Column, pair: Column) -> Column:
            value = pair["value"]
            end = (acc["pos"] + F.length(pair["part"])).cast("int")
            span = F.struct(
                value.alias("text"),
                row["label"].alias("label"),
                (end - F.length(value)).cast("int").alias("start"),
                end.alias("end"),
                F.lit(1.0).alias("score"),
            )
            more = F.concat(acc["out"], F.array(span)).cast(SPAN_TYPE)
            return F.struct(
                end.alias("pos"),
                F.when(value.isNull() | end.isNull(), acc["out"]).otherwise(more).alias("out"),
            )

        pairs = F.arrays_zip(row["values"].alias("value"), row["parts"].alias("part"))
        start = F.struct(F.lit(0).alias("pos"), none.alias("out"))
        return F.aggregate(pairs, start, step, lambda acc: acc["out"])

    return F.flatten(F.transform(found, locate))


def chunk_text(
    c: Column | str,
    separator: str = CHUNK_SEPARATOR,
    min_chars: int = MIN_CHUNK_CHARS,
    max_chunks: int | None = None,
) -> Column:
    """Pieces longer than ``min_chars``: all of them, or the first ``max_chunks`` where given."""
    parts = F.filter(
        F.split(_col(c), r"\Q" + separator + r"\E", -1), lambda p: F.length(p) > min_chars
    )
    return parts if max_chunks is None else F.slice(parts, 1, max_chunks)


def content_id(c: Column | str) -> Column:
    """Identity of a chunk: md5 of its UTF-8 text."""
    return F.md5(_col(c))


def extract_claims(c: Column | str, min_chars: int = MIN_CLAIM_CHARS) -> Column:
    """Sentences (cut at runs of ``.!?``), stripped, longer than ``min_chars``."""
    parts = F.transform(F.split(_col(c), "[.!?]+", -1), strip)
    return F.filter(parts, lambda p: F.length(p) > min_chars)


_FENCED = rf"(?ms)^{FENCE}[^\n]*(?:\n(?:{FENCE}|\z)|\n(.*?)(?:\n{FENCE}|\z)|\z)"


def extract_fenced(c: Column | str) -> Column:
    """Lines of the first fenced block; null without a fence, empty for an empty block."""
    text = _col(c)
    return F.when(text.rlike(f"(?m)^{FENCE}"), F.regexp_extract(text, _FENCED, 1))


def is_filtered_marker(c: Column | str) -> Column:
    """True for the text that stands in for a filtered prompt, in any letter case."""
    return F.coalesce(F.lower(_col(c)) == F.lit("filtered."), F.lit(False))


def clean_topic(c: Column | str) -> Column:
    """Topic as named in a reply: without fence characters and outer white space."""
    return strip(F.replace(_col(c), F.lit("`"), F.lit("")))


def valid_topic(c: Column | str) -> Column:
    """A topic is usable with 1 to 50 characters."""
    topic = _col(c)
    return F.coalesce(F.length(topic).between(1, 50), F.lit(False))


def clip(c: Column | str, max_len: int = 200) -> Column:
    """Show at most ``max_len`` characters, then three dots."""
    text = _col(c)
    return F.when(
        F.length(text) > max_len, F.concat(F.substring(text, 1, max_len), F.lit("..."))
    ).otherwise(text)


def list_text_items(c: Column | str) -> Column:
    """Items of a list in text form: ``['a', "b"]`` gives ``[a, b]``."""
    quoted = find_all(c, r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"")
    return F.transform(
        quoted,
        lambda q: F.regexp_replace(
            F.substring(q, F.lit(2), F.length(q) - 2), r"\\(.)", "$1"
        ),
    )


def flatten_list_text(c: Column | str, separator: str = " | ") -> Column:
    """Join the items of a list in text form; no list gives the empty string."""
    return F.array_join(list_text_items(c), separator)
