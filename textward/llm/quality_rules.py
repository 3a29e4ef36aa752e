"""Quality rules as a bitmask ledger (native expressions only).

Every rule is evaluated once per document.  The ledger keeps one bit per failed rule and the
measurements behind it; policies are versioned selections of bits that are applied to the
ledger later, and ablations are counts over masks, so neither reads a text again.

Cases: a null or empty text has no words and fails the length rule; a null in another column
changes nothing; repeated rows get the same ledger; an empty table gives an empty ledger.
Columns of the input that share a name with a measurement are replaced by it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import word_array

WINDOW = 8
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A failure test over measurements; ``bit`` is its place in the ledger and never changes."""

    bit: int
    name: str
    failed: Callable[[Callable[[str], Column]], Column]


#: Bits are append-only: a policy of an older version keeps its meaning.
RULES: tuple[Rule, ...] = (
    Rule(0, "too_few_words", lambda m: m("n_words") < 20),
    Rule(1, "repeated_windows", lambda m: 100 * m("n_repeat_words") > 30 * m("n_words")),
    Rule(2, "symbols", lambda m: 10 * m("n_symbols") > 3 * m("n_words")),
    Rule(3, "repeated_lines", lambda m: 2 * m("n_dup_lines") > m("n_lines")),
    Rule(4, "long_words", lambda m: m("word_chars") > 20 * m("n_words")),
    Rule(5, "short_words", lambda m: m("word_chars") < 2 * m("n_words")),
    Rule(6, "shouting", lambda m: 2 * m("n_upper") > m("word_chars")),
    Rule(7, "exclamations", lambda m: 10 * m("n_marks") > 3 * m("n_words")),
    Rule(8, "stutter", lambda m: 3 * m("n_stutter") > m("n_words")),
)


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules; a document is kept if it fails fewer than ``limit`` of them."""

    name: str
    version: int
    rules: tuple[str, ...]
    limit: int = 1

    @property
    def mask(self) -> int:
        bits = {r.name: r.bit for r in RULES}
        return sum(1 << bits[n] for n in self.rules)


BASE = Policy("base", 1, ("too_few_words", "repeated_windows"))
DEFAULT = Policy(
    "corpus",
    1,
    (
        "too_few_words",
        "repeated_windows",
        "symbols",
        "long_words",
        "shouting",
        "exclamations",
        "stutter",
    ),
)


def _repeat_words(words: Column) -> Column:
    """Words inside windows of eight that occur at least twice in the text.

    Windows are compared by a hash over the hashes of their words.  Texts without a repeated
    window leave after one distinct; the others sort (hash, place) pairs, so the work is
    n log n for any text.
    """
    none = F.array().cast("array<bigint>")

    def windows(h: Column) -> Column:
        ends = F.sequence(F.lit(0), F.size(h) - WINDOW)
        keys = F.transform(ends, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
        return F.when(F.size(h) >= WINDOW, keys).otherwise(none)

    def covered(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda e, j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
            hits = F.filter(s, lambda e, j: same(e, j - 1) | same(e, j + 1))
            return F.sort_array(F.transform(hits, lambda e: e["i"]))

        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda acc, i: F.struct(
            (acc["n"] + i + WINDOW - F.greatest(acc["end"], i)).cast("int").alias("n"),
            (i + WINDOW).cast("int").alias("end"),
        )
        return F.aggregate(let(pairs, twice), start, step, lambda acc: acc["n"])

    hashes = F.transform(words, lambda x: F.xxhash64(x))
    return let(
        let(hashes, windows),
        lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)),
    )


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurements of every text: counts as bigint."""
    body = F.coalesce(F.col(text), F.lit(""))

    def line_counts(lines: Column) -> Column:
        return F.struct(
            F.size(lines).alias("n"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("d")
        )

    def mark_counts(m: Column) -> Column:
        upper = F.length(F.regexp_replace(m, "[^A-Z]+", ""))
        bangs = F.length(m) - F.length(F.replace(m, F.lit("!"), F.lit("")))
        return F.struct(
            upper.alias("u"), bangs.alias("b"), (F.length(m) - upper - bangs).alias("s")
        )

    with_word = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    word_facts = let(
        word_array(F.col(text)),
        lambda w: F.struct(
            F.size(w).alias("n"),
            F.length(F.array_join(w, "")).alias("v"),
            F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))).alias("k"),
            _repeat_words(w).alias("r"),
        ),
    )
    # one pass leaves the few characters that are counted
    marks = F.regexp_replace(body, rf"[^{SYMBOLS}A-Z!]+", "")
    facts = F.struct(
        word_facts.alias("w"),
        let(with_word, line_counts).alias("l"),
        let(marks, mark_counts).alias("m"),
    )
    named = {
        "n_words": lambda f: f["w"]["n"],
        "word_chars": lambda f: f["w"]["v"],
        "n_symbols": lambda f: f["m"]["s"],
        "n_lines": lambda f: f["l"]["n"],
        "n_dup_lines": lambda f: f["l"]["d"],
        "n_repeat_words": lambda f: f["w"]["r"],
        "n_stutter": lambda f: f["w"]["k"],
        "n_upper": lambda f: f["m"]["u"],
        "n_marks": lambda f: f["m"]["b"],
    }
    row = let(facts, lambda f: F.struct(*[g(f).cast("bigint").alias(n) for n, g in named.items()]))
    holder = "measured__"
    rows = df.withColumn(holder, row)
    return rows.withColumns({n: F.col(holder)[n] for n in named}).drop(holder)


def ledger(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add measurements and ``failures``, the mask of failed rules."""
    bit = lambda r: F.when(r.failed(F.col), F.lit(1 << r.bit)).otherwise(0)
    mask = bit(rules[0])
    for rule in rules[1:]:
        mask = mask.bitwiseOR(bit(rule))
    return measure(df, text).withColumn("failures", mask.cast("bigint"))


def passes(policy: Policy, failures: Column | None = None) -> Column:
    """True where a policy keeps the document of a ledger row."""
    mask = F.col("failures") if failures is None else failures
    return F.bit_count(mask.bitwiseAND(F.lit(policy.mask))) < policy.limit


def apply_policies(rows: DataFrame, policies: Sequence[Policy]) -> DataFrame:
    """One boolean ``<name>_v<version>`` per policy; only the ledger is read."""
    return rows.withColumns({f"{p.name}_v{p.version}": passes(p) for p in policies})


def ablate(rows: DataFrame, policy: Policy, rules: Sequence[Rule] = RULES) -> DataFrame:
    """For each rule of a policy: documents that fail it, and documents it alone rejects.

    Masks are counted first, so the work behind the shuffle is per distinct mask.
    """
    counts = rows.groupBy("failures").agg(F.count(F.lit(1)).alias("n"))
    enforced = F.col("failures").bitwiseAND(F.lit(policy.mask))
    own = [r for r in rules if r.name in policy.rules]
    each = F.explode(
        F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).alias("bit")) for r in own])
    )
    out = F.bit_count(enforced) >= policy.limit
    spared = F.bit_count(enforced.bitwiseAND(F.bitwise_not(F.col("r.bit").cast("bigint")))) < policy.limit
    hit = enforced.bitwiseAND(F.col("r.bit").cast("bigint")) != 0
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("bigint")
    return (
        counts.select("failures", "n", each.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(total(hit).alias("failed"), total(out & hit & spared).alias("only_this"))
    )


def judge(df: DataFrame, policy: Policy = DEFAULT, text: str = "text") -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` by a policy."""
    return ledger(df, text).withColumns(
        {"base_failed": ~passes(BASE), "kept": passes(BASE) & passes(policy)}
    )
