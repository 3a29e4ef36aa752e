"""Vector and similarity expressions, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, let, tokens


def softmax(logits: Column | str) -> Column:
    """Class probabilities that sum to one; the maximum is taken off first for range."""
    values = _col(logits).cast("array<double>")
    powers = F.transform(values, lambda x: F.exp(x - F.array_max(values)))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def sigmoid(logits: Column | str) -> Column:
    """Independent probability of each label."""
    values = _col(logits).cast("array<double>")
    return F.transform(values, lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x)))


def max_probability(logits: Column | str, kind: str = "softmax") -> Column:
    """Largest class probability of a row of logits."""
    if kind not in ("softmax", "sigmoid"):
        raise ValueError(f"kind must be softmax or sigmoid, found {kind!r}")
    values = _col(logits).cast("array<double>")
    top = F.array_max(values)
    if kind == "sigmoid":
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-top))
    # the largest softmax term is exp(0) / sum
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.lit(1.0) / total


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(
        _col(a).cast("array<double>"), _col(b).cast("array<double>"), lambda x, y: x * y
    )
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    values = _col(a).cast("array<double>")
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + x * x))


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """Cosine of two dense vectors; a zero vector is similar to nothing (0)."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def sparse_cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of the word counts of two texts in the same row, without a shuffle."""
    return token_cosine(F.sort_array(tokens(a)), F.sort_array(tokens(b)))


def token_cosine(a: Column, b: Column) -> Column:
    """As :func:`sparse_cosine`, for arrays of words that are already there.

    The two arrays are tagged, put together and sorted, so equal words stand side by side; one
    walk then yields the dot product and both norms as whole numbers (exact in any order).
    """

    def tag(left: int, right: int):
        return lambda t: F.struct(
            t.alias("t"), F.lit(left).cast("long").alias("l"), F.lit(right).cast("long").alias("r")
        )

    both = F.sort_array(F.concat(F.transform(a, tag(1, 0)), F.transform(b, tag(0, 1))))
    zero = F.lit(0).cast("long")

    def state(t, left, right, d, n1, n2):
        return F.struct(
            t.alias("t"), left.alias("l"), right.alias("r"),
            d.alias("d"), n1.alias("n1"), n2.alias("n2"),
        )

    def step(acc: Column, x: Column) -> Column:
        same = acc["t"] == x["t"]
        return F.when(
            same,
            state(acc["t"], acc["l"] + x["l"], acc["r"] + x["r"], acc["d"], acc["n1"], acc["n2"]),
        ).otherwise(
            state(
                x["t"], x["l"], x["r"],
                acc["d"] + acc["l"] * acc["r"],
                acc["n1"] + acc["l"] * acc["l"],
                acc["n2"] + acc["r"] * acc["r"],
            )
        )

    def finish(acc: Column) -> Column:
        d = acc["d"] + acc["l"] * acc["r"]
        n1 = acc["n1"] + acc["l"] * acc["l"]
        n2 = acc["n2"] + acc["r"] * acc["r"]
        size = F.sqrt(n1.cast("double")) * F.sqrt(n2.cast("double"))
        return F.when(size > 0, d.cast("double") / size).otherwise(0.0)

    # words hold letters and digits only, so the empty start word equals none of them
    start = state(F.lit(""), zero, zero, zero, zero, zero)
    return F.aggregate(both, start, step, finish)


def unit_length(values: Column) -> Column:
    """A vector of doubles at length 1; a zero vector stays."""
    return let(
        F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + x * x)),
        lambda size: F.when(size > 0, F.transform(values, lambda x: x / size)).otherwise(values),
    )


def hash_counts(c: Column | str, dims: int = 64) -> Column:
    """Word counts folded into ``dims`` slots by a hash of the word.

    A model-free embedding with a fixed definition (md5 of the word), so any engine can check it.
    """
    slots = F.transform(
        tokens(c),
        lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 6), 16, 10).cast("int"), F.lit(dims)),
    )

    def count(found: Column) -> Column:
        # what removing a slot takes away; this loop runs in compiled code, a filter would not
        return F.transform(
            F.sequence(F.lit(0), F.lit(dims - 1)),
            lambda d: (F.size(found) - F.size(F.array_remove(found, d))).cast("double"),
        )

    return let(slots, count)


def hash_embedding(c: Column | str, dims: int = 64) -> Column:
    """The counts of :func:`hash_counts` at unit length."""
    return let(hash_counts(c, dims), unit_length)
