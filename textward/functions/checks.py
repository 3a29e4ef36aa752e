"""Check digits of identifiers as native expressions: true where the digits are consistent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, let


def _values(c: Column) -> Column:
    """Values of the characters: digits, then A = 10 to Z = 35; a filler counts as 0."""

    def value(x: Column) -> Column:
        code = F.ascii(x)
        letter = F.when(code.between(65, 90), code - 55).otherwise(0)
        return F.when(code.between(48, 57), code - 48).otherwise(letter)

    return F.transform(F.split(c, ""), value)


def _sum(values: Column, weight: Callable[[Column, Column], Column]) -> Column:
    weighted = F.transform(values, weight)
    return F.aggregate(weighted, F.lit(0), lambda a, x: a + x)


def _only(c: Column, kept: str) -> Column:
    return F.regexp_replace(c, f"[^{kept}]", "")


def luhn(c: Column | str) -> Column:
    """Payment cards: every second digit from the right doubled, the sum ends in 0."""

    def test(values: Column) -> Column:
        n = F.size(values)

        def weigh(v: Column, i: Column) -> Column:
            twice = v * 2
            doubled = F.when(twice > 9, twice - 9).otherwise(twice)
            return F.when((n - i) % 2 == 0, doubled).otherwise(v)

        return (n > 1) & (_sum(values, weigh) % 10 == 0)

    return let(_values(_only(_col(c), "0-9")), test)


def mod97(c: Column | str) -> Column:
    """Account numbers: country and check digits moved to the end, the number is 1 modulo 97."""
    plain = _only(_col(c), "A-Z0-9")
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    step = lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97
    return F.aggregate(_values(moved), F.lit(0), step) == 1


def mod11(c: Column | str) -> Column:
    """Eleven-digit taxpayer numbers with two check digits modulo 11; equal digits are none."""
    digits = _only(_col(c), "0-9")

    def test(values: Column) -> Column:
        def digit(at: int) -> Column:
            total = _sum(F.slice(values, 1, at), lambda v, i: v * (F.lit(at + 1) - i))
            return (total * 10 % 11 % 10) == F.element_at(values, at + 1)

        differ = F.size(F.array_distinct(values)) > 1
        return F.when(F.size(values) == 11, differ & digit(9) & digit(10)).otherwise(False)

    return let(_values(digits), test)


def machine_zone(c: Column | str) -> Column:
    """Second line of a passport's machine zone: check digits over number, dates and the whole."""
    line = _col(c)

    def holds(part: Column, check: Column) -> Column:
        weights = F.array(*[F.lit(w) for w in (7, 3, 1)])
        total = _sum(_values(part), lambda v, i: v * F.element_at(weights, i % 3 + 1))
        return total % 10 == F.element_at(_values(check), 1)

    cut = lambda start, n: F.substring(line, start, n)
    whole = F.concat(cut(1, 10), cut(14, 7), cut(22, 22))
    return (
        (F.length(line) == 44)
        & holds(cut(1, 9), cut(10, 1))
        & holds(cut(14, 6), cut(20, 1))
        & holds(cut(22, 6), cut(28, 1))
        & holds(whole, cut(44, 1))
    )


def with_digit(c: Column | str) -> Column:
    """Codes of letters and digits: a word in capitals alone is none."""
    return _col(c).rlike("[0-9]")


CHECKS: dict[str, Callable[[Column], Column]] = {
    "luhn": luhn, "mod97": mod97, "mod11": mod11, "machine_zone": machine_zone,
    "with_digit": with_digit,
}
