"""Spelling variants: words one edit apart, found in a reduced alphabet.

Letters are hashed to a few symbols.  A reduced word's whole one-edit neighbourhood (one symbol
deleted, replaced or inserted, and the reduced word itself) is then small enough to be written
down, and two words one edit apart have reduced words in each other's neighbourhood.  Neighbours
that are no reduced word of the vocabulary are sifted out in the task by a bit array of bounded
size; the others are joined to the reduced vocabulary, and every pair that meets is verified on
the words themselves.  Of two reduced words the one with the smaller hash asks, so no pair is
looked at twice.

Cases: a null text has no words, a null or empty word or a null count is left out, repeated rows of a
vocabulary are added up, ties between forms go to the smallest word in code-point order.  An empty
table gives an empty result.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, fresh_name, lower_az, stage

#: Letters of words: ASCII and the Latin-1 block from A with grave to y with diaeresis.
LETTERS = "A-Za-zÀ-ÿ"
#: Symbols of the reduced alphabet.
SYMBOLS = 8
#: Bits of the sieve for each word, and at most.
BITS_EACH, MOST_BITS = 16, 1 << 27
#: Bits of the sieve that one row holds, and tasks that fill it.
SEGMENT, FILLERS = 1 << 18, 64
#: Neighbours that a task writes down at a time.
CELLS = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))


# ---- words ------------------------------------------------------------------------------------


def word_counts(
    df: DataFrame,
    text: str = "text",
    least_chars: int = 7,
    least: int = 2,
    change: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """(word, n) of the words (maximal runs of letters, A-Z lower-cased) of all texts.

    ``change`` may rewrite each word with the columns of its row, but not make it longer; the
    limits hold for the result.
    """
    name = fresh_name(df, "word")
    pattern = f"[{LETTERS}]{{{least_chars},}}"
    runs = F.regexp_extract_all(lower_az(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))
    rows = df.withColumn(name, F.explode(runs))
    word = F.col(name) if change is None else change(F.col(name))
    rows = rows.select(word.alias("word")).where(F.length("word") >= least_chars)
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


# ---- reduced words ----------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x; different x stay different."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _symbols(words: list[str], n: int) -> np.ndarray:
    """Symbols (1 to ``SYMBOLS``) of words of n letters each."""
    letters = np.array(words, f"<U{n}").view(np.uint32).reshape(len(words), n).astype(np.uint64)
    return ((letters * np.uint64(_BASE)) >> np.uint64(40)) % np.uint64(SYMBOLS) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    x = 1
    for i in range(n):
        out[i] = x
        x = x * _BASE % (1 << 64)
    return out


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(length, places) of words that can be laid side by side."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(size, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
        n = int(size[at[0]]) if len(at) else 0
        step = max(1, CELLS // max(1, n))
        for k in range(0, len(at) if n else 0, step):
            yield n, at[k : k + step]


def keys(words: list[str]) -> np.ndarray:
    """Hash of each reduced word."""
    out = np.zeros(len(words), np.uint64)
    for n, at in _by_length(words):
        s = _symbols([words[i] for i in at], n)
        out[at] = _mix((s * _powers(n)).sum(1, dtype=np.uint64))
    return out


def neighbourhoods(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place of the word, hash) of all reduced words up to one edit from each reduced word.

    A hash may come more than once for a word.
    """
    symbol = np.arange(1, SYMBOLS + 1, dtype=np.uint64)
    base = np.uint64(_BASE)
    for n, at in _by_length(words):
        power = _powers(n + 1)
        step = max(1, CELLS // (2 * SYMBOLS * (n + 1)))
        for k in range(0, len(at), step):
            some = at[k : k + step]
            s = _symbols([words[i] for i in some], n)
            term = s * power[:n]
            upto = np.zeros((len(some), n + 1), np.uint64)
            np.cumsum(term, axis=1, out=upto[:, 1:])
            whole = upto[:, -1:]
            yield some, _mix(whole[:, 0])
            # places of a very long word are taken in turns
            width = max(1, CELLS // (2 * SYMBOLS * len(some)))
            for i in range(0, n + 1, width):
                j, d = min(n + 1, i + width), min(n, i + width)
                before, after = upto[:, i:j], whole - upto[:, i:j]
                inserted = before + after * base
                parts = [(inserted[:, :, None] + symbol * power[i:j, None]).reshape(len(some), -1)]
                if d > i:
                    parts.append(before[:, : d - i] + (after[:, : d - i] - term[:, i:d]) * _BACK)
                    rest = whole - term[:, i:d]
                    parts.append((rest[:, :, None] + symbol * power[i:d, None]).reshape(len(some), -1))
                found = np.concatenate(parts, axis=1)
                yield np.repeat(some, found.shape[1]), _mix(found.ravel())


# ---- sieve ------------------------------------------------------------------------------------


def _bit(key: np.ndarray, i: int, size: int) -> np.ndarray:
    """The bit of the sieve (one of three, i) for each key."""
    return (key + np.uint64(i) * ((key >> np.uint64(32)) | np.uint64(1))) & np.uint64(size - 1)


def sieve(words: DataFrame, n: int) -> np.ndarray:
    """Bits of all reduced words of (word); at most 2^27 bits however many words there are."""
    size = SEGMENT
    while size < min(BITS_EACH * n, MOST_BITS):
        size *= 2

    def fill(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size, bool)
        for b in batches(frames):
            key = keys(b.column(0).to_pylist())
            for i in range(3):
                own[_bit(key, i, size)] = True
        packed = np.packbits(own, bitorder="little").reshape(-1, SEGMENT // 8)
        used = np.flatnonzero(packed.any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array([packed[i].tobytes() for i in used], pa.binary())], ["segment", "bits"]
        )

    def join(group: pa.Table) -> pa.Table:
        bits = np.zeros(SEGMENT // 8, np.uint8)
        for x in group.column("bits").to_pylist():
            bits |= np.frombuffer(x, np.uint8)
        return pa.table({"segment": group.column("segment")[:1], "bits": [bits.tobytes()]})

    schema = "segment bigint, bits binary"
    filled = words.select("word").coalesce(FILLERS).mapInArrow(fill, schema)
    out = np.zeros((size // SEGMENT, SEGMENT // 8), np.uint8)
    for r in filled.groupBy("segment").applyInArrow(join, schema).collect():
        out[r["segment"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _sift(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Places of keys that may be in the sieve."""
    left = np.arange(len(key))
    for i in range(3):
        bit = _bit(key[left], i, 8 * len(bits))
        left = left[(bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0]
    return left


# ---- pairs ------------------------------------------------------------------------------------


def near_pairs(vocabulary: DataFrame, size: int) -> DataFrame:
    """Every pair of words (a, n_a, b, n_b) exactly one edit apart, once."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(sieve(vocabulary, size))

    def own(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames):
            k = keys(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), *b.columns], ["key", "b", "n_b"])

    def ask(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches(frames):
            words = b.column(0).to_pylist()
            mine = keys(words)
            places, found = [], []
            for at, key in neighbourhoods(words):
                up = np.flatnonzero(key >= mine[at])  # the smaller of two asks
                up = up[_sift(bits, key[up])]
                places.append(at[up])
                found.append(key[up])
            at, key = np.concatenate(places), np.concatenate(found)
            order = np.lexsort((key, at))
            at, key = at[order], key[order]
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1]) | (key[1:] != key[:-1])
            at, key = at[new], key[new]
            for k in range(0, len(at), 100_000):
                some = pa.array(at[k : k + 100_000])
                part = key[k : k + 100_000]
                cols = [part.view(np.int64), part == mine[at[k : k + 100_000]]]
                cols = [*map(pa.array, cols), b.column(0).take(some), b.column(1).take(some)]
                yield pa.RecordBatch.from_arrays(cols, ["key", "same", "a", "n_a"])

    words = vocabulary.select("word", "n")
    asked = words.mapInArrow(ask, "key bigint, same boolean, a string, n_a bigint")
    there = words.mapInArrow(own, "key bigint, b string, n_b bigint")
    # words of one reduced word ask each other, all others are asked by one side
    met = asked.hint("shuffle_merge").join(there, "key").where("NOT same OR a < b")
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b")


def variants(vocabulary: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of (word, n).

    ``n_near`` words are one edit apart; the ``form`` is the one of largest n, if that is at least
    ``ratio`` times the word's; the ``root`` is where following forms ends.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2, so that forms grow and end")
    words = vocabulary.where("word <> '' AND n IS NOT NULL").groupBy("word")
    words = words.agg(F.sum("n").cast("bigint").alias("n"))
    words = stage(words, "spelling-words")
    pairs = near_pairs(words, words.count())

    def side(word: str, other: str, n: str) -> Column:
        near = F.struct((-F.col(n)).alias("m"), F.col(other).alias("o"))  # the least is the best
        return F.struct(F.col(word).alias("word"), near.alias("near"))

    both = pairs.select(F.explode(F.array(side("a", "b", "n_b"), side("b", "a", "n_a"))).alias("p")).select("p.*")
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("near").alias("first"))
    found = words.join(near, "word", "left")
    best = (-F.col("first.m")) >= F.lit(ratio) * F.col("n")
    found = stage(
        found.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(best, F.col("first.o")).alias("form"),
            F.when(best, -F.col("first.m")).alias("form_n"),
        ),
        "spelling-forms",
    )
    ends = roots(found.where("form IS NOT NULL").select("word", "form"))
    out = found.join(ends, "word", "left")
    return out.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): each round doubles the steps taken, and is written down."""
    taken = forms.select("word", F.col("form").alias("root"))
    while True:
        onward = taken.select(F.col("word").alias("root"), F.col("root").alias("next"))
        taken = stage(taken.join(onward, "root", "left").select("word", "root", "next"), "spelling-roots")
        done = taken.where("next IS NOT NULL").isEmpty()
        taken = taken.select("word", F.coalesce("next", "root").alias("root"))
        if done:
            return taken
