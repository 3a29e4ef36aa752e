"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A byte goes if a string of ``LENGTH`` bytes over it also starts anywhere else.  Only windows
that can repeat are sorted.  The window's anchor is the place of its smallest hash of ``SEED``
bytes; equal windows have equal anchors at equal places, so windows whose anchor occurs once
are unique.  The windows of one anchor lie side by side and form a slice; slices that are equal
as a whole repeat as a whole.  What is left goes to suffix buckets by anchor.  Buckets are
sorted a block at a time: suffixes by their first bytes and then by the rank of the next place
of a difference cover, whose ranks are computed before, by doubling, on the cover alone.
Neighbours in that order that share ``LENGTH`` bytes repeat.

Slices that share an anchor are counted first.  An anchor with more than ``CROWD`` different
ones would outgrow a block; there the windows themselves are the buckets, and are counted by
their digest.

Cases: a null or empty text, and any below ``LENGTH`` bytes, loses nothing; rows that repeat
are repeats of each other; rows without id are documents like any other; an empty table gives
an empty result.  Columns of the input are kept; those of ``ADDED`` replace columns of that name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, binary_column, fresh_name, stage
from .shingles import parts

LENGTH = 400
SEED = 64
#: Different slices of one anchor that are sorted together at most.
CROWD = 4096
#: Bytes of slices sorted at once; one anchor is never cut.
BLOCK_BYTES = 1 << 20
ADDED = ("kept", "n_bytes", "n_removed", "n_spans")

#: The cover modulo 64: any two places have a distance below 64 at which both are in it.
COVER = 64
_IN_COVER = np.zeros(COVER, bool)
_IN_COVER[[*range(8), *range(8, COVER, 8)]] = True
_STEP = np.array([next(d for d in range(COVER) if _IN_COVER[(r + d) % COVER]) for r in range(COVER)])

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def anchors(text: bytes, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, last window, anchor) of each run of windows with one anchor.

    Of equal hashes in a window the first is its anchor.
    """
    none = np.zeros(0, np.int64)
    if len(text) < length:
        return none, none, none, none
    h = np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)
    power, width = np.array([_BASE]), 1
    while width < seed:
        h = h[:-width] * power + h[width:]
        power, width = power * power, 2 * width
    h = (h ^ (h >> np.uint64(31))) * _MIX
    h ^= h >> np.uint64(29)
    span = length - seed + 1
    n = len(h)
    padded = np.full(-(-n // span) * span, np.iinfo(np.uint64).max)
    padded[:n] = h
    rows = padded.reshape(-1, span)
    head = np.minimum.accumulate(rows, axis=1).ravel()
    tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(tail[: n - span + 1], head[span - 1 : n])
    # where each window's smallest hash stands first: the next place of that hash
    at = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    first, last, place = [], [], []
    for s, e in zip(at.tolist(), [*(at[1:] - 1).tolist(), len(low) - 1], strict=True):
        p = s + int(np.argmax(h[s : s + span] == low[s]))
        while p < e:  # the hash occurs again before the run ends: a new anchor takes over
            first.append(s)
            last.append(p)
            place.append(p)
            s = p + 1
            p = s + int(np.argmax(h[s : s + span] == low[s]))
        first.append(s)
        last.append(e)
        place.append(p)
    first, last, place = (np.array(x, np.int64) for x in (first, last, place))
    return low[first].view(np.int64), first, last, place


def _sample_ranks(text: np.ndarray, length: int) -> np.ndarray:
    """Rank of every cover place by at least ``length`` bytes from there; 0 elsewhere."""
    n = len(text) - 2 * COVER
    where = np.flatnonzero(np.resize(_IN_COVER, n))
    words = np.ndarray((len(text) - 7,), ">u8", buffer=text, strides=(1,))
    columns = [words[where + 8 * k].astype(np.uint64) for k in range(COVER // 8)]
    order = np.lexsort(columns[::-1])
    change = np.zeros(len(where), bool)
    change[:1] = True
    for c in columns:
        s = c[order]
        change[1:] |= s[1:] != s[:-1]
    rank = np.zeros(len(text), np.int64)
    rank[where[order]] = np.cumsum(change)
    known = COVER
    while known < length:
        ahead = np.minimum(where + known, len(text) - 1)
        pair = rank[where] * (len(where) + 1) + rank[ahead]
        rank[where] = np.unique(pair, return_inverse=True)[1] + 1
        known *= 2
    return rank


def repeated_windows(slices: list[bytes], anchor: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each slice, which of its windows of ``length`` bytes also start in another place.

    ``anchor`` is the place of the anchor in the slice.  Slices are laid out with their anchors
    at multiples of the cover's period, so equal windows stand at equal places of it.
    """
    base, at = [], 0
    for s, a in zip(slices, anchor, strict=True):
        at += -(at + a) % COVER
        base.append(at)
        at += len(s)
    text = np.zeros(at + 4 * COVER, np.uint8)
    for b, s in zip(base, slices, strict=True):
        text[b : b + len(s)] = np.frombuffer(s, np.uint8)
    rank = _sample_ranks(text, length)
    words = np.ndarray((len(text) - 7,), ">u8", buffer=text, strides=(1,))
    count = np.array([len(s) - length + 1 for s in slices])
    owner = np.repeat(np.arange(len(slices)), count)
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = np.array(base)[owner] + inside
    offset = np.array(anchor)[owner] - inside
    order = np.lexsort([rank[start + _STEP[start % COVER]], words[start], offset])
    i, j = start[order[:-1]], start[order[1:]]
    same = np.flatnonzero((offset[order[:-1]] == offset[order[1:]]) & (words[i] == words[j]))
    for k in [length - 8, *range(length // 2, length - 8, 8), *range(8, length // 2, 8)]:
        same = same[words[i[same] + k] == words[j[same] + k]]
    out = np.zeros(len(start), bool)
    out[order[same]] = True
    out[order[same + 1]] = True
    return np.split(out, np.cumsum(count)[:-1])


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]



def _slice_rows(rows: DataFrame, length: int) -> DataFrame:
    """(t1, t2, id, ah, d1, d2, first, last, place): the slices of every text."""
    schema = rows.select("t1", "t2", "id").schema.simpleString()[7:-1].replace(":", " ")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames):
            keys = b.select(["t1", "t2", "id"])
            # a megabyte of text at a time, so long texts do not pile up
            for start, some in parts(binary_column(b, "text")):
                found = [anchors(t, length) for t in some]
                if not found:
                    continue
                at = np.repeat(np.arange(len(some)), [len(f[0]) for f in found]) + start
                hashes, first, last, place = (np.concatenate([f[k] for f in found]) for k in range(4))
                digests = [
                    xxhash.xxh3_128_intdigest(t[x : y + length])
                    for t, f in zip(some, found, strict=True)
                    for x, y in zip(f[1].tolist(), f[2].tolist(), strict=True)
                ]
                d1 = np.array([d & (2**64 - 1) for d in digests], np.uint64).view(np.int64)
                d2 = np.array([d >> 64 for d in digests], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*keys.take(pa.array(at)).columns, *map(pa.array, (hashes, d1, d2, first, last, place))],
                    ["t1", "t2", "id", "ah", "d1", "d2", "first", "last", "place"],
                )

    more = "ah bigint, d1 bigint, d2 bigint, first bigint, last bigint, place bigint"
    return rows.select("t1", "t2", "id", "text").mapInArrow(run, f"{schema}, {more}")


def _cut(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(ah, d1, alone, t1, t2, first, place, slice): the bytes of wanted slices, from one text each."""
    lists = wanted.groupBy("t1", "t2", "id").agg(
        F.collect_list(F.struct("ah", "d1", "alone", "first", "last", "place")).alias("cuts")
    )
    lists = lists.withColumnsRenamed({"t1": "u1", "t2": "u2", "id": "uid"}).hint("shuffle_hash")
    at = (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2")) & F.col("id").eqNullSafe(F.col("uid"))
    names = ["ah", "d1", "alone", "t1", "t2", "first", "place", "slice"]
    types = [pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 4, pa.binary()]

    def out(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames):
            columns: list[list] = [[] for _ in names]
            size = 0
            keys = (b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist())
            for text, t1, t2, cuts in zip(binary_column(b, "text"), *keys, strict=True):
                for c in cuts:
                    values = (c["ah"], c["d1"], c["alone"], t1, t2, c["first"], c["place"], text[c["first"] : c["last"] + length])
                    for column, x in zip(columns, values, strict=True):
                        column.append(x)
                    size += len(values[-1])
                if size > BLOCK_BYTES:
                    yield out(columns)
                    columns, size = [[] for _ in names], 0
            yield out(columns)

    schema = "ah bigint, d1 bigint, alone boolean, t1 bigint, t2 bigint, first bigint, place bigint, slice binary"
    return rows.join(lists, at).select("t1", "t2", "text", "cuts").mapInArrow(run, schema)


_RUN = "t1 bigint, t2 bigint, a bigint, b bigint"


def _sorted_runs(slices: DataFrame, length: int, block: int) -> DataFrame:
    """Runs (a, b) of repeated window starts of the slices that stand alone, bucket by bucket."""

    def solve(held: list[tuple]) -> pa.RecordBatch:
        rows = list({(r[0], r[1]): r for r in held}.values())  # copies of a row cut a slice twice
        flags = repeated_windows([r[7] for r in rows], [r[6] - r[5] for r in rows], length)
        out = [(r[3], r[4], r[5] + a, r[5] + b) for r, f in zip(rows, flags, strict=True) if r[2] for a, b in _runs(f)]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["t1", "t2", "a", "b"])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches(frames):
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if size > block and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[7])
        if held:
            yield solve(held)

    return slices.repartition("ah").sortWithinPartitions("ah").mapInArrow(run, _RUN)


def _counted_runs(slices: DataFrame, length: int) -> DataFrame:
    """The same for crowded anchors: each window is a bucket of its own, counted by a digest of 128 bits."""

    def windows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames):
            columns: list[list] = [[] for _ in range(7)]
            for ah, _, alone, t1, t2, first, place, s in zip(*[c.to_pylist() for c in b.columns], strict=True):
                for i in range(len(s) - length + 1):
                    d = xxhash.xxh3_128_intdigest(s[i : i + length], ah & 0xFFFF)
                    halves = (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)
                    for c, x in zip(columns, (place - first - i, *halves, alone, t1, t2, first + i), strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["o", "d", "e", "alone", "t1", "t2", "a"])

    rows = slices.dropDuplicates(["ah", "d1"]).mapInArrow(
        windows, "o bigint, d bigint, e bigint, alone boolean, t1 bigint, t2 bigint, a bigint"
    )
    rows = stage(rows, "suffix-windows")
    twice = rows.groupBy("o", "d", "e").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    hits = rows.where("alone").join(twice, ["o", "d", "e"], "left_semi")
    return hits.select("t1", "t2", "a", F.col("a").alias("b"))


def repeats(rows: DataFrame, length: int = LENGTH, crowd: int = CROWD, block: int = BLOCK_BYTES) -> DataFrame:
    """(t1, t2, runs): window starts that repeat, as runs (a, b), of texts with any.

    ``rows``: (id, text, t1, t2), the last two a digest of the text.
    """
    every = stage(_slice_rows(rows, length), "suffix-slices")
    own = F.struct("t1", "t2", "id", "first", "last", "place")
    kinds = stage(
        every.groupBy("ah", "d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.min(own).alias("r")), "suffix-kinds"
    )
    shared = kinds.groupBy(F.col("ah").alias("k")).agg(
        F.count(F.lit(1)).alias("kinds"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("alone")
    )
    mixed = shared.where("kinds > 1 AND alone > 0")
    wanted = kinds.join(mixed, F.col("ah") == F.col("k")).select("ah", "d1", (F.col("n") == 1).alias("alone"), "kinds", "r.*")
    wanted = stage(wanted, "suffix-wanted")
    crowded = wanted.where(F.col("kinds") > crowd)
    cut = stage(_cut(rows, wanted.where(F.col("kinds") <= crowd), length), "suffix-cut")
    found = _sorted_runs(cut, length, block)
    if not crowded.isEmpty():
        found = found.unionAll(_counted_runs(_cut(rows, crowded, length), length))
    whole = every.join(
        kinds.where("n > 1").select(F.col("ah").alias("k"), F.col("d1").alias("k1"), F.col("d2").alias("k2")),
        (F.col("ah") == F.col("k")) & (F.col("d1") == F.col("k1")) & (F.col("d2") == F.col("k2")),
        "left_semi",
    ).select("t1", "t2", F.col("first").alias("a"), F.col("last").alias("b"))
    return found.unionAll(whole).groupBy("t1", "t2").agg(F.collect_set(F.struct("a", "b")).alias("runs"))


def spans(runs: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges (from, to) that the windows of the runs cover."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + length)
        else:
            out.append([a, b + length])
    return [(a, b) for a, b in out]


def dedup(df: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, crowd: int = CROWD, block: int = BLOCK_BYTES) -> DataFrame:
    """All columns of ``df`` with ``kept`` (the bytes left), ``n_bytes``, ``n_removed``, ``n_spans``."""
    df = df.drop(*[c for c in df.columns if c.lower() in ADDED])
    body = F.coalesce(F.col(text), F.lit(""))
    digest = {"t1": F.xxhash64(body), "t2": F.xxhash64(F.lit(1), body)}
    rows = df.select(F.col(key).alias("id"), body.alias("text"), *[v.alias(k) for k, v in digest.items()])
    found = stage(repeats(rows, length, crowd, block), "suffix-runs")
    k1, k2, list_ = (fresh_name(df, n) for n in ("u1__", "u2__", "runs__"))
    found = found.select(F.col("t1").alias(k1), F.col("t2").alias(k2), F.col("runs").alias(list_)).hint("shuffle_hash")
    at = (digest["t1"] == F.col(k1)) & (digest["t2"] == F.col(k2))
    joined = df.join(found, at, "left").select(*df.columns, list_)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames):
            lists = b.column(b.num_columns - 1).to_pylist()
            kept, size, gone, n = [], [], [], []
            for t, own in zip(binary_column(b, text), lists, strict=True):
                cuts = spans([(r["a"], r["b"]) for r in own or ()], length)
                edges = [0, *[x for c in cuts for x in c], len(t)]
                left = b"".join(t[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)) if cuts else t
                kept.append(left)
                size.append(len(t))
                gone.append(len(t) - len(left))
                n.append(len(cuts))
            numbers = [pa.array(x, pa.int64()) for x in (size, gone, n)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(kept, pa.binary()), *numbers], [*df_names, *ADDED]
            )

    df_names = df.columns
    return joined.mapInArrow(run, f"{schema}, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint")
