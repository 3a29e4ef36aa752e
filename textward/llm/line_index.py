"""Line dedup by a sharded minimal perfect hash.

Lines found in several documents are indexed by hash: each shard holds a minimal perfect hash
over its line hashes, and behind it three arrays - a compact fingerprint, the number of
documents, the largest id.  Documents send the hashes of their lines to the shards and probe
the arrays; no line text is ever joined or shuffled.

Cases: a null or empty text is one empty line; a row without id belongs to no document, so its
lines are neither counted nor dropped; rows that share an id are one document; an empty table
gives an empty result.  Columns of the input are kept; ``n_lines`` and ``n_dropped`` replace
columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, batches, binary_column, fresh_name, stage

MIN_CHARS = 40
MIN_DOCS = 5
#: Lines of one shard, so that a shard and its probes fit a task at any size of the input.
SHARD_LINES = 1 << 16
#: A line with more than this part of all lines is hot; there are fewer than 1 / part of them.
HOT_PART = 1e-4

_STRIP = SPACES.encode()
_LOW = (1 << 64) - 1


# ---- minimal perfect hash -------------------------------------------------------------------


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit finalizer; another function for every level."""
    x = keys ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & _LOW)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Levels of bit arrays: a key owns the first level's bit that no other key shares, and its
    number is the count of bits before it."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        ones = np.bitwise_count(bits).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """``keys``: distinct uint64."""
        sizes, words, level = [], [], 0
        while len(keys):
            size = 64 * max(1, -(-2 * len(keys) // 64))
            at = (_mix(keys, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            keys = keys[~alone[at]]
            level += 1
        empty = np.zeros(0, np.uint64)
        return cls(np.array(sizes, np.int64), np.concatenate(words) if words else empty)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 for some, any number for other keys that are not indexed."""
        found = np.full(len(keys), -1, np.int64)
        open_, start = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = (_mix(keys[open_], level) % np.uint64(size)).astype(np.int64) + start
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.bits[word] >> bit) & np.uint64(1) == 1
            below = self.bits[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            found[open_[hit]] = self.before[word[hit]] + np.bitwise_count(below)
            open_, start = open_[~hit], start + int(size)
        return found


class LineIndex:
    """Arrays behind a perfect hash: fingerprint, document count, largest id."""

    def __init__(self, hashed: PerfectHash, prints: np.ndarray, counts: np.ndarray, last: np.ndarray):
        self.hashed, self.prints, self.counts, self.last = hashed, prints, counts, last

    @classmethod
    def build(cls, keys, prints, counts, last) -> LineIndex:
        keys = np.ascontiguousarray(keys).view(np.uint64)
        hashed = PerfectHash.build(keys)
        order = np.argsort(hashed.find(keys))
        return cls(hashed, prints[order], np.minimum(counts, 2**32 - 1).astype(np.uint32)[order], last[order])

    def dropped(self, keys, prints, ids, min_docs: int) -> np.ndarray:
        """True for a line of a document that goes."""
        if not len(self.counts):
            return np.zeros(len(keys), bool)
        at = self.hashed.find(np.ascontiguousarray(keys).view(np.uint64))
        known = at >= 0
        at = np.where(known, at, 0)
        known &= self.prints[at] == prints
        return known & (self.counts[at] >= min_docs) & (self.last[at] != ids)

    def row(self) -> dict[str, bytes]:
        h = self.hashed
        parts = {"sizes": h.sizes, "bits": h.bits, "prints": self.prints, "counts": self.counts, "last": self.last}
        return {k: v.tobytes() for k, v in parts.items()}

    @classmethod
    def from_row(cls, row: dict[str, bytes]) -> LineIndex:
        part = lambda k, t: np.frombuffer(row[k], t)
        hashed = PerfectHash(part("sizes", np.int64), part("bits", np.uint64))
        return cls(hashed, part("prints", np.int32), part("counts", np.uint32), part("last", np.int64))


_INDEX = "shard bigint, sizes binary, bits binary, prints binary, counts binary, last binary"


# ---- lines ----------------------------------------------------------------------------------


def _line_key(line: bytes, min_chars: int) -> int | None:
    """128-bit hash of the key of a line; None for a short one."""
    key = line.strip(_STRIP)
    if len(key) < min_chars:
        return None
    if not key.isascii() and len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_intdigest(key.lower())


def _signed(x: int, bits: int) -> int:
    return x - (1 << bits) if x >> (bits - 1) else x


def _split(key: int) -> tuple[int, int]:
    return _signed(key & _LOW, 64), _signed((key >> 64) & 0xFFFFFFFF, 32)


def line_hashes(df: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """(id, line, print): every long line once per row."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames):
            at, low, high = [], [], []
            for i, body in enumerate(binary_column(b, "text")):
                keys = {_line_key(x, min_chars) for x in body.split(b"\n")}
                keys.discard(None)
                for k in keys:
                    lo, hi = _split(k)
                    at.append(i)
                    low.append(lo)
                    high.append(hi)
            ids = b.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(low, pa.int64()), pa.array(high, pa.int32())], ["id", "line", "print"]
            )

    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id bigint, line bigint, print int")


def dropped_lines(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """(id, lines): hashes of the lines that each document loses."""
    lines = stage(line_hashes(df, key, text, min_chars), "lines")
    n_lines = lines.count()
    counts = stage(
        lines.groupBy("line")
        .agg(F.countDistinct("id").alias("n"), F.max("id").alias("last"), F.max("print").alias("print"))
        .where(F.col("n") >= 2),
        "line-counts",
    )
    # hot lines would gather in one shard; they are few by definition, so their index goes to
    # all tasks and their lines are never routed
    least = n_lines * HOT_PART
    hot = counts.where((F.col("n") > least) & (F.col("n") >= min_docs))
    h = hot.select("line", "print", "n", "last").toPandas()
    hot_index = LineIndex.build(
        h["line"].to_numpy(np.int64), h["print"].to_numpy(np.int32), h["n"].to_numpy(np.int64), h["last"].to_numpy(np.int64)
    ).row()
    hot_keys = np.sort(h["line"].to_numpy(np.int64))
    n_shards = max(1, -(-n_lines // SHARD_LINES))
    shard = F.pmod(F.col("line"), F.lit(n_shards)).alias("shard")

    def arrays(t: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, ...]:
        return tuple(t.column(c).to_numpy() for c in ("line", "print", "id"))

    def out(ids: np.ndarray, keys: np.ndarray) -> pa.Table:
        return pa.table({"id": pa.array(ids, pa.int64()), "line": pa.array(keys, pa.int64())})

    def probe_hot(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = LineIndex.from_row(hot_index)
        for b in batches(frames):
            keys, prints, ids = (b.column(i).to_numpy() for i in (1, 2, 0))
            gone = index.dropped(keys, prints, ids, min_docs)
            yield from out(ids[gone], keys[gone]).to_batches()

    def rest(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames):
            yield b.filter(pa.array(~np.isin(b.column(1).to_numpy(), hot_keys)))

    def build(t: pa.Table) -> pa.Table:
        index = LineIndex.build(*(t.column(c).to_numpy() for c in ("line", "print", "n", "last")))
        return pa.table({"shard": [t.column("shard")[0].as_py()], **{k: [v] for k, v in index.row().items()}})

    def probe(t: pa.Table, shard_row: pa.Table) -> pa.Table:
        if not t.num_rows or not shard_row.num_rows:
            return out(np.zeros(0, np.int64), np.zeros(0, np.int64))
        index = LineIndex.from_row({k: v[0] for k, v in shard_row.to_pydict().items() if k != "shard"})
        keys, prints, ids = arrays(t)
        gone = index.dropped(keys, prints, ids, min_docs)
        return out(ids[gone], keys[gone])

    cold = counts.where(~((F.col("n") > least) & (F.col("n") >= min_docs)))
    index = cold.select("*", shard).groupBy("shard").applyInArrow(build, _INDEX)
    routed = lines.mapInArrow(rest, lines.schema).select("*", shard)
    cold_gone = routed.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(probe, "id bigint, line bigint")
    gone = lines.mapInArrow(probe_hot, "id bigint, line bigint").unionByName(cold_gone)
    return gone.groupBy("id").agg(F.collect_set("line").alias("lines"))


def dedup_lines(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """Documents without their repeated lines, with ``n_lines`` before and ``n_dropped``."""
    df = df.drop(*[c for c in df.columns if c.lower() in ("n_lines", "n_dropped")])
    gone = stage(dropped_lines(df, key, text, min_chars, min_docs), "lines-dropped")
    id_, list_ = fresh_name(df, "id__"), fresh_name(df, "lines__")
    gone = gone.select(F.col("id").alias(id_), F.col("lines").alias(list_))
    # one plan for all sizes: texts move once, and are not sorted for it
    rows = df.join(gone.hint("shuffle_hash"), F.col(key).cast("bigint") == F.col(id_), "left").drop(id_)
    names = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames):
            texts, before, dropped = [], [], []
            lost = b.column(b.num_columns - 1).to_pylist()
            for body, gone_here in zip(binary_column(b, text), lost, strict=True):
                lines = body.split(b"\n")
                kept = lines
                if gone_here:
                    gone_here = set(gone_here)
                    keys = (_line_key(x, min_chars) for x in lines)
                    kept = [
                        x
                        for x, k in zip(lines, keys, strict=True)
                        if k is None or _split(k)[0] not in gone_here
                    ]
                before.append(len(lines))
                dropped.append(len(lines) - len(kept))
                texts.append(b"\n".join(kept) if kept is not lines else body)
            new = pa.array(texts, pa.binary()).cast(pa.string())
            columns = [new if n == text else b.column(i) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(before, pa.int64()), pa.array(dropped, pa.int64())],
                [*names, "n_lines", "n_dropped"],
            )

    return rows.mapInArrow(run, f"{schema}, n_lines bigint, n_dropped bigint")
