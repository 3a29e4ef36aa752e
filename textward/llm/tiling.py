"""Benchmark decontamination by greedy string tiling.

Rolling Karp-Rabin hashes of three tokens join documents to benchmark items.  Items whose seeds
could cover enough of them are tiled: the longest match of free tokens is marked, again and
again, and what is left of the others is matched on.  Tiles may stand in any order, so a
passage whose parts were moved is found like one that was copied.

Tokens are lower-case words (A-Z) without the ASCII punctuation around them.  Cases: a null or
empty text, and an item with fewer than three tokens, match nothing; repeated rows each get
their matches; rows without id are reported with a null id; empty tables give empty results.
Only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow.dataset import dataset
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_dir
from .common import batches, binary_column
from .shingles import parts, word_offsets, xxh64_slices

MIN_TILE = 3
#: Part of an item's tokens that must be tiled.
COVERAGE = 0.8
#: Benchmark text of one block; a larger benchmark is searched block by block.  Blocks lie in the
#: shared folder, tasks read one at a time.
BLOCK_BYTES = 8 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes of all texts, tokens per text)."""
    buf, a, b, words = word_offsets(texts)
    a, b = a.copy(), b.copy()
    while len(a):
        cut = (a < b) & _PUNCTUATION[buf[np.minimum(a, len(buf) - 1)]]
        if not cut.any():
            break
        a[cut] += 1
    while len(a):
        cut = (a < b) & _PUNCTUATION[buf[np.maximum(b - 1, 0)]]
        if not cut.any():
            break
        b[cut] -= 1
    text = np.repeat(np.arange(len(texts)), words)
    full = a < b
    return xxh64_slices(buf, a[full], b[full]), np.bincount(text[full], minlength=len(texts))


def rolling(h: np.ndarray, count: np.ndarray, width: int = MIN_TILE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of ``width`` tokens, their places in ``h``); none crosses a text."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key = h[:n].copy()
    for k in range(1, width):
        key = key * _BASE + h[k : k + n]
    end = np.repeat(np.cumsum(count), count)[:n]
    inside = np.flatnonzero(np.arange(n) + width <= end)
    return key[inside], inside


def greedy_tiles(pairs: list[tuple[int, int]], doc: np.ndarray, item: np.ndarray, least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """(length, item place, document place) of the tiles; ``pairs`` are seed places (doc, item).

    Longest first; of equals the first in the item, then the first in the document.
    """
    seeds = sorted({(d - i, i) for d, i in pairs if (doc[d : d + least] == item[i : i + least]).all()})
    heap, k = [], 0
    while k < len(seeds):
        diagonal, start = seeds[k]
        end = start
        while k < len(seeds) and seeds[k][0] == diagonal and seeds[k][1] <= end + 1:
            end = seeds[k][1]
            k += 1
        heap.append((-(end - start + least), start, start + diagonal))
    heapq.heapify(heap)
    used_doc, used_item, tiles = set(), np.zeros(len(item), bool), []
    while heap:
        size, i, d = heapq.heappop(heap)
        free = [not used_item[i + k] and d + k not in used_doc for k in range(-size)]
        if all(free):
            used_item[i : i - size] = True
            used_doc.update(range(d, d - size))
            tiles.append((-size, i, d))
            continue
        k = 0
        while k < -size:  # the free parts stay in the game
            e = k
            while e < -size and free[e]:
                e += 1
            if e - k >= least:
                heapq.heappush(heap, (k - e, i + k, d + k))
            k = e + 1
    return tiles


@dataclass
class Benchmark:
    """Items of one block with their seeds sorted by hash."""

    ids: list
    hashes: np.ndarray
    count: np.ndarray
    keys: np.ndarray
    item: np.ndarray
    place: np.ndarray

    @classmethod
    def build(cls, ids: list, texts: list[bytes]) -> Benchmark:
        h, count = tokens(texts)
        key, place = rolling(h, count)
        order = np.argsort(key, kind="stable")
        owner = np.repeat(np.arange(len(texts)), count)[place]
        start = np.cumsum(count) - count
        return cls(ids, h, count, key[order], owner[order], (place - start[owner])[order])

    def matches(
        self, h: np.ndarray, count: np.ndarray, coverage: float
    ) -> Iterator[tuple[int, int, float, int, int]]:
        """(text, item, coverage, tiles, longest tile) of every item that is covered enough by a
        text; the texts come as their :func:`tokens`."""
        key, place = rolling(h, count)
        low = np.searchsorted(self.keys, key, "left")
        known = low < len(self.keys)
        known[known] = self.keys[low[known]] == key[known]
        if not known.any():
            return
        low, place = low[known], place[known]
        n = np.searchsorted(self.keys, key[known], "right") - low
        seed = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at = np.repeat(place, n)
        text = np.searchsorted(np.cumsum(count), at, "right")
        # tokens of an item that any seed touches: an upper bound of what tiles can cover
        most = int(self.count.max()) + MIN_TILE
        pair = text * len(self.ids) + self.item[seed]
        touched = (pair * most + self.place[seed])[:, None] + np.arange(MIN_TILE)
        owner, covered = np.unique(np.unique(touched) // most, return_counts=True)
        enough = owner[covered >= coverage * self.count[owner % len(self.ids)]]
        order = np.argsort(pair, kind="stable")
        ordered = pair[order]
        first = np.cumsum(count) - count
        start = np.cumsum(self.count) - self.count
        for p in enough:
            t, i = divmod(int(p), len(self.ids))
            own = order[np.searchsorted(ordered, p, "left") : np.searchsorted(ordered, p, "right")]
            doc = h[first[t] : first[t] + count[t]]
            item = self.hashes[start[i] : start[i] + self.count[i]]
            pairs = list(zip((at[own] - first[t]).tolist(), self.place[seed[own]].tolist(), strict=True))
            tiles = greedy_tiles(pairs, doc, item)
            part = sum(x[0] for x in tiles) / len(item)
            if part >= coverage:
                yield t, i, part, len(tiles), max(x[0] for x in tiles)


#: Arrays of a block and their types.
_ARRAYS = {"hashes": "u8", "count": "i8", "keys": "u8", "item": "i8", "place": "i8"}


@dataclass(frozen=True)
class Blocks:
    """A benchmark in the shared folder: one file with the arrays of each block."""

    path: str
    numbers: list[int]

    def load(self, number: int) -> Benchmark:
        """Read a block, in a task; the driver holds none."""
        return _load(self.path, number)


@lru_cache(maxsize=1)
def _load(path: str, number: int) -> Benchmark:
    files, root = FileSystem.from_uri(f"{path}/block={number}")
    row = dataset(root, filesystem=files, format="parquet").to_table()
    arrays = {k: np.frombuffer(row.column(k)[0].as_buffer(), kind) for k, kind in _ARRAYS.items()}
    return Benchmark(row.column("ids")[0].as_py(), **arrays)


def stage_blocks(
    benchmark: DataFrame, item: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES
) -> Blocks:
    """Items in blocks of about ``block_bytes`` (an item longer than a block is a block), prepared
    by tasks and written to the shared folder; only their numbers come to the driver."""
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(item).alias("id"), F.col(text).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-size // block_bytes))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n)))

    def build(group: pa.Table) -> pa.Table:
        texts = [x for b in group.to_batches() for x in binary_column(b, "text")]
        made = Benchmark.build(group.column("id").to_pylist(), texts)
        ids = pa.array([made.ids], pa.list_(group.schema.field("id").type))
        arrays = [pa.array([getattr(made, k).astype(kind).tobytes()], pa.binary()) for k, kind in _ARRAYS.items()]
        return pa.table([group.column("block")[:1], ids, *arrays], ["block", "ids", *_ARRAYS])

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"block bigint, ids array<{kind}>, " + ", ".join(f"{k} binary" for k in _ARRAYS)
    path = scratch_dir(benchmark.sparkSession, "benchmark")
    dealt.groupBy("block").applyInArrow(build, schema).write.partitionBy("block").parquet(path)
    written = benchmark.sparkSession.read.schema("block bigint, count binary").parquet(path)
    return Blocks(path, sorted(r["block"] for r in written.select("block").collect()))


#: Document text that meets one block after the other before the next is read.
GATHERED_BYTES = 32 << 20


def _gathered(frames: Iterator[pa.RecordBatch], text: str) -> Iterator[list[tuple]]:
    """Batches of about ``GATHERED_BYTES`` as (batch, runs of texts as (first, hashes, counts))."""
    held, size = [], 0
    for b in batches(frames):
        values = binary_column(b, text)
        held.append((b, [(first, *tokens(some)) for first, some in parts(values)]))
        size += sum(map(len, values))
        if size >= GATHERED_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def contaminated(
    df: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    coverage: float = COVERAGE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(key, item, coverage, n_tiles, longest_tile): items that a document holds."""
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    id_type, item_type = rows.schema["id"].dataType.simpleString(), benchmark.schema[item].dataType
    schema = f"id {id_type}, item {item_type.simpleString()}, coverage double, n_tiles int, longest_tile int"
    names = ["id", "item", "coverage", "n_tiles", "longest_tile"]
    items = stage_blocks(benchmark, item, text, block_bytes)

    def search(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _gathered(frames, "text"):
            for number in items.numbers:
                block = items.load(number)
                for b, runs in held:
                    found = [
                        (first + t, *rest)
                        for first, h, count in runs
                        for t, *rest in block.matches(h, count, coverage)
                    ]
                    if found:
                        t, i, part, n, longest = zip(*found, strict=True)
                        ids = b.column(0).take(pa.array(t, pa.int64()))
                        hits = pa.array([block.ids[x] for x in i])
                        yield pa.RecordBatch.from_arrays(
                            [ids, hits, pa.array(part), pa.array(n, pa.int32()), pa.array(longest, pa.int32())], names
                        )

    out = rows.mapInArrow(search, schema)
    return out.withColumnsRenamed({"id": key, "item": item})


def decontaminate(
    df: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    coverage: float = COVERAGE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Documents that hold no benchmark item: one pass, nothing is shuffled."""
    items = stage_blocks(benchmark, item, text, block_bytes)

    def clean(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _gathered(frames, text):
            keep = [np.ones(b.num_rows, bool) for b, _ in held]
            for number in items.numbers:
                block = items.load(number)
                for own, (_, runs) in zip(keep, held, strict=True):
                    for first, h, count in runs:
                        for t, *_ in block.matches(h, count, coverage):
                            own[first + t] = False
            for own, (b, _) in zip(keep, held, strict=True):
                yield b.filter(pa.array(own))

    return df.mapInArrow(clean, df.schema)
