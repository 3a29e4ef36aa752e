"""Literal terms of a catalogue of any size, found by the hashes of stretches of words.

A catalogue of rules is unrolled into expressions and must stay small.  Literal terms need no
expressions: texts and terms are cut into words and what stands between them, and the hash of the
pieces from a word on finds every term that begins there; the pieces themselves are compared
afterwards.  The terms stay in a table: texts are dealt into chunks of a bounded size, a chunk is
joined to the terms that its own words can begin, and only those are looked for in the chunk.
Nothing of the catalogue goes through the driver, and no task holds more of it than its texts ask
for, but for a sieve of bits that keeps stretches of no term out of that join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.dataset import dataset
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import _col
from ..schemas import DETECTIONS
from ..session import scratch_dir, stage

#: Letters of the texts of a chunk, on average; chunks at most.
PART_CHARS = 4_000_000
CHUNKS = 20_000
#: Texts that are looked at together; slices of a sieve.
_SLICE, _SLICES = 1024, 256
#: Words of a term, and what stands between them, by which it is looked up.
_LED = 9
#: Words, and stretches between words, as word boundaries of rules see them.
# the letters named besides spare most characters the Unicode class
_PIECES = r"(?U)[A-Za-z0-9_\w]+|[^A-Za-z0-9_\w]+"
# letters that fold to another one than their small letter
_FOLD = str.maketrans("ſKıİς", "ski" + "iσ")
#: Pieces that are kept at hand from one batch to the next.
_KNOWN = 1_000_000
#: Odd factors of the pieces of a stretch.
_ODD = np.random.default_rng(20).integers(0, 1 << 63, _LED + 1, np.uint64) * np.uint64(2) + np.uint64(1)


def pieces(c: Column | str) -> Column:
    """Words and the stretches between them, in order."""
    return F.regexp_extract_all(_col(c), F.lit(_PIECES), F.lit(0))


def fold(piece: str) -> str:
    """The form in which pieces are compared when case does not matter."""
    return piece.translate(_FOLD).lower().replace("ς", "σ")


class _Pieces:
    """Lists of pieces as arrays: a number for each folded piece, and a hash for each number."""

    def __init__(self, case_insensitive: bool) -> None:
        self.form = fold if case_insensitive else str
        self.number: dict[str, int] = {}
        self.known: dict[str, int] = {}
        self.hashes = np.zeros(0, np.uint64)

    def of(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all pieces one after the other, and where each list starts, to the end of the last."""
        at = lists.offsets.to_numpy()
        held = lists.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
        for p in (found := held.dictionary.to_pylist()):
            if p not in self.known:
                self.known[p] = self.number.setdefault(self.form(p), len(self.number))
        if len(self.number) > len(self.hashes):
            new = list(self.number)[len(self.hashes) :]
            digests = b"".join(hashlib.blake2b(p.encode("utf-8", "surrogatepass"), digest_size=8).digest() for p in new)
            self.hashes = np.concatenate([self.hashes, np.frombuffer(digests, np.uint64)])
        numbers = np.array([self.known[p] for p in found], np.int64)
        return numbers[held.indices.to_numpy()] if len(found) else np.zeros(0, np.int64), at - at[0]


def _stretches(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` pieces from each place on, as far as there are so many."""
    out = np.full(max(0, len(hashes) - n + 1), n, np.uint64) * _ODD[0]
    for j in range(n):
        out += (hashes[j : j + len(out)] ^ (hashes[j : j + len(out)] >> np.uint64(29))) * _ODD[j + 1]
    return out ^ (out >> np.uint64(32))


def _ends(at: np.ndarray) -> np.ndarray:
    """For each piece where its list ends."""
    return np.repeat(at[1:], np.diff(at))


def terms_from_rows(terms: DataFrame) -> DataFrame:
    """The catalogue ``(position, language, rule, term)`` with the ``pieces`` of each term.

    Terms begin and end with a letter or digit; others, and null ones, can never stand between
    word boundaries and are left out.
    """
    known = terms.where(F.col("term").rlike(r"(?Us)\A\w(?:.*\w)?\z"))
    return known.select("position", "language", "rule", pieces("term").alias("pieces"))


def _keys(
    frames: Iterator[pa.RecordBatch], lengths: list[int], case_insensitive: bool, sieve: _Sieve
) -> Iterator[pa.RecordBatch]:
    """``(chunk, key)``: the stretches of as many pieces as terms have, by chunk, as far as a term can lead with them."""
    held, bits = _Pieces(case_insensitive), sieve.load()
    for b in (frame.slice(lo, _SLICE) for frame in frames for lo in range(0, frame.num_rows, _SLICE)):
        if len(held.known) > _KNOWN:
            held = _Pieces(case_insensitive)
        number, at = held.of(b.column(1))
        hashes, ends = held.hashes[number], _ends(at)
        chunk = np.repeat(b.column(0).to_numpy(), np.diff(at))
        for n in lengths:
            keys = _stretches(hashes, n)
            kept = np.flatnonzero(np.arange(n, n + len(keys)) <= ends[: len(keys)])
            kept = kept[sieve.holds(bits, keys[kept])]
            order = kept[np.lexsort((keys[kept], chunk[kept]))]
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(keys[order]) != 0) | (np.diff(chunk[order]) != 0)
            order = order[new]
            yield pa.RecordBatch.from_arrays([pa.array(chunk[order]), pa.array(keys[order].view(np.int64))], ["chunk", "key"])


def _led(frames: Iterator[pa.RecordBatch], case_insensitive: bool) -> Iterator[pa.RecordBatch]:
    """Terms with the ``key`` by which they are looked up."""
    held = _Pieces(case_insensitive)
    for b in frames:
        if len(held.known) > _KNOWN:
            held = _Pieces(case_insensitive)
        if b.num_rows:
            keys = _leads(held, *held.of(b.column(b.schema.get_field_index("pieces"))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys.view(np.int64))], [*b.schema.names, "key"])


def _leads(held: _Pieces, number: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The hash of the first pieces of each term, at most ``_LED``."""
    hashes, size = held.hashes[number], np.minimum(np.diff(at), _LED)
    out = np.zeros(len(size), np.uint64)
    for n in np.unique(size):
        own = np.flatnonzero(size == n)
        out[own] = _stretches(hashes, int(n))[at[own]]
    return out


@dataclass(frozen=True)
class _Sieve:
    """Bits of the keys of a catalogue in the shared folder, in slices by the first bits of a key.

    A key without its bit is of no term; at most 2^27 bits (16 MB), so a task can hold all of them.
    """

    path: str
    width: int

    def place(self, keys: np.ndarray) -> np.ndarray:
        """Places in the bits of a slice."""
        return ((keys >> np.uint64(24)) & np.uint64(self.width - 1)).astype(np.int64)

    def load(self) -> np.ndarray:
        files, root = FileSystem.from_uri(self.path)
        rows = dataset(root, filesystem=files, format="parquet").to_table(["slice", "bits"])
        out = np.zeros((_SLICES, self.width // 8), np.uint8)
        for at, bits in zip(rows["slice"].to_pylist(), rows["bits"], strict=True):
            out[at] = np.frombuffer(bits.as_buffer(), np.uint8)
        return out

    def holds(self, bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
        at = self.place(keys)
        return (bits[(keys >> np.uint64(56)).astype(np.int64), at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _sieve(known: DataFrame) -> _Sieve:
    """The sieve of the ``key`` of all terms, made by tasks."""
    width = 1 << 3
    while width * _SLICES < 16 * known.count() and width * _SLICES < 1 << 27:
        width *= 2
    made = _Sieve(scratch_dir(known.sparkSession, "term-sieve"), width)

    def build(rows: pa.Table) -> pa.Table:
        bits = np.zeros(width, np.uint8)
        bits[made.place(rows.column("key").to_numpy().view(np.uint64))] = 1
        packed = np.packbits(bits, bitorder="little").tobytes()
        return pa.table([rows.column("slice")[:1], pa.array([packed], pa.binary())], ["slice", "bits"])

    sliced = known.select(F.shiftrightunsigned("key", 56).alias("slice"), "key")
    sliced.groupBy("slice").applyInArrow(build, "slice bigint, bits binary").write.parquet(made.path)
    return made


def detect_terms(
    df: DataFrame,
    terms: DataFrame,
    text: str = "text",
    case_insensitive: bool = True,
    part_chars: int = PART_CHARS,
) -> DataFrame:
    """Add ``detections``: the hits of all terms, by position in the catalogue, then in the text.

    As if every term were a rule of its own between word boundaries.  A null text has none.
    """
    held, cut, chunk, row = (_fresh(df, x) for x in ("_hits", "_pieces", "_chunk", "_row"))
    rest = [c for c in df.columns if c != "detections"]
    chars = df.agg(F.sum(F.length(text))).first()[0] or 0
    n = min(CHUNKS, max(1, -(-chars // part_chars)))
    # chunks are numbered by row, so copies of a text spread over them; they must not change later
    rows = df.select(*rest, F.monotonically_increasing_id().alias(row))
    rows = rows.withColumn(chunk, F.pmod(F.xxhash64(row), F.lit(n))).drop(row)
    rows = stage(rows, "term-texts")
    known = terms_from_rows(terms)
    schema = "position bigint, language string, rule string, pieces array<string>, key bigint"
    known = known.withColumn("position", F.col("position").cast("bigint"))
    known = stage(known.mapInArrow(lambda frames: _led(frames, case_insensitive), schema), "term-catalogue")
    lengths = known.select(F.least(F.size("pieces"), F.lit(_LED)).alias("n")).distinct()
    lengths = sorted(r["n"] for r in lengths.collect())  # at most _LED
    sieve = _sieve(known)
    asked = rows.select(F.col(chunk).alias("chunk"), pieces(text).alias("p")).where("p IS NOT NULL")
    asked = asked.mapInArrow(lambda frames: _keys(frames, lengths, case_insensitive, sieve), "chunk bigint, key bigint")
    # each chunk asks once for a stretch, however often it stands there; the short side is the catalogue
    wanted = asked.distinct().hint("shuffle_merge").join(known, "key").drop("key")
    texts = rows.repartition(min(n, _TASKS), chunk)
    texts = texts.withColumn(cut, F.coalesce(pieces(text), F.array().cast("array<string>")))
    out = T.StructType([df.schema[c] for c in rest]).add(held, _HITS)
    found = texts.groupBy(chunk).cogroup(wanted.groupBy("chunk")).applyInArrow(
        _finder(case_insensitive, cut, [*rest, held]), out
    )
    ordered = F.transform(F.sort_array(held), lambda h: F.struct(h["language"], h["rule"], h["match"]))
    return found.select(*rest, ordered.cast(DETECTIONS).alias("detections"))


def _fresh(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


#: Tasks that texts are dealt to at most; a task takes its chunks one after the other.
_TASKS = 2_000
_HITS = T.ArrayType(
    T.StructType(
        [
            T.StructField("position", T.LongType()),
            T.StructField("first", T.IntegerType()),
            T.StructField("n", T.IntegerType()),
            T.StructField("language", T.StringType()),
            T.StructField("rule", T.StringType()),
            T.StructField("match", T.StringType()),
        ]
    )
)


def _finder(case_insensitive: bool, cut: str, names: list[str]):
    def run(texts: pa.Table, wanted: pa.Table) -> pa.Table:
        columns = [texts.column(c).combine_chunks() for c in names[:-1]]
        lists, terms = texts.column(cut).combine_chunks(), wanted.combine_chunks()
        held = _Pieces(case_insensitive)
        number, at = held.of(lists)
        own, own_at = held.of(terms.column("pieces").combine_chunks())
        place, term = _hits(held, number, at, own, own_at)
        size = np.diff(own_at)[term]
        text = np.searchsorted(at, place, "right") - 1
        # a hash orders them finely enough; equal places are put in order by Spark
        order = np.lexsort((place, terms.column("position").to_numpy()[term], text))
        place, term, size, text = (x[order] for x in (place, term, size, text))
        row = terms.select(["position", "language", "rule"]).take(pa.array(term))
        first = pa.array((place - at[text]).astype(np.int32))
        matches = _joined(lists, lists.offsets.to_numpy()[0] + place, size)
        values = [row.column(0), first, pa.array(size.astype(np.int32)), row.column(1), row.column(2), matches]
        values = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in values]
        found = pa.StructArray.from_arrays(values, [f.name for f in _HITS.elementType.fields])
        upto = np.searchsorted(text, np.arange(len(lists) + 1))
        return pa.Table.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(upto, pa.int32()), found)], names)

    return run


def _hits(
    held: _Pieces, number: np.ndarray, at: np.ndarray, own: np.ndarray, own_at: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """``(place, term)``: hits of each term, apart, in the pieces ``number`` of texts that start ``at``;
    the pieces of terms are ``own``, from ``own_at`` on."""
    keys, size = _leads(held, own, own_at), np.diff(own_at)
    led = np.minimum(size, _LED)
    begins = np.zeros(len(held.hashes), bool)
    begins[own[own_at[:-1]]] = True
    may, ends, hashes = np.flatnonzero(begins[number]), _ends(at), held.hashes[number]
    found = []
    for n in np.unique(led):
        some = np.flatnonzero(led == n)
        some = some[np.argsort(keys[some], kind="stable")]
        place = may[may + n <= ends[may]]
        key = _stretches(hashes, int(n))[place]
        first = np.searchsorted(keys[some], key)
        here = keys[some][np.minimum(first, len(some) - 1)] == key
        place, first = place[here], first[here]
        several = np.searchsorted(keys[some], key[here], "right") - first
        term = some[np.repeat(first - np.cumsum(several) + several, several) + np.arange(several.sum())]
        place = np.repeat(place, several)
        # equal hashes are no proof
        for j in range(int(size[some].max())):
            there = size[term] <= j
            upto = np.where(there, 0, j)
            same = (place + upto < ends[place]) & (number[np.minimum(place + upto, len(number) - 1)] == own[own_at[term] + upto])
            place, term = place[there | same], term[there | same]
        found.append((place, term))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, term = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((place, term))
    place, term = place[order], term[order]
    # a hit that begins inside one of the same term before it does not count
    near = np.flatnonzero((term[1:] == term[:-1]) & (np.diff(place) < size[term[1:]]))
    kept, last = np.ones(len(place), bool), {}
    for i in np.flatnonzero(np.isin(term, term[near])) if len(near) else ():
        kept[i] = place[i] >= last.get(term[i], 0)
        if kept[i]:
            last[term[i]] = place[i] + size[term[i]]
    return place[kept], term[kept]


def _joined(lists: pa.ListArray, place: np.ndarray, size: np.ndarray) -> pa.Array:
    """The pieces from each place on, ``size`` of them, as one string."""
    parts, order = [pa.array([], pa.string())], []
    for n in np.unique(size):
        some = np.flatnonzero(size == n)
        words = [lists.values.take(pa.array(place[some] + j)).cast(pa.string()) for j in range(n)]
        parts.append(pc.binary_join_element_wise(*words, "") if n > 1 else words[0])
        order.append(some)
    back = np.argsort(np.concatenate(order)) if order else np.zeros(0, np.int64)
    return pa.concat_arrays(parts).take(pa.array(back))
