"""Periodic runs of words by block convolution at dyadic scales.

A run is a stretch of words with smallest period q and at least max(24, 3 q) words that no
neighbouring word extends.  At scale B the words are cut into blocks of B; each block is laid
over the words that follow at every distance of the scale, and the sums of squared differences
come from an exact number theoretic transform (integers modulo a prime that no sum reaches).
A sum of zero is an occurrence of the block; its distance seeds an extension in both directions,
which compares the words themselves.

Why no run is missed: a run of period q has max(24, 3 q) words, so it holds a whole aligned block
of B words and its copy q words later whenever 2 B - 1 + q <= max(24, 3 q).  That is true for
B = 8 and q < 16, and for every larger B and B <= q < 2 B.  The largest scale covers all longer
distances with several windows.

Cases: a null or empty text, or one of fewer than 24 words, has no runs; its words stay.  A text is
worked on alone, so neither repeated rows nor other rows matter; all other columns (null or not)
pass through, and input columns named like an added one are replaced.  An empty table gives an
empty result.  Long texts need memory in proportion to their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches, binary_column
from .shingles import parts

#: Least words of a run, and how many of its periods.
LEAST, TIMES = 24, 3
#: Block lengths of the first and the last scale.
FIRST, LAST = 8, 1 << 19
#: A prime with roots of unity of order 2^20; sums of squared differences stay below it.
PRIME = 7340033
_ROOT = 3
#: Cells of one transform (they stay in the cache of a core) and of one comparison.
SLAB, CELLS = 1 << 15, 1 << 18

# ---- exact transform --------------------------------------------------------------------------
# Products are reduced in Montgomery's way with radix 2^32; sums are left to grow (the prime has
# 23 bits, cells have 64) and differences are kept positive by a multiple of the prime.

_R = 1 << 32
_P = np.uint64(PRIME)
_NEG_INV = np.uint64(-pow(PRIME, -1, _R) % _R)
_LOW = np.uint64(_R - 1)
_HALF = np.uint64(32)
#: Multiple of the prime above every cell of a spectrum.
_ABOVE = np.uint64((1 << 31) // PRIME * PRIME)


def _reduce(x: np.ndarray) -> np.ndarray:
    """x / 2^32 modulo the prime, below x / 2^32 + prime."""
    m = x * _NEG_INV
    m &= _LOW
    m *= _P
    m += x
    m >>= _HALF
    return m


@cache
def _powers(n: int, back: bool) -> np.ndarray:
    """n / 2 powers of the root of unity of order n (or of its inverse), times 2^32."""
    root = pow(_ROOT, (PRIME - 1) // n, PRIME)
    if back:
        root = pow(root, -1, PRIME)
    out = np.array([_R % PRIME], np.uint64)
    while 2 * len(out) <= n // 2:
        factor = pow(root, len(out), PRIME) * _R % PRIME
        out = np.concatenate([out, _reduce(out * np.uint64(factor)) % _P])
    return out[: max(1, n // 2)]


def _forward(x: np.ndarray) -> np.ndarray:
    """Transform of each column of x (B, m), padded with B zeros; rows in bit-reversed order."""
    half, m = x.shape
    a = np.concatenate([x, _reduce(x * _powers(2 * half, False)[:, None])])
    bound = 2  # cells are below bound * prime
    while half > 1:
        half //= 2
        if bound > 1 << 15:
            a, bound = a % _P, 1
        a = a.reshape(-1, 2, half, m)
        u, v = a[:, 0], a[:, 1]
        out = np.empty_like(a)
        np.add(u, v, out=out[:, 0])
        d = u - v
        d += np.uint64(bound * PRIME)
        d *= _powers(2 * half, False)[:, None]
        out[:, 1] = _reduce(d)
        a, bound = out, 2 * bound
    return _reduce(a.reshape(-1, m) * np.uint64(_R % PRIME))


def _backward(a: np.ndarray) -> np.ndarray:
    """Inverse of the transform of products that carry a factor 2^-32, below three times the prime."""
    n, m = a.shape
    half = 1
    while half < n:
        a = a.reshape(-1, 2, half, m)
        t = _reduce(a[:, 1] * _powers(2 * half, True)[:, None])
        out = np.empty_like(a)
        np.add(a[:, 0], t, out=out[:, 0])
        t -= np.uint64(4 * PRIME)  # wraps; the difference is positive again
        np.subtract(a[:, 0], t, out=out[:, 1])
        a = out
        half *= 2
    return _reduce(a.reshape(-1, m) * np.uint64(pow(n, -1, PRIME) * _R * _R % PRIME))


@cache
def _mirror(n: int) -> np.ndarray:
    """Place of index -k for the index k at each place, in bit-reversed order."""
    place = np.arange(n)
    rev = np.zeros(n, np.int64)
    for _ in range(n.bit_length() - 1):
        rev = rev * 2 + (place & 1)
        place = place >> 1
    return rev[-rev % n]


# ---- occurrences ------------------------------------------------------------------------------


def _levels(block: int) -> int:
    """Different values that keep block * (values - 1)^2 below the prime."""
    n = 256
    while block * (n - 1) ** 2 >= PRIME:
        n //= 2
    return n


def _occurrences(
    ids: np.ndarray, rows: np.ndarray, block: int, hops: range
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(hop, row, distance) where a block's values occur again hop * block + (0 .. block - 1) later.

    ``ids`` has ``block`` cells for each row and enough rows after the last of ``rows``.
    """
    value = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    value &= np.uint64(_levels(block) - 1)
    energy = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * value)])
    energy = energy[block:] - energy[:-block]  # of the block that starts at each cell
    step = max(1, SLAB // (2 * block))
    reach = np.array(sorted({0, *hops, hops[-1] + 1}))
    for first in range(0, len(rows), step):
        some = rows[first : first + step]
        wanted = np.unique(some[:, None] + reach)
        spectrum = _forward(np.ascontiguousarray(value.reshape(-1, block)[wanted].T))
        own = spectrum[_mirror(2 * block)][:, np.searchsorted(wanted, some)]
        for hop in hops:
            # a block further on turns the sign of odd indices, which stand in the second half
            near = spectrum[:, np.searchsorted(wanted, some + hop)]
            far = spectrum[:, np.searchsorted(wanted, some + hop + 1)]
            window = np.concatenate([near[:block] + far[:block], near[block:] + (_ABOVE - far[block:])])
            twice = _backward(_reduce(own * window))[:block] << np.uint64(1)
            at = (some + hop)[None, :] * block + np.arange(block)[:, None]
            twice -= energy[some * block][None, :] + energy[at]
            zero = (twice == 0) | (twice == np.uint64(2 * PRIME)) | (twice == np.uint64(4 * PRIME))
            offset, column = np.nonzero(zero)
            yield hop, some[column], hop * block + offset


# ---- runs -------------------------------------------------------------------------------------


def _same(ids: np.ndarray, a: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Whether the n words from each place equal those d words later."""
    out = np.zeros(len(a), bool)
    step = max(1, CELLS // n)
    for k in range(0, len(a), step):
        at = a[k : k + step, None] + np.arange(n)
        out[k : k + step] = (ids[at] == ids[at + d[k : k + step, None]]).all(1)
    return out


def _extend(ids: np.ndarray, at: np.ndarray, d: np.ndarray, limit: np.ndarray, way: int) -> np.ndarray:
    """How many words in direction ``way`` from ``at`` equal those d later, ``limit`` at most."""
    out = np.zeros(len(at), np.int64)
    live, width = np.flatnonzero(limit > 0), 32
    while len(live):
        going = []
        for some in np.array_split(live, max(1, len(live) * width // CELLS)):
            left = limit[some] - out[some]
            k = out[some, None] + np.minimum(np.arange(width), left[:, None] - 1)
            place = at[some, None] + way * k
            bad = ids[place] != ids[place + d[some, None]]
            bad |= np.arange(width) >= left[:, None]
            stop = bad.any(1)
            out[some] += np.where(stop, bad.argmax(1), width)
            going.append(some[~stop])
        live, width = np.concatenate(going), min(2 * width, 4096)
    return out


def find_runs(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Runs (start, length, period) by start, then period, of each sequence of word numbers."""
    size = np.array([len(t) for t in texts], np.int64)
    longest = int(size.max(initial=0))
    if longest < LEAST:
        return [np.zeros((0, 3), np.int64) for _ in texts]
    end = np.cumsum(size)
    begin = end - size
    flat = np.concatenate(texts)
    known = np.zeros((0, 3), np.int64)  # start, end, period in the flat sequence
    block = FIRST
    while block == FIRST or TIMES * block <= longest:
        last = 2 * block > LAST
        hops = range(0, 2) if block == FIRST else range(1, 2)
        if last:
            hops = range(hops[0], max(hops[-1], longest // TIMES // block) + 1)
        n_rows = -(-len(flat) // block)
        ids = np.concatenate([flat, np.full((n_rows + hops[-1] + 2) * block - len(flat), -1)])
        rows = np.arange(n_rows)
        text = np.searchsorted(end, rows * block, side="right")
        text = np.minimum(text, len(size) - 1)
        fits = (size[text] >= max(LEAST, TIMES * block)) & (rows * block + 2 * block <= end[text] + FIRST)
        found = []
        shorter = known  # runs of periods up to the block
        for hop, row, d in _occurrences(ids, rows[fits], block, hops):
            a, t = row * block, text[row]
            keep = (d > 0) & (a + block + d <= end[t])
            a, d, t = a[keep], d[keep], t[keep]
            if len(shorter):  # a block that lies in a run with its copy is that run again
                order = np.argsort(shorter[:, 0], kind="stable")
                reach = np.maximum.accumulate(shorter[order, 1])
                i = np.searchsorted(shorter[order, 0], a, side="right") - 1
                fresh = (i < 0) | (reach[np.maximum(i, 0)] < a + block + d)
                a, d, t = a[fresh], d[fresh], t[fresh]
            true = _same(ids, a, d, block)
            a, d, t = a[true], d[true], t[true]
            order = np.lexsort((a, d))
            a, d, t = a[order], d[order], t[order]
            # blocks in a row at one distance belong together
            new = np.ones(len(a), bool)
            new[1:] = (d[1:] != d[:-1]) | (a[1:] != a[:-1] + block) | (t[1:] != t[:-1])
            head = np.flatnonzero(new)
            tail = np.concatenate([head[1:], [len(a)]])[: len(head)] - 1
            d, t, left, right = d[head], t[head], a[head], a[tail] + block
            left = left - _extend(ids, left - 1, d, left - begin[t], -1)
            right = right + d + _extend(ids, right, d, end[t] - right - d, 1)
            long = right - left >= np.maximum(LEAST, TIMES * d)
            found.append(np.stack([left, right, d], 1)[long])
            if block == FIRST and hop == 0:
                shorter = np.unique(np.concatenate([shorter, found[-1]]), axis=0)
        known = np.unique(np.concatenate([known, *found]), axis=0)
        if last:
            break
        block *= 2
    known = known[np.lexsort((known[:, 2], -known[:, 1], known[:, 0]))]
    text = np.searchsorted(end, known[:, 0], side="right")
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    out = []
    for k in range(len(texts)):
        own = _smallest_periods(known[cuts[k] : cuts[k + 1]].tolist())
        kept = np.array([(s - begin[k], e - s, p) for s, e, p in own], np.int64).reshape(-1, 3)
        out.append(kept[np.lexsort((kept[:, 2], kept[:, 0]))])
    return out


def _smallest_periods(runs: list[list[int]]) -> list[list[int]]:
    """Runs without those inside a run of a shorter period, which is theirs too.

    ``runs`` (start, end, period) stand by start, then longest, then shortest period, so a run
    comes after all that hold it.
    """
    out, open_runs = [], []
    for s, e, p in runs:
        open_runs = [r for r in open_runs if r[1] > s]
        if not any(r[1] >= e and r[2] < p for r in open_runs):
            out.append([s, e, p])
            open_runs.append([s, e, p])
    return out


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds after its first period, one space apart."""
    if not len(runs):
        return b" ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    stay = np.cumsum(step[:-1]) == 0
    return b" ".join([words[i] for i in np.flatnonzero(stay)])


def with_runs(df: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """All columns, the runs of the text (start, length, period) and the text with one period of each."""
    # the text stays under a name of its own while a column of that name is replaced
    df = df.select(*[c for c in df.columns if c == text or c not in (runs, collapsed)])
    rest = [f for f in df.schema if f.name not in (runs, collapsed)]
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rest)
    found_type = pa.list_(
        pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    )

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames):
            found, left = [], []
            for _, some in parts(binary_column(b, text)):
                number: dict[bytes, int] = {}
                words = [t.split() for t in some]
                ids = [np.array([number.setdefault(w, len(number)) for w in ws], np.int64) for ws in words]
                for ws, r in zip(words, find_runs(ids), strict=True):
                    found.append([{"start": s, "length": n, "period": p} for s, n, p in r.tolist()])
                    left.append(collapse(ws, r))
            cols = [b.column(b.schema.get_field_index(f.name)) for f in rest]
            cols += [pa.array(found, found_type), pa.array(left, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(cols, [*[f.name for f in rest], runs, collapsed])

    added = f"`{runs}` array<struct<start: bigint, length: bigint, period: bigint>>, `{collapsed}` string"
    return df.mapInArrow(run, f"{schema}, {added}" if schema else added)
