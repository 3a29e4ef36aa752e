"""Words and shingles of many texts at once, as offsets into one buffer (numpy, inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p)
    for p in (
        0x9E3779B185EBCA87,
        0xC2B2AE3D27D4EB4F,
        0x165667B19E3779F9,
        0x85EBCA77C2B2AE63,
        0x27D4EB2F165667C5,
    )
)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Shingles of this many bytes and more are rare; they are hashed one by one.
_LONG = 256


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64_slices(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of ``buf[start:end]`` for every pair of offsets, all slices of one length at a time."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    w8 = np.ndarray((len(padded) - 7,), "<u8", buffer=padded, strides=(1,))
    w4 = np.ndarray((len(padded) - 3,), "<u4", buffer=padded, strides=(1,))
    size = end - start
    out = np.empty(len(start), np.uint64)
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.diff(size[order])) + 1
    for at in np.split(order, cuts):
        if not len(at):
            continue
        n, p = int(size[at[0]]), start[at]
        if n >= _LONG:
            out[at] = [xxhash.xxh64_intdigest(buf[a : a + n].tobytes(), seed) for a in p]
            continue
        s = np.uint64(seed)
        i = 0
        if n >= 32:
            v = [np.full(len(at), s, np.uint64) for _ in range(4)]
            v[0], v[1], v[3] = v[0] + _P1 + _P2, v[1] + _P2, v[3] - _P1
            while i + 32 <= n:
                v = [_round(v[k], w8[p + (i + 8 * k)]) for k in range(4)]
                i += 32
            h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for x in v:
                h = (h ^ _round(np.uint64(0), x)) * _P1 + _P4
        else:
            h = np.full(len(at), s, np.uint64) + _P5
        h = h + np.uint64(n)
        while i + 8 <= n:
            h = _rotl(h ^ _round(np.uint64(0), w8[p + i]), 27) * _P1 + _P4
            i += 8
        if i + 4 <= n:
            h = _rotl(h ^ (w4[p + i].astype(np.uint64) * _P1), 23) * _P2 + _P3
            i += 4
        while i < n:
            h = _rotl(h ^ (padded[p + i].astype(np.uint64) * _P5), 11) * _P1
            i += 1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        out[at] = h ^ (h >> np.uint64(32))
    return out


def parts(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``most`` bytes, with the place of the first."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, texts[first:]


def word_offsets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, starts, ends, words per text): lower-case words, one space apart, in one buffer."""
    blob = np.frombuffer((b"\n".join(texts) + b"\n").lower(), np.uint8)
    white = _WHITE[blob]
    after_word = np.empty(len(blob), bool)
    after_word[0] = False
    np.logical_not(white[:-1], out=after_word[1:])
    keep = ~white | after_word
    place = np.flatnonzero(keep)
    buf = np.where(white[place], np.uint8(32), blob[place])
    ends = np.flatnonzero(buf == 32)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    sizes = np.array([len(t) + 1 for t in texts])
    # words up to the end of each text
    upto = np.searchsorted(place[starts] if len(starts) else starts, np.cumsum(sizes))
    return buf, starts, ends, np.diff(np.concatenate([[0], upto]))


def shingle_offsets(
    starts: np.ndarray, ends: np.ndarray, words: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, shingles per text); a text with fewer words is one shingle."""
    count = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    first_word = np.cumsum(words) - words
    text = np.repeat(np.arange(len(words)), count)
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    a = first_word[text] + inside
    b = np.minimum(a + width, first_word[text] + words[text]) - 1
    return starts[a], ends[b], count
