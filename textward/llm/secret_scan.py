"""Secrets in texts: known forms, and windows of high Shannon entropy per character class.

Candidates are the longest runs of a class's characters.  A window slides over each candidate;
its character counts, and with them its entropy, change by one character in and one out.  Windows
at or above the entropy of their class are joined to spans; an allow list suppresses spans that
only look random (written-out alphabets, identifiers of versions and digests, documented examples).

Cases: a null or empty text has no spans.  Texts are scanned alone and whole, so repeated rows and
other rows do not matter; all other columns (null or not) pass through, and an input column named
like the added one is replaced.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, binary_column
from .shingles import parts

# ---- known forms ------------------------------------------------------------------------------

#: kind, pattern, least characters, group that counts.  ASCII letters in either case for `assign`.
FORMS = (
    (
        "assign",
        re.compile(
            rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
            re.IGNORECASE,
        ),
        8,
        2,
    ),
    ("access", re.compile(rb"AKIA[A-Z0-9]+"), 16, 0),
    ("hex", re.compile(rb"[0-9a-f]+"), 32, 0),
)
#: A text without any of these (in lower case) has no `assign`.
_ASSIGN_WORDS = (b"passw", b"secret", b"token", b"api")


def _table(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode())] = True
    return out


_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


# ---- classes ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class CharacterClass:
    """Characters, window, least entropy in bits, and kinds of characters a window must hold."""

    kind: str
    characters: str
    window: int
    bits: float
    needs: tuple[str, ...]


CLASSES = (
    CharacterClass("entropy_hex", _DIGITS + "abcdefABCDEF", 24, 3.0, (_DIGITS, "abcdefABCDEF")),
    CharacterClass("entropy_base64", _LOWER + _UPPER + _DIGITS + "+/_-", 24, 3.9, (_LOWER, _UPPER, _DIGITS)),
)
#: Spans that hold one of these, in any letter case, are documented examples.
ALLOWED_PARTS = ("example", "sample", "dummy", "placeholder")
#: Words before a span (a mark from ` :=-"'` between) that make it an identifier in public use.
ALLOWED_LABELS = ("sha1", "sha224", "sha256", "sha384", "sha512", "md5", "etag", "commit", "revision")
#: Identifiers of this form are public, too.
_UUID = re.compile(rb"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: All kinds in the order of spans that start together.
KINDS = (*[f[0] for f in FORMS], *[c.kind for c in CLASSES])

#: Windows of one piece of a candidate: the steps of a batch of pieces are bounded by it.
PIECE = 256
#: Pieces that slide together.
TOGETHER = 2048
#: Terms c * log2(c) of the entropy are whole numbers of this part of a bit, so sums are exact.
UNIT = 1 << 20


def weights(window: int) -> np.ndarray:
    """c * log2(c) for counts up to the window, in units."""
    c = np.arange(window + 1)
    return np.round(c * np.log2(np.maximum(c, 1)) * UNIT).astype(np.int64)


def most_weight(cls: CharacterClass) -> int:
    """The sum of weights up to which a window has at least the entropy of its class."""
    return int(np.floor(cls.window * (np.log2(cls.window) - cls.bits) * UNIT))


def _high_windows(buf: np.ndarray, first: np.ndarray, cls: CharacterClass) -> np.ndarray:
    """Starts of windows of high entropy among ``PIECE`` windows from each place of ``first``.

    ``buf`` holds only candidates' characters where windows start; pieces are cut by the caller so
    that every window lies in its candidate: ``first`` is (place, windows) per row.
    """
    w, weight, limit = cls.window, weights(cls.window), most_weight(cls)
    kinds = np.stack([_table(k) for k in cls.needs]).astype(np.int64)
    out = []
    for k in range(0, len(first), TOGETHER):
        place, n = first[k : k + TOGETHER].T
        rows = np.arange(len(place))
        counts = np.zeros((len(place), 256), np.int16)
        total = np.zeros(len(place), np.int64)
        held = np.zeros((len(kinds), len(place)), np.int64)
        for step in range(w - 1 + int(n.max())):
            live = rows[n + w - 1 > step]
            c = buf[place[live] + step]
            before = counts[live, c]
            counts[live, c] = before + 1
            total[live] += weight[before + 1] - weight[before]
            held[:, live] += kinds[:, c]
            if step < w - 1:
                continue
            start = place[live] + step - w + 1
            out.append(start[(total[live] <= limit) & (held[:, live] > 0).all(0)])
            c = buf[start]
            before = counts[live, c]
            counts[live, c] = before - 1
            total[live] += weight[before - 1] - weight[before]
            held[:, live] -= kinds[:, c]
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


def _runs(mask: np.ndarray, least: int) -> np.ndarray:
    """(start, end) of the stretches of a mask that are long enough."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    runs = edge.reshape(-1, 2)
    return runs[runs[:, 1] - runs[:, 0] >= least]


def _pieces(runs: np.ndarray, window: int) -> np.ndarray:
    """(place, windows) that cover every window of the candidates."""
    n = runs[:, 1] - runs[:, 0] - window + 1
    count = -(-n // PIECE)
    part = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.stack(
        [np.repeat(runs[:, 0], count) + part * PIECE, np.minimum(np.repeat(n, count) - part * PIECE, PIECE)], 1
    )


def _allowed(data: bytes, buf: np.ndarray, a: int, b: int) -> bool:
    """Whether a span only looks like a secret."""
    text = data[a:b]
    low = text.lower()
    if any(x.encode() in low for x in ALLOWED_PARTS) or _UUID.search(text):
        return True
    before = data[max(0, a - 16) : a].lower().rstrip(b" :=-\"'")
    if any(before.endswith(x.encode()) for x in ALLOWED_LABELS):
        return True
    step = np.abs(np.diff(buf[a:b].astype(np.int64)))
    return 2 * int((step == 1).sum()) >= len(step)  # written-out alphabets and numbers


def entropy_spans(data: bytes, classes: tuple[CharacterClass, ...] = CLASSES) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes of joined windows of high entropy that no rule allows."""
    buf = np.frombuffer(data, np.uint8)
    out = []
    for cls in classes:
        runs = _runs(_table(cls.characters)[buf], cls.window)
        if not len(runs):
            continue
        start = _high_windows(buf, _pieces(runs, cls.window), cls)
        if not len(start):
            continue
        # windows that overlap or touch are one span; candidates are at least a character apart
        new = np.concatenate([[True], np.diff(start) > cls.window])
        new |= np.concatenate([[True], np.diff(np.searchsorted(runs[:, 0], start, side="right")) > 0])
        head = np.flatnonzero(new)
        tail = np.concatenate([head[1:], [len(start)]]) - 1
        for a, b in zip(start[head].tolist(), (start[tail] + cls.window).tolist(), strict=True):
            if not _allowed(data, buf, a, b):
                out.append((cls.kind, a, b))
    return out


def form_spans(data: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes of the known forms, leftmost and apart within a kind."""
    out = []
    buf = np.frombuffer(data, np.uint8)
    for kind, pattern, least, group in FORMS:
        if kind == "hex":  # stretches of one class need no pattern
            out += [(kind, a, b) for a, b in _runs(_HEX[buf], least).tolist()]
            continue
        if kind == "assign":
            low = data.lower()
            if not any(x in low for x in _ASSIGN_WORDS):
                continue
        out += [(kind, *m.span()) for m in pattern.finditer(data) if m.end(group) - m.start(group) >= least]
    return out


_HEX = _table(_DIGITS + "abcdef")
_BOTH = _table("".join(c.characters for c in CLASSES))


def scan(texts: list[bytes]) -> list[list[tuple[str, int, int]]]:
    """Spans (kind, start, end; code points) of UTF-8 texts by start, then kind.

    A window span that lies in a known form adds nothing and is left out.
    """
    out: list[list[tuple[str, int, int]]] = []
    order = {k: i for i, k in enumerate(KINDS)}
    for _, some in parts(texts):
        # one look at all texts finds those with a long candidate; a line break ends each text
        whole = np.frombuffer(b"\n".join([*some, b""]), np.uint8)
        end = np.cumsum([len(t) + 1 for t in some])
        runs = _runs(_BOTH[whole], min(c.window for c in CLASSES))
        candidate = np.zeros(len(some) + 1, bool)
        candidate[np.searchsorted(end, runs[:, 0], side="right")] = True
        for t, has in zip(some, candidate.tolist(), strict=False):
            spans = form_spans(t)
            if has:
                known = list(spans)
                spans += [s for s in entropy_spans(t) if not any(a <= s[1] and s[2] <= b for _, a, b in known)]
            if spans and not t.isascii():
                # bytes that start a character, up to each place
                at = np.cumsum(np.concatenate([[0], (np.frombuffer(t, np.uint8) & 0xC0) != 0x80]))
                spans = [(k, int(at[a]), int(at[b])) for k, a, b in spans]
            out.append(sorted(spans, key=lambda s: (s[1], order[s[0]], s[2])))
    return out


def with_secrets(df: DataFrame, text: str = "text", name: str = "secrets") -> DataFrame:
    """All columns and the secrets of a text, an array of (kind, start, end)."""
    rest = [f for f in df.schema if f.name != name]
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rest)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames):
            found = [
                [{"kind": k, "start": s, "end": e} for k, s, e in spans] for spans in scan(binary_column(b, text))
            ]
            cols = [b.column(b.schema.get_field_index(f.name)) for f in rest]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(found, kind)], [*[f.name for f in rest], name])

    added = f"`{name}` array<struct<kind: string, start: bigint, end: bigint>>"
    return df.mapInArrow(run, f"{schema}, {added}" if schema else added)


def listed(secrets: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """Spans of some kinds as text: ``kind:start:end``, comma-joined."""
    of = F.filter(secrets, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
