"""Plain versions of the operators for small inputs."""

import collections
import math
import re
import zlib

import numpy as np
import xxhash


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def az(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def fingerprint(text, width=4):
    w = words(az(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints, linked):
    """The smallest place of each one's group."""
    own = list(range(len(prints)))

    def top(x):
        while own[x] != x:
            x = own[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if linked(prints[i], prints[j]):
                a, b = top(i), top(j)
                own[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(prints))]


def line_key(line):
    return az(line.strip(" \t\n\x0b\x0c\r"))


def dedup_lines(rows, min_chars=40, min_docs=5):
    """(lines, dropped, text left) of rows (id, text)."""
    found = collections.defaultdict(set)
    for i, t in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                if len(line_key(x)) >= min_chars:
                    found[line_key(x)].add(i)
    gone = {k: max(v) for k, v in found.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or gone.get(line_key(x), i) == i]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def remove_repeats(texts, length):
    """(bytes, removed, spans, bytes left) of byte strings."""
    count = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        left = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), left))
    return out


def tiles(doc, item, least):
    """Greedy string tiling of two token lists by trying every pair of places."""
    used_d, used_i, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                k = 0
                while (
                    i + k < len(item)
                    and d + k < len(doc)
                    and item[i + k] == doc[d + k]
                    and i + k not in used_i
                    and d + k not in used_d
                ):
                    k += 1
                if k > best[0]:
                    best = (k, i, d)
        if best[0] < least:
            return out
        out.append(best)
        used_i.update(range(best[1], best[1] + best[0]))
        used_d.update(range(best[2], best[2] + best[0]))


def base_scores(rows):
    """(held out, tokens, known, N, base score) of rows (id, text)."""
    tokens = [[*words(az(t)), None] for _, t in rows]
    out = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c = collections.Counter(w for t, o in zip(tokens, out, strict=True) if not o for w in t)
    n, v = sum(c.values()), len(c)
    return [
        (o, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
        for t, o in zip(tokens, out, strict=True)
    ]


def water_levels(sizes, weights, most=3):
    """Targets of sources by repeated clamping."""
    clamped = np.zeros(len(sizes), bool)
    sizes, weights = np.array(sizes, float), np.array(weights, float)
    while True:
        left = sizes.sum() - most * sizes[clamped].sum()
        target = np.where(clamped, most * sizes, weights * left / max(weights[~clamped].sum(), 1e-9))
        above = ~clamped & (target > most * sizes)
        if not above.any():
            return target
        clamped |= above
