"""Token counts of byte-level BPE by rank-synchronous merging of ragged arrays.

Distinct pre-tokens of a batch lie one after the other in one array of symbols.  In each round
every pre-token finds its pair of lowest rank and merges all its places at once; pre-tokens
without a pair leave, and what is left of them is their number of tokens.

Cases: a null or empty text has 0 bytes and 0 tokens; special strings in a text are one token
each; repeated rows get equal counts; an empty table gives an empty result.  Added columns
replace those of the same name.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches
from .shingles import parts

#: Fixed value: the pattern that cuts a text before the merges of this vocabulary family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LIMIT = 512
#: Pre-tokens whose counts a task remembers; it forgets all of them when there are more.
REMEMBERED = 300_000
_NONE = np.iinfo(np.int64).max


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """Pairs of a byte-level BPE file as sorted arrays: pair key, rank, merged symbol."""

    def __init__(self, spec: dict):
        model = spec["model"]
        cut = spec["pre_tokenizer"]
        if model["type"] != "BPE" or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("only plain byte-level BPE files are counted")
        vocab = model["vocab"]
        self.size = max(vocab.values()) + 1
        self.byte_ids = np.array([vocab[c] for _, c in sorted(_byte_letters().items())], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.keys, self.ranks = key[order], np.arange(len(pairs))[order]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        added = spec.get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens must be plain strings")
        self.special = sorted((t["content"] for t in added), key=len, reverse=True)

    @classmethod
    def load(cls, path: str) -> Merges:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def count(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols left of each (non-empty) pre-token."""
        length = np.array([len(t) for t in tokens], np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(tokens), np.uint8)]
        owner = np.arange(len(tokens))
        out = length.copy()
        while len(symbols):
            start = np.cumsum(length) - length
            ranks = np.full(len(symbols), _NONE)
            ranks[:-1] = self.rank(symbols[:-1], symbols[1:])
            ranks[start + length - 1] = _NONE  # the last symbol has no partner
            low = np.minimum.reduceat(ranks, start)
            going = low < _NONE
            out[owner[~going]] = length[~going]
            inside = np.repeat(low, length)
            hit = (ranks == inside) & (inside < _NONE)
            # in a run of places such as aaa only every second pair can be merged
            place = np.flatnonzero(hit)
            fresh = np.ones(len(place), bool)
            fresh[1:] = place[1:] != place[:-1] + 1
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))
            place = place[(np.arange(len(place)) - first) % 2 == 0]
            symbols[place] = self.merged[ranks[place]]
            stay = np.repeat(going, length)
            stay[place + 1] = False
            gone = np.bincount(np.repeat(np.arange(len(length)), length)[place], minlength=len(length))
            symbols = symbols[stay]
            length, owner = (length - gone)[going], owner[going]
        return out


class Counter:
    """Counts the tokens of texts; remembers the counts of pre-tokens it has seen."""

    def __init__(self, merges: Merges):
        self.merges, self.known = merges, {}
        self.cut = regex.compile(PATTERN)
        self.special = regex.compile("|".join(regex.escape(s) for s in merges.special)) if merges.special else None

    def counts(self, texts: list[str]) -> list[int]:
        extra = [0] * len(texts)
        pieces = []
        for i, t in enumerate(texts):
            if self.special and any(s in t for s in self.merges.special):
                runs = self.special.split(t)
                extra[i] = len(runs) - 1
                pieces.append([x for r in runs for x in self.cut.findall(r)])
            else:
                pieces.append(self.cut.findall(t))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list({x for p in pieces for x in p if x not in self.known})
        if new:
            self.known.update(zip(new, self.merges.count([x.encode() for x in new]).tolist(), strict=True))
        get = self.known.__getitem__
        return [e + sum(map(get, p)) for e, p in zip(extra, pieces, strict=True)]


def count_tokens(df: DataFrame, vocabulary: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit``.

    ``vocabulary`` is the path of the file on the driver; its merges travel with the tasks.
    """
    added = ("n_bytes", "n_tokens", "over_limit")
    df = df.drop(*[c for c in df.columns if c.lower() in added])
    merges = Merges.load(vocabulary)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(merges)
        for b in batches(frames):
            texts = [x or "" for x in b.column(b.schema.get_field_index(text)).to_pylist()]
            n: list[int] = []
            for _, some in parts(texts, 1 << 21):
                n += counter.counts(some)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], [*b.schema.names, "n_tokens"])

    counted = df.mapInArrow(run, f"{schema}, n_tokens bigint")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")
    return counted.withColumns({"n_bytes": size, "over_limit": F.col("n_tokens") > limit})
