"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are compared part by part.  Correlated bits share a part; each part gets its own
threshold, so that two fingerprints within ``tau`` bits agree within the threshold in at least
one part (the thresholds add up to tau - parts + 1).  Dynamic programming picks the thresholds
with the fewest probes and candidates, estimated from the bit statistics of all fingerprints.
Fingerprints that meet in a probe are verified on all 64 bits.

Cases: a null or empty text has fingerprint zero and links like any other; rows without id
take part, a group's id is its smallest id and null if no row has one; repeated rows are one
fingerprint; an empty table gives an empty result.  ``add_fingerprint`` replaces a column of the
name it adds; the other helpers give their helper columns names the table does not have.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, binary_column, fresh_name, stage
from .components import components
from .shingles import parts, shingle_offsets, word_offsets, xxh64_slices

WIDTH = 4
TAU = 4
#: Two parts of 32 bits: candidates stay few up to 2^32 fingerprints.
PARTS = 2
#: Probes with more fingerprints than this go the exact way for crowded probes.
CROWD = 1024

#: Each bit of a byte in a lane of its own, so 255 bytes can be added at once.
_LANES = np.array([sum(((x >> k) & 1) << (8 * k) for k in range(8)) for x in range(256)], np.uint64)


def _vote(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Fingerprint of each run of ``count`` hashes: a bit is 1 if set in over half of them."""
    out = np.zeros(len(count), np.uint64)
    full = np.flatnonzero(count)
    if not len(full):
        return out
    n = count[full]
    blocks = -(-n // 255)
    block_start = np.repeat(np.cumsum(n) - n, blocks) + 255 * (
        np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    )
    lanes = _LANES[np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(lanes, block_start, axis=0)
    votes = np.add.reduceat(
        sums.view(np.uint8).reshape(-1, 64).astype(np.int64), np.cumsum(blocks) - blocks, axis=0
    )
    bits = votes * 2 > n[:, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def simhash(texts: list[bytes], width: int = WIDTH) -> np.ndarray:
    """64-bit fingerprints (uint64) of UTF-8 texts."""
    out = np.zeros(len(texts), np.uint64)
    for first, some in parts(texts):
        buf, starts, ends, words = word_offsets(some)
        a, b, count = shingle_offsets(starts, ends, words, width)
        out[first : first + len(some)] = _vote(xxh64_slices(buf, a, b), count)
    return out


def add_fingerprint(df: DataFrame, text: str = "text", name: str = "fp", width: int = WIDTH) -> DataFrame:
    """All columns of ``df`` and the fingerprint ``name`` as a bigint with the same bits."""
    df = df.drop(name)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames):
            fp = simhash(binary_column(b, text), width).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp)], [*b.schema.names, name])

    return df.mapInArrow(run, f"{schema}, `{name}` bigint")


# ---- plan of the probes ---------------------------------------------------------------------


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """(fingerprints, 64 x 64 counts of bits set together) over all rows of (fp)."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64), np.int64)
        for b in batches(frames):
            fp = b.column(0).to_numpy().view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(fp, axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(4096)), pa.array(total.ravel())], ["cell", "n"]
        )

    cells = prints.select("fp").mapInArrow(run, "cell bigint, n bigint")
    rows = cells.groupBy("cell").agg(F.sum("n").alias("n")).collect()
    table = np.zeros(4096)
    for r in rows:
        table[r["cell"]] = r["n"]
    return prints.count(), table.reshape(64, 64)


def correlated_parts(n: int, together: np.ndarray, m: int = PARTS) -> list[list[int]]:
    """Bits in ``m`` parts of (nearly) equal width; a part takes the bits closest to its own."""
    p = together.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    near = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(near, 0)
    free, out = set(range(64)), []
    for k in range(m):
        width = (len(free) + m - k - 1) // (m - k)
        own = [max(free, key=lambda i: (near[i, sorted(free)].sum(), -i))]
        free.remove(own[0])
        while len(own) < width:
            best = max(free, key=lambda i: (near[i, own].sum(), -i))
            own.append(best)
            free.remove(best)
        out.append(sorted(own))
    return out


def flips(bits: list[int], radius: int) -> list[int]:
    """Masks of up to ``radius`` bits of a part."""
    return [
        reduce(lambda x, i: x | (1 << i), c, 0) for r in range(radius + 1) for c in combinations(bits, r)
    ]


def allocate(n: int, together: np.ndarray, bits: list[list[int]], tau: int = TAU) -> list[int]:
    """Threshold of each part: least probes and candidates, adding up to tau - parts + 1.

    A pair of fingerprints differs in bit i with probability 2p(1-p); the number of differing
    bits of a part follows from that, and with it the pairs within each threshold.  -1 leaves
    a part out.
    """
    p = together.diagonal() / max(n, 1)
    costs = []
    for own in bits:
        dist = np.array([1.0])
        for i in own:
            q = 2 * p[i] * (1 - p[i])
            dist = np.convolve(dist, [1 - q, q])
        within = np.cumsum(dist)
        cost = {-1: 0.0}
        for t in range(tau + 1):
            cost[t] = len(flips(own, (t + 1) // 2)) * n + within[min(t, len(within) - 1)] * n * n / 2
        costs.append(cost)
    goal = tau - len(bits) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (c, ts) in best.items():
            for t, more in cost.items():
                option = (c + more, [*ts, t])
                if total + t not in step or option < step[total + t]:
                    step[total + t] = option
        best = step
    return best[goal][1]


# ---- probe and verify -----------------------------------------------------------------------


def _probes(prints: DataFrame, bits: list[list[int]], thresholds: list[int]) -> DataFrame:
    """(key, fp): the values of each part within half its threshold.

    Fingerprints within the threshold share a value.  For an odd threshold the outermost step
    is only taken from 0 to 1, which one of two different values always can.
    """
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keys = []
    for own, t in zip(bits, thresholds, strict=True):
        if t < 0:
            continue
        part = F.col("fp").bitwiseAND(F.lit(signed(sum(1 << i for i in own))).cast("bigint"))
        array = lambda masks: F.array(*[F.lit(signed(x)).cast("bigint") for x in masks])
        masks = array(flips(own, t // 2))
        if t == 1:
            up = F.filter(array([1 << i for i in own]), lambda x: F.col("fp").bitwiseAND(x) == 0)
            masks = F.concat(masks, up)
        elif t % 2:
            masks = array(flips(own, (t + 1) // 2))
        keys.append(F.transform(masks, part.bitwiseXOR))
    return prints.select(F.explode(F.concat(*keys)).alias("key"), "fp")


def _forest(fp: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that join the fingerprints of a probe which are within ``tau`` in steps."""
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= tau
    label = np.arange(len(fp))
    while True:
        least = np.where(near, label[None, :], len(fp)).min(axis=1)
        least = np.minimum(least, least[least])
        if (least == label).all():
            break
        label = least
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return fp[moved], fp[label[moved]]


def _verify(tau: int, crowd: int):
    """Walk over sorted (key, fp): links inside each key; (fp, fp) marks members of a crowd."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, np.zeros(0, np.uint64)  # the run that may go on in the next batch
        crowded = False

        def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            cols = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (a, b)]
            return pa.RecordBatch.from_arrays(cols, ["a", "b"])

        def close(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return (fp, fp) if len(fp) > crowd else _forest(fp, tau)

        for batch in batches(frames):
            keys = batch.column(0).to_numpy()
            fps = batch.column(1).to_numpy().view(np.uint64)
            if held_key is not None and keys[0] == held_key:
                keys = np.concatenate([np.full(len(held), held_key), keys])
                fps = np.concatenate([held, fps])
            elif len(held) > 1:
                yield out(*((held, held) if crowded else close(held)))
                crowded = False
            else:
                crowded = False
            starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
            sizes = np.diff(np.concatenate([starts, [len(keys)]]))
            last = starts[-1]
            if crowded and len(starts) > 1:  # the crowd ended inside this batch
                yield out(fps[: starts[1]], fps[: starts[1]])
                starts, sizes = starts[1:], sizes[1:]
                crowded = False
            body, size = starts[:-1], sizes[:-1]
            two = body[size == 2]
            x, y = fps[two], fps[two + 1]
            near = np.bitwise_count(x ^ y) <= tau
            a, b = [x[near]], [y[near]]
            for s, k in zip(body[size > 2], size[size > 2], strict=True):
                p, q = close(fps[s : s + k])
                a.append(p)
                b.append(q)
            yield out(np.concatenate(a), np.concatenate(b))
            held_key, held = keys[-1], fps[last:]
            if len(held) > crowd:  # marked and let go, so a crowd of any size fits
                yield out(held, held)
                crowded, held = True, held[-1:]
        if len(held) > 1:
            yield out(*((held, held) if crowded else close(held)))

    return run


def _crowd_links(crowd: DataFrame, tau: int) -> DataFrame:
    """Links among the fingerprints of crowded probes, in work proportional to their number.

    Two values within ``tau`` share a value within ceil(tau / 2) of both, and all that share
    one are linked in steps, so each value keeps one star and no pair is looked at.
    """
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    masks = F.array(*[F.lit(signed(x)).cast("bigint") for x in flips(list(range(64)), tau // 2)])
    ball = crowd.select("fp", F.explode(masks).alias("m")).select(
        F.col("fp").bitwiseXOR(F.col("m")).alias("key"), "fp"
    )
    # one shuffle and a walk: at most 2,081 values share a key, and no side is built up as a table
    dealt = ball.repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(_stars, "a bigint, b bigint").distinct()


def _stars(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk over sorted (key, fp): a link from each fingerprint to the first one of its key."""
    held: tuple[int, int] | None = None  # key and first fingerprint of the run that may go on
    for batch in batches(frames):
        keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        start = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
        first = fps[start].copy()
        if held is not None and held[0] == keys[0]:
            first[0] = held[1]
        to = np.repeat(first, np.diff(np.concatenate([start, [len(keys)]])))
        held = (int(keys[-1]), int(first[-1]))
        far = fps != to
        yield pa.RecordBatch.from_arrays([pa.array(fps[far]), pa.array(to[far])], ["a", "b"])


def links(prints: DataFrame, tau: int = TAU, m: int = PARTS, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp) that give the groups within ``tau``."""
    if tau % 2:
        raise ValueError("tau must be even")
    n, together = bit_statistics(prints)
    bits = correlated_parts(n, together, m)
    probes = _probes(prints, bits, allocate(n, together, bits, tau))
    dealt = probes.repartition("key").sortWithinPartitions("key", "fp")
    found = stage(dealt.mapInArrow(_verify(tau, crowd), "a bigint, b bigint"), "simhash-links")
    crowded = found.where("a = b").select(F.col("a").alias("fp")).distinct()
    out = found.where("a <> b")
    return out if crowded.isEmpty() else out.unionAll(_crowd_links(stage(crowded, "simhash-crowd"), tau))


def groups(rows: DataFrame, key: str = "doc_id", tau: int = TAU, crowd: int = CROWD) -> DataFrame:
    """(fp, group, component_id, n_first, has_first) for each distinct fingerprint of rows (key, fp).

    ``group`` is the smallest fingerprint of the group, ``component_id`` its smallest id,
    ``n_first`` the number of rows with that id, and ``has_first`` whether the fingerprint has one.
    """
    per_id = rows.groupBy("fp", F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    first = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("n").alias("n"))
    distinct = stage(per_id.groupBy("fp").agg(F.min(first).alias("f")), "simhash-prints")
    roots = stage(components(links(distinct, tau, crowd=crowd)), "simhash-roots")
    labelled = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", F.coalesce("root", "fp").alias("group"), "f"
    )
    labelled = stage(labelled, "simhash-labels")
    # a smallest id may stand with several fingerprints of its group
    least = labelled.groupBy("group").agg(F.min(F.struct("f.none", "f.id")).alias("g"))
    same = labelled.join(least, "group").where(F.col("f.id").eqNullSafe(F.col("g.id")))
    sums = same.groupBy("group").agg(F.sum("f.n").alias("n_first"), F.first("g.id").alias("component_id"))
    first = F.col("f.id").eqNullSafe(F.col("component_id")).alias("has_first")
    out = labelled.join(sums, "group").select("fp", "group", "component_id", "n_first", first)
    return stage(out, "simhash-groups")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", tau: int = TAU, crowd: int = CROWD) -> DataFrame:
    """(key, fingerprint, component_id) of every row."""
    prints = stage(add_fingerprint(df.select(F.col(key).alias("id"), F.col(text).alias("text"))).select("id", "fp"), "simhash")
    found = prints.join(groups(prints, "id", tau, crowd), "fp")
    return found.select(
        F.col("id").alias(key),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", tau: int = TAU) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest id.

    Rows that repeat the smallest id are cut to one of them.
    """
    names = df.columns
    fp, near, least, group, n = (fresh_name(df, x) for x in ("fp__", "near__", "least__", "group__", "n__"))
    marked = add_fingerprint(df, text, fp)
    prints = stage(marked.select(F.col(key).alias("id"), F.col(fp).alias("fp")), "simhash")
    first = groups(prints, "id", tau).where("has_first")
    first = first.select(
        F.col("fp").alias(near), F.col("component_id").alias(least), F.col("group").alias(group), F.col("n_first").alias(n)
    )
    # copies of a text share the fingerprint but not the id, so they spread over the tasks
    at = (F.col(fp) == F.col(near)) & F.col(key).eqNullSafe(F.col(least))
    kept = marked.join(first.hint("shuffle_hash"), at)
    out = kept.where(F.col(n) == 1).select(*names)
    if first.where(F.col(n) > 1).isEmpty():
        return out
    return out.unionByName(kept.where(F.col(n) > 1).dropDuplicates([group]).select(*names))
