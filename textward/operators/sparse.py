"""Exact word-cosine search between two tables of texts, by postings and prefix filtering.

Every text is a vector of word counts.  Words are ordered by how many texts hold them, rare ones
first.  The rarest word two texts share bounds their cosine: it cannot exceed the product of what
both vectors weigh from that word on.  So a text is found by the words of its prefix alone, the
ones up to which the remainder still weighs ``min_score``, and two texts meet at a word only if
the product of their remainders there reaches the score.  Pairs that cannot pass are never built.

Long texts of one language meet at their common words nearly all, once for each word.  Where the
lists are longer in sum than the two tables multiplied, blocks of texts are multiplied instead:
common words as a matrix, rare ones by their postings inside the block.  Copies are one text there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.dataset import dataset
from pyarrow.fs import FileSystem, FileType
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import stage, stage_path
from .skew import LEAST_ROWS, SHARES, join_hot

#: Postings of one word and side that meet in one group; longer lists are cut.
POSTINGS = 4096
#: Words with a column of their own in products, texts of a block and side at most.
COMMON, BLOCK = 1024, 8_000
#: Distinct words of all texts of a block, on average at most; tasks that multiply blocks at most.
_ENTRIES, _TASKS = 6_000_000, 20_000
#: Blocks of a side at most as long as they hold fewer than ``BLOCK`` texts, and texts of a block at least.
_SPLITS, _LEAST = 6, 1000
#: Texts that are looked at together.
_SLICE = 1024
#: Cells of a tile of products, pairs of a batch.
_CELLS, _OUT = 1 << 20, 1 << 18
#: Meetings of postings that cost as much as the product of two texts.
_MEETING = 0.25
#: Slack for the order of summation; passing pairs are scored exactly afterwards.
_SLACK = 1e-9
#: The same for products in single precision.
_ROUGH = 1e-3
#: Common words of the first look, and rows by which those of a block are put in order.
_HEAD, _PIVOTS = 64, 16


def postings(texts: DataFrame) -> DataFrame:
    """``(id, word, n)``: the words of ``(id, text)`` with their counts; ids are unique."""
    rows = texts.where("id IS NOT NULL").select("id", F.explode(tokens("text")).alias("word"))
    return rows.groupBy("id", "word").agg(F.count(F.lit(1)).alias("n"))


def prefixes(rows: DataFrame, frequency: DataFrame, min_score: float) -> DataFrame:
    """``(id, word, rest)`` of the words by which a text can be found.

    ``rest`` is the share of the squared length from this word on, in order of ``frequency``
    ``(word, texts)``.
    """
    # a word may be in nearly all texts
    known = join_hot(rows, frequency, "word", "id")
    of_text = Window.partitionBy("id")
    onward = of_text.orderBy(F.desc("texts"), F.desc("word")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    squares = F.col("n") * F.col("n")
    weighed = known.select(
        "id", "word", (F.sum(squares).over(onward) / F.sum(squares).over(of_text)).alias("rest")
    )
    return weighed.where(F.col("rest") >= min_score * min_score - _SLACK)


def candidates(
    left: DataFrame, right: DataFrame, min_score: float, most: int = POSTINGS
) -> DataFrame:
    """``(left_id, right_id)``: pairs that meet at a word where they can still reach the score.

    Both sides as :func:`prefixes` gives them.  A list of more than ``most`` postings is cut into
    parts by hash of the id, and each part of one side meets each part of the other in a group of
    its own, so no word makes a task larger than ``most`` times ``most`` comparisons.
    """

    def parts(rows: DataFrame, name: str) -> DataFrame:
        n = rows.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        return n.select("word", F.ceil(F.col("n") / most).cast("int").alias(name))

    # words that only one side holds are of no use
    sizes = stage(parts(left, "lefts").join(parts(right, "rights"), "word"), "sparse-words")

    def placed(rows: DataFrame, own: str, other: str) -> DataFrame:
        known = join_hot(rows, sizes, "word", "id")
        return known.select(
            "id",
            "word",
            "rest",
            F.pmod(F.xxhash64("id"), F.col(own)).cast("int").alias(f"own_{own}"),
            F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"own_{other}"),
        )

    a = placed(left, "lefts", "rights").withColumnsRenamed({"id": "left_id", "rest": "left_rest"})
    b = placed(right, "rights", "lefts").withColumnsRenamed({"id": "right_id", "rest": "right_rest"})
    # the sizes of exploded lists are unknown to the planner, so neither side is broadcast
    met = a.hint("shuffle_merge").join(b, ["word", "own_lefts", "own_rights"])
    reach = F.col("left_rest") * F.col("right_rest") >= min_score * min_score - _SLACK
    return met.where(reach).select("left_id", "right_id").distinct()


def sparse_pairs(
    left: DataFrame, right: DataFrame, min_score: float, most: int = POSTINGS
) -> DataFrame:
    """``(left_id, right_id, score)``: all pairs of two tables ``(id, text)`` whose word counts
    have a cosine of at least ``min_score`` (at six decimals).

    Ids are unique; rows without id, and texts that are null or hold no word, take no part.
    """
    return _pairs(left, right, min_score, most, None)


def _pairs(left: DataFrame, right: DataFrame, min_score: float, most: int, k: int | None) -> DataFrame:
    """As :func:`sparse_pairs`; with ``k`` pairs that cannot be among the k best of a left text may
    be left out."""
    if not 0 < min_score <= 1:
        raise ValueError(f"min_score must be above 0 and at most 1, found {min_score}")
    low = min_score - 5e-7  # what rounds to the score
    own, other = vectors(left, "sparse-left"), vectors(right, "sparse-right")
    # a word's order must be the same for both sides
    both = own.select(F.explode("words").alias("word")).unionAll(other.select(F.explode("words").alias("word")))
    frequency = stage(both.groupBy("word").agg(F.count(F.lit(1)).alias("texts")), "sparse-order", tidy=True)
    # a word of one text alone counts for its length only
    ordered = frequency.where("texts > 1").orderBy(F.desc("texts"), F.desc("word"))
    common = [r["word"] for r in ordered.limit(COMMON).collect()]
    sizes = [rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("words")), F.lit(0))).first() for rows in (own, other)]
    few = sizes[0][0] * sizes[1][0] * _MEETING
    # where the common words alone meet more often, no list of postings is made
    met = [_common_postings(rows, common, low) for rows in (own, other)]
    starts = []
    if met[0] @ met[1] <= few:
        for rows, side in ((own, "left"), (other, "right")):
            listed = rows.select("id", F.explode(F.arrays_zip("words", "n")).alias("w")).select("id", "w.words", "w.n")
            found = prefixes(listed.withColumnRenamed("words", "word"), frequency, low)
            starts.append(stage(found, f"sparse-{side}-prefix", tidy=True))
    if not starts or _meetings(*starts) > few:
        scored = multiplied(own, other, common, low, sizes, k)
        return scored.where(F.round("score", 6) >= min_score)
    pairs = stage(candidates(*starts, low, most), "sparse-pairs", tidy=True)
    own, other = (
        rows.select(F.col("id").alias(f"{x}_id"), F.col("words").alias(f"{x}_words"), F.col("n").alias(f"{x}_n"))
        for x, rows in (("left", own), ("right", other))
    )
    # a text may be in very many pairs: salted on one side, left to the skew join on the other
    rows = join_hot(pairs, own, "left_id", "right_id")
    rows = rows.hint("shuffle_merge").join(other, "right_id")
    scored = rows.select("left_id", "right_id", "left_words", "left_n", "right_words", "right_n")
    scored = scored.mapInArrow(_score, _ids(pairs) + ", score double")
    return scored.where(F.round("score", 6) >= min_score)


# ---- vectors --------------------------------------------------------------------------------


def vectors(texts: DataFrame, name: str) -> DataFrame:
    """``(id, key, words, n)``, staged: the words of a text as sorted 64-bit hashes with their
    counts, and a digest of both.

    Words are counted in their row.  Texts that share an id count as one; only those are shuffled.
    Rows without id, and texts without a word, have none.
    """
    kind = texts.schema["id"].dataType.simpleString()
    schema = f"id {kind}, key binary, words array<bigint>, n array<int>"
    hashed = F.transform(tokens("text"), lambda w: F.xxhash64(w))
    rows = texts.where("id IS NOT NULL").select("id", hashed.alias("words"))
    rows = stage(rows.mapInArrow(_counted, schema), name, "zstd", tidy=True)
    several = rows.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("id")
    several = stage(several, f"{name}-repeated", tidy=True)
    if several.isEmpty():
        return rows
    listed = rows.join(several, "id", "left_semi").select("id", F.explode(F.arrays_zip("words", "n")).alias("w"))
    summed = listed.groupBy("id", F.col("w.words").alias("word")).agg(F.sum("w.n").cast("int").alias("n"))
    held = summed.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("w"))
    merged = held.select("id", F.col("w.word").alias("words"), F.col("w.n").alias("n")).mapInArrow(_keyed, schema)
    return stage(rows.join(several, "id", "left_anti").unionByName(merged), f"{name}-merged", "zstd", tidy=True)


def _digest(words: np.ndarray, n: np.ndarray) -> bytes:
    return hashlib.blake2b(words.tobytes() + n.tobytes(), digest_size=16).digest()


def _rows(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists one after the other, and where each list starts, to the end of the last."""
    at = words.offsets.to_numpy()
    return words.values.to_numpy()[at[0] : at[-1]], at - at[0]


def _vector_batch(ids: pa.Array, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    at = pa.array(np.cumsum([0, *(len(w) for w, _ in found)]), pa.int32())
    lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x))) for x in zip(*found, strict=True)]
    keys = pa.array([_digest(w, n) for w, n in found], pa.binary())
    return pa.RecordBatch.from_arrays([ids, keys, *lists], ["id", "key", "words", "n"])


def _counted(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words and counts of ``(id, words)``; rows without a word are left out."""
    for b in frames:
        b = b.filter(pc.fill_null(pc.greater(pc.list_value_length(b.column(1)), 0), False))
        if b.num_rows:
            value, at = _rows(b.column(1))
            found = [np.unique(value[x:y], return_counts=True) for x, y in zip(at[:-1], at[1:], strict=True)]
            yield _vector_batch(b.column(0), [(w, n.astype(np.int32)) for w, n in found])


def _keyed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(id, words, n)`` with the digest."""
    for b in frames:
        if b.num_rows:
            (word, at), (n, _) = _rows(b.column(1)), _rows(b.column(2))
            found = [(word[x:y], n[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
            yield _vector_batch(b.column(0), found)


class _Common:
    """Place of a word in the list of common words, the most frequent one first."""

    def __init__(self, common: list[int]) -> None:
        listed = np.array(common, np.int64)
        self.rank = np.argsort(listed)
        self.sorted = listed[self.rank]

    def of(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each word is listed, and the places of those that are."""
        if not len(self.sorted):
            return np.zeros(len(word), bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.sorted, word), len(self.sorted) - 1)
        held = self.sorted[at] == word
        return held, self.rank[at[held]]


def _common_postings(rows: DataFrame, common: list[int], low: float) -> np.ndarray:
    """How many texts have each common word in their prefix (see :func:`prefixes`)."""
    known, least = _Common(common), low * low - _SLACK

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(common), np.int64)
        for b in (frame.slice(lo, _SLICE) for frame in frames for lo in range(0, frame.num_rows, _SLICE)):
            (word, at), (n, _) = _rows(b.column(0)), _rows(b.column(1))
            squares, row = n.astype(np.float64) ** 2, np.repeat(np.arange(b.num_rows), np.diff(at))
            held, place = known.of(word)
            dense = np.zeros((b.num_rows, len(common)))
            dense[row[held], place] = squares[held]
            rest = np.cumsum(dense, 1) / np.bincount(row, squares, b.num_rows)[:, None]
            total += ((dense > 0) & (rest >= least)).sum(0)
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(total[place])], ["place", "n"])

    out = np.zeros(len(common))
    if common:
        counts = rows.select("words", "n").mapInArrow(run, "place int, n bigint")
        for r in counts.groupBy("place").agg(F.sum("n").alias("n")).collect():
            out[r["place"]] = r["n"]
    return out


def _meetings(left: DataFrame, right: DataFrame) -> float:
    """Pairs of postings of one word that would meet, in sum over the words."""
    count = lambda rows, name: rows.groupBy("word").agg(F.count(F.lit(1)).alias(name))
    met = count(left, "a").join(count(right, "b"), "word")
    return met.agg(F.coalesce(F.sum(F.col("a").cast("double") * F.col("b")), F.lit(0.0))).first()[0]


# ---- products of blocks ---------------------------------------------------------------------


def multiplied(
    own: DataFrame,
    other: DataFrame,
    common: list[int],
    low: float,
    sizes: list[tuple[int, int]],
    k: int | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """``(left_id, right_id, score)`` of all pairs that reach ``low``, by products of blocks.

    Both sides as :func:`vectors` gives them, ``sizes`` the texts and entries of each.  A block is
    stored once, in the shared folder; the task of a pair of blocks reads both, so nothing is copied
    for each block of the other side and no pair is shuffled.  Texts with the same word counts are
    one row of a block, and its members are named as pairs are given out.
    """
    spark = own.sparkSession
    # more blocks than cores where there are few texts, and never more than BLOCK of them in one
    parts = [
        max(-(-n // block), -(-entries // _ENTRIES), min(_SPLITS, -(-n // _LEAST)), 1) for n, entries in sizes
    ]
    paths = [_stored(rows, n, f"sparse-{x}-blocks") for rows, n, x in zip((own, other), parts, ("left", "right"), strict=True)]
    types = [rows.schema["id"].dataType.simpleString() for rows in (own, other)]
    tasks = spark.range(0, parts[0] * parts[1], 1, min(parts[0] * parts[1], _TASKS))
    run = _multiplier(paths, parts[1], common, low, k)
    return tasks.mapInArrow(run, f"left_id {types[0]}, right_id {types[1]}, score double")


def _stored(rows: DataFrame, parts: int, name: str) -> str:
    """Texts by block in the shared folder; copies stand together, but for very large groups of them."""
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    # fewer than 1/1000 of the texts, whatever these are
    hot = counts.where(F.col("_n") > max(rows.count() / SHARES, LEAST_ROWS)).select("key", F.lit(True).alias("_hot"))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("id"), F.lit(parts))).otherwise(0)
    dealt = rows.join(F.broadcast(hot), "key", "left")
    dealt = dealt.select("id", "key", "words", "n", F.pmod(F.xxhash64("key", salt), F.lit(parts)).cast("int").alias("block"))
    return stage_path(dealt.repartition(parts, "block"), name, "zstd", by="block")


class _Side:
    """Texts of one side of a block as arrays; copies are one row with several members."""

    def __init__(self, path: str, number: int, known: _Common) -> None:
        files, root = FileSystem.from_uri(f"{path}/block={number}")
        self.m = 0
        if files.get_file_info(root).type == FileType.NotFound:
            return
        t = dataset(root, filesystem=files, format="parquet").to_table(["id", "key", "words", "n"])
        code = t.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
        first = np.unique(code, return_index=True)[1]
        self.m = len(first)
        self.members = np.bincount(code, minlength=self.m)
        self.start = np.cumsum(self.members) - self.members
        self.ids = t.column("id").combine_chunks().take(pa.array(np.argsort(code, kind="stable")))
        t = t.select(["words", "n"]).take(pa.array(first)).combine_chunks()
        (word, at), (n, _) = (_rows(t.column(c).combine_chunks()) for c in ("words", "n"))
        n, row = n.astype(np.float64), np.repeat(np.arange(self.m), np.diff(at))
        self.size = np.sqrt(np.bincount(row, n * n, self.m))
        held, place = known.of(word)
        # counts are whole numbers; beyond 2^24 single precision would round their products
        exact = np.float32 if (self.size.max(initial=0) ** 2) < 1 << 24 else np.float64
        self.dense = np.zeros((self.m, len(known.sorted)), exact)
        self.dense[row[held], place] = n[held]
        # by row, and by word inside a row
        self.row, self.n = row[~held], n[~held]
        self.kinds, self.word = np.unique(word[~held], return_inverse=True)

    def of_kinds(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(row, word, n)`` of some kinds of words, which are numbered in their order."""
        number = np.full(len(self.kinds), -1)
        number[at] = np.arange(len(at))
        word = number[self.word]
        kept = word >= 0
        return self.row[kept], word[kept], self.n[kept]

    def bounds(self, columns: int) -> np.ndarray:
        """Unit vectors by their first columns, and the length of what is left of each as one more.

        The product of two such rows is an upper bound of the cosine (Cauchy and Schwarz).
        """
        unit = self.dense[:, :columns] / self.size[:, None]
        rest = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", unit, unit, dtype=np.float64)) + _SLACK)
        return np.hstack([unit, rest[:, None]]).astype(np.float32)


def _multiplier(paths: list[str], rights: int, common: list[int], low: float, k: int | None):
    known = _Common(common)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = (divmod(int(x), rights) for b in frames for x in b.column(0).to_numpy())
        at, a = -1, None
        for left, right in numbers:
            if left != at:  # tasks take the blocks of the right one after the other
                at, a = left, _Side(paths[0], left, known)
            b = _Side(paths[1], right, known) if a.m else a
            if a.m and b.m:
                for i, j, score in _passing(a, b, low, k):
                    yield from _named(a, b, i, j, score)

    return run


def _alike(head: np.ndarray) -> np.ndarray:
    """An order in which rows close to the same one of a few rows stand together."""
    some = head[:: max(1, len(head) // _PIVOTS)]
    return np.argsort((head @ some.T).argmax(1), kind="stable")


def _passing(
    a: _Side, b: _Side, low: float, k: int | None
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of both sides whose cosine reaches ``low``, and the cosine, tile by tile."""
    # of the words outside the common ones only those of both sides count
    both = np.intersect1d(a.kinds, b.kinds, assume_unique=True, return_indices=True)
    (row, word, n), (b_row, b_word, b_n) = (x.of_kinds(at) for x, at in zip((a, b), both[1:], strict=True))
    starts = np.searchsorted(row, np.arange(a.m + 1))
    by_word = np.argsort(b_word, kind="stable")
    b_row, b_n = b_row[by_word], b_n[by_word]
    lists = np.bincount(b_word, minlength=len(both[0]))
    times, first = lists[word], (np.cumsum(lists) - lists)[word]

    def tile(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        dot = (a.dense[rows] @ b.dense[columns].T).astype(np.float64)
        place = np.full(b.m, -1)
        place[columns] = np.arange(len(columns))
        of_rows = starts[rows + 1] - starts[rows]
        listed = np.repeat(starts[rows] - np.cumsum(of_rows) + of_rows, of_rows) + np.arange(of_rows.sum())
        own = np.repeat(np.arange(len(rows)), of_rows)
        for x, y in _slices(times[listed]):
            at = listed[x:y]
            t = times[at]
            met = np.repeat(first[at] - np.cumsum(t) + t, t) + np.arange(t.sum())
            to, cell = place[b_row[met]], np.repeat(own[x:y], t) * len(columns)
            there = to >= 0
            np.add.at(dot.reshape(-1), (cell + to)[there], (np.repeat(n[at], t) * b_n[met])[there])
        return dot / (a.size[rows, None] * b.size[columns])

    heads = [x.bounds(_HEAD) for x in (a, b)]
    order, every, step = _alike(heads[0]), np.arange(b.m), max(1, _CELLS // b.m)
    for lo in range(0, a.m, step):
        rows, columns = order[lo : lo + step], every
        if k is None:
            near = heads[0][rows] @ heads[1].T >= low - _ROUGH
            rows, columns = rows[near.any(1)], np.flatnonzero(near.any(0))
            if not len(rows):
                continue
        dot = tile(rows, columns)
        passed = dot >= low - _SLACK
        if k is not None and k < b.m:
            # a row counts for one text at least, so k rows hold the k best; ties stay
            kth = np.partition(dot, b.m - k, axis=1)[:, b.m - k]
            passed &= dot >= kth[:, None] - 2e-6
        i, j = np.nonzero(passed)
        yield rows[i], columns[j], dot[i, j]


def _named(a: _Side, b: _Side, i: np.ndarray, j: np.ndarray, score: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Every member of one row with every member of the other."""
    pairs = a.members[i] * b.members[j]
    upto = np.cumsum(pairs)
    for lo in range(0, int(upto[-1]) if len(upto) else 0, _OUT):
        p = np.arange(lo, min(lo + _OUT, int(upto[-1])))
        c = np.searchsorted(upto, p, "right")
        x, y = np.divmod(p - (upto[c] - pairs[c]), b.members[j[c]])
        yield pa.RecordBatch.from_arrays(
            [a.ids.take(pa.array(a.start[i[c]] + x)), b.ids.take(pa.array(b.start[j[c]] + y)), pa.array(score[c])],
            ["left_id", "right_id", "score"],
        )


def _slices(times: np.ndarray) -> Iterator[tuple[int, int]]:
    """Postings in slices that meet about ``_CELLS`` others."""
    upto = np.cumsum(times)
    x = 0
    while x < len(times):
        met = upto[x - 1] if x else 0
        y = max(x + 1, int(np.searchsorted(upto, met + _CELLS, "right")))
        yield x, y
        x = y


def _ids(pairs: DataFrame) -> str:
    return ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("left_id", "right_id"))


def _score(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cosine of each pair of sorted vectors; whole numbers up to the last step."""
    for b in frames:
        lists = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in b.columns[2:]]
        out = np.zeros(b.num_rows)
        for i in range(b.num_rows):
            lw, ln, rw, rn = (values[at[i] : at[i + 1]] for at, values in lists)
            place = np.searchsorted(lw, rw)
            place[place == len(lw)] = 0
            same = lw[place] == rw
            dot = int(ln[place[same]] @ rn[same])
            out[i] = dot / (np.sqrt(float(ln @ ln)) * np.sqrt(float(rn @ rn)))
        yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(out)], ["left_id", "right_id", "score"])


def sparse_topk(
    left: DataFrame, right: DataFrame, k: int, min_score: float, most: int = POSTINGS
) -> DataFrame:
    """``(left_id, rank, right_id, score)``: the k best pairs of each left text.

    Ranked by score at six decimals, then id.
    """
    order = Window.partitionBy("left_id").orderBy(F.desc(F.round("score", 6)), "right_id")
    ranked = _pairs(left, right, min_score, most, k).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("left_id", "rank", "right_id", "score")
