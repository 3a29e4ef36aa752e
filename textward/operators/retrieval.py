"""Exact cosine top-k of queries against a chunk store, and what follows from it.

The store is cut into blocks of vectors that lie close together: by nearest pivot, by distance
from it, and by hash where very many lie at one distance.  A block is known by its pivot and by
the smallest and largest distance from it, so the triangle inequality says how near a query can
come to any of its vectors.  Every query first looks into its nearest block; the k-th distance
there rules out the blocks that cannot do better, and only the others see the query.  Blocks that
lie side by side are searched by one task, so a query is copied once for each such group, however
small the blocks are; the task meets a bounded number of queries, in tiles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bands import distance_band, distance_points, strong_enough
from ..functions.vectors import cosine_similarity
from ..session import stage
from .skew import join_hot

#: Rows of a block: what a task holds of each side.
BLOCK_ROWS = 20_000
#: Cells of the store, and rings of a cell, at most: 2^18 blocks are known to every task (8 MB).
PIVOTS, RINGS = 256, 1024
#: Partitions of a search, at most: four times as many as there are copies of groups up to that.
PARTS = 8192
#: Distances of a tile of queries from all blocks.
_CELLS = 1 << 20
_QUERY_TILE, _CHUNK_TILE = 512, 4096
_FAR = 9.0  # beyond every cosine distance
#: Slack of a product of unit vectors in single precision; cells of a product that cost as much as one pair.
_ROUGH, _SINGLE = 1e-4, 16
_NONE = np.iinfo(np.int64).max  # key of an empty place
_SCALE = 1e6  # ranks compare distances at six decimals, then ids

# Text used when nothing was found.
FALLBACK_SNIPPET = "Nothing in the chunk store is close to this query; answer without added context."


def _unit(vectors) -> np.ndarray:
    if not len(vectors):
        return np.zeros((0, 0))
    m = np.stack(list(vectors)).astype(np.float64, copy=False)
    size = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


class _Best:
    """Best k of each query so far: rank key, id and distance, ordered by key, then id."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.key = np.full((n, k), _NONE, dtype=np.int64)
        self.id = np.empty((n, k), dtype=object)
        self.dist = np.full((n, k), np.inf)

    def offer(self, queries, which, ids, chunks, needed=None, block=None, bound=None) -> None:
        """Chunks for the queries at the places ``which``, ``needed`` (query, block) with the
        ``block`` of each chunk says which ones count.  Chunks farther away than the k-th so far, or
        than the ``bound`` of a query, are only multiplied, in single precision, and not ranked."""
        order = np.argsort(ids, kind="stable")
        ids, chunks = ids[order], chunks[order]
        block = None if needed is None or needed.all() else block[order]
        rough = chunks.T.astype(np.float32)
        for lo in range(0, len(which) if len(ids) else 0, _QUERY_TILE):
            at = which[lo : lo + _QUERY_TILE]
            # an equal key may still win by its id
            reach = self.dist[at, -1] + 2.0 / _SCALE
            if bound is not None:
                reach = np.fmin(reach, bound[at] + 4.0 / _SCALE)
            some = np.isfinite(reach)
            if not some.all():
                self._rank(queries, at[~some], ids, chunks, needed, block)
            at, reach = at[some], reach[some]
            near = queries[at].astype(np.float32) @ rough >= (1.0 - reach - _ROUGH).astype(np.float32)[:, None]
            i, j = np.divmod(np.flatnonzero(near.ravel()), len(ids))
            if block is not None:
                held = needed[at[i], block[j]]
                i, j = i[held], j[held]
            # for very many pairs a whole product is less work than single ones
            many = np.bincount(i, minlength=len(at)) * _SINGLE > len(ids)
            if many.any():
                self._rank(queries, at[many], ids, chunks, needed, block)
                i, j = i[~many[i]], j[~many[i]]
            if len(i):
                dist = 1.0 - np.einsum("ij,ij->i", queries[at[i]], chunks[j])
                close = dist <= reach[i]
                self._merge(at, i[close], j[close], ids, dist[close])

    def _merge(self, at, row, column, ids, dist) -> None:
        """Chunks (the places ``column`` in ``ids``, which are sorted) for the queries ``at[row]``."""
        key = np.floor(dist * _SCALE + 0.5).astype(np.int64)
        # the best k of each query; the place of a chunk breaks ties
        order = np.lexsort((column, key, row))
        order = order[np.arange(len(order)) - np.searchsorted(row[order], row[order]) < self.k]
        if not len(order):
            return
        row, key, column, dist = (x[order] for x in (row, key, column, dist))
        some, row = np.unique(row, return_inverse=True)
        at = at[some]
        row = np.concatenate([np.repeat(np.arange(len(at)), self.k), row])
        key = np.concatenate([self.key[at].ravel(), key])
        held = np.concatenate([self.id[at].ravel(), ids[column].astype(object)])
        far = np.concatenate([self.dist[at].ravel(), dist])
        # empty places come last by their key, whatever stands there
        _, place = np.unique(np.where(key == _NONE, ids[0], held), return_inverse=True)
        order = np.lexsort((place, key, row))
        pick = order[np.searchsorted(row[order], np.arange(len(at)))[:, None] + np.arange(self.k)]
        self.key[at], self.id[at], self.dist[at] = key[pick], held[pick], far[pick]

    def _rank(self, queries, at, ids, chunks, needed, block) -> None:
        """All chunks, in order of their ids, for queries of which nothing is known."""
        m = len(ids)
        take = min(self.k, m)
        dist = 1.0 - queries[at] @ chunks.T
        if block is not None:
            dist[~needed[at][:, block]] = _FAR
        # ids are sorted, so the place of a chunk breaks ties
        code = np.floor(dist * _SCALE + 0.5).astype(np.int64) * m + np.arange(m)
        pick = np.argpartition(code, take - 1, axis=1)[:, :take] if take < m else np.tile(np.arange(m), (len(dist), 1))
        far = np.take_along_axis(dist, pick, 1)
        row, column = np.nonzero(far < _FAR)
        self._merge(at, row, pick[row, column], ids, far[row, column])

    def frame(self, query_ids: np.ndarray) -> pd.DataFrame:
        found = self.key.ravel() != _NONE
        return pd.DataFrame(
            {
                "query_id": np.repeat(query_ids, self.k)[found],
                "chunk_id": self.id.ravel()[found],
                "rank_key": self.key.ravel()[found],
                "distance": self.dist.ravel()[found],
            }
        )


def _slim(df: DataFrame, key: str) -> DataFrame:
    known = df.where("embedding IS NOT NULL")
    return known.select(key, F.col("embedding").cast("array<double>").alias("embedding"))


def _result_schema(queries: DataFrame, kb: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("chunk_id", kb.schema["chunk_id"].dataType),
            T.StructField("rank_key", T.LongType()),
            T.StructField("distance", T.DoubleType()),
        ]
    )


# ---- blocks -------------------------------------------------------------------------------


def _points(vectors, zero: int) -> np.ndarray:
    """Unit vectors with two more axes, on which zero vectors of each side (0, 1) are laid.

    A zero vector is at cosine distance 1 from everything; so it is here, and for all points
    half the squared distance is the cosine distance.
    """
    unit = _unit(vectors)
    out = np.concatenate([unit, np.zeros((len(unit), 2))], axis=1)
    out[~unit.any(axis=1), unit.shape[1] + zero] = 1.0
    return out


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit points."""
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


@dataclass(frozen=True)
class Blocks:
    """Pivots, and for every block its pivot, least and largest distance from it, rows that are
    there for certain, and the group of blocks that one task searches."""

    pivots: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray
    group: np.ndarray

    def tiles(self, vectors) -> Iterator[tuple[slice, np.ndarray]]:
        """Distances of queries (a tile at a time) from the pivot of every block."""
        points = _points(vectors, 0)
        step = max(1, _CELLS // max(1, len(self.cell)))
        for lo in range(0, len(points), step):
            at = slice(lo, min(len(points), lo + step))
            yield at, _apart(points[at], self.pivots)[:, self.cell]

    def nearest(self, vectors, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query the block that must be near, and a bound on its k-th cosine distance."""
        home, bound = np.zeros(len(vectors), np.int64), np.full(len(vectors), np.inf)
        for at, apart in self.tiles(vectors):
            most = apart + self.high
            order = np.argsort(most, axis=1, kind="stable")
            enough = np.cumsum(self.rows[order], axis=1) >= k
            last = np.take_along_axis(order, enough.argmax(axis=1)[:, None], 1)
            upto = np.take_along_axis(most, last, 1)[:, 0]
            home[at] = order[:, 0]
            bound[at] = np.where(enough.any(axis=1), upto * upto / 2.0, np.inf)
        return home, bound

    def within(self, vectors, bound: np.ndarray, some: np.ndarray | None = None) -> Iterator[tuple[slice, np.ndarray]]:
        """A tile of queries at a time: which blocks (of ``some``) can hold a vector within the
        bound of each query, ties included."""
        own = self if some is None else replace(self, **{c: getattr(self, c)[some] for c in ("cell", "low", "high", "rows", "group")})
        for at, apart in own.tiles(vectors):
            least = np.maximum(0.0, np.maximum(apart - own.high, own.low - apart))
            yield at, least * least / 2.0 <= bound[at, None] + 2.0 / _SCALE


def _located(kb: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Chunks with their nearest pivot ``cell`` and the distance ``r`` from it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in frames:
            if len(part):
                apart = _apart(_points(part["embedding"], 1), pivots)
                cell = apart.argmin(axis=1)
                yield part.assign(cell=cell, r=apart[np.arange(len(part)), cell])

    schema = T.StructType([*kb.schema.fields, T.StructField("cell", T.LongType()), T.StructField("r", T.DoubleType())])
    return kb.mapInPandas(run, schema)


def build_blocks(kb: DataFrame, n: int, block_rows: int) -> tuple[DataFrame, Blocks]:
    """Chunks ``(chunk_id, embedding, block)`` and what is known of every block.

    Pivots are the chunks with the smallest hashes, at most ``PIVOTS``; a cell is cut into at
    most ``RINGS`` rings by distance, so the lists on the driver are bounded; a ring with more
    than ``block_rows`` rows (equal vectors, or a very large store) is cut by hash of the id.
    """
    spark = kb.sparkSession
    first = kb.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(min(PIVOTS, -(-n // block_rows)))
    pivots = _points([r["embedding"] for r in first.collect()], 1)
    located = stage(_located(kb, pivots), "topk-chunks")

    part = lambda n: min(RINGS, -(-n // block_rows))
    largest = located.groupBy("cell").count().agg(F.max("count")).first()[0]
    steps = [i / part(largest) for i in range(1, part(largest))] or [0.5]
    cells = located.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("r", steps, 10000).alias("q"))
    cuts = []
    for row in cells.collect():
        m = part(row["n"])
        at = [round(j * (len(steps) + 1) / m) - 1 for j in range(1, m)]
        cuts.append((row["cell"], sorted({row["q"][min(i, len(steps) - 1)] for i in at})))
    cuts = F.broadcast(spark.createDataFrame(cuts, "cell bigint, cuts array<double>"))
    ring = F.size(F.filter("cuts", lambda x: x < F.col("r")))
    ringed = located.join(cuts, "cell").withColumn("ring", ring).drop("cuts")

    known = ringed.groupBy("cell", "ring").agg(
        F.count(F.lit(1)).alias("n"), F.min("r").alias("low"), F.max("r").alias("high")
    )
    rows, table = [], []
    for x in sorted(known.collect(), key=lambda x: (x["cell"], x["ring"])):
        parts = -(-x["n"] // block_rows)
        table.append((x["cell"], x["ring"], len(rows), parts))
        rows += [(x["cell"], x["low"], x["high"], x["n"] // parts)] * parts
    numbers = F.broadcast(spark.createDataFrame(table, "cell bigint, ring int, first bigint, parts int"))
    own = (F.col("first") + F.pmod(F.xxhash64("chunk_id"), F.col("parts"))).cast("bigint")
    chunks = ringed.join(numbers, ["cell", "ring"]).select("chunk_id", "embedding", own.alias("block"))
    cell, low, high, size = (np.array(x) for x in zip(*rows, strict=True))
    # parts by hash may hold fewer rows than their share; a bound must not count on them
    split = np.array([t[3] for t in table]).repeat([t[3] for t in table]) > 1
    # side by side up to the rows a task holds
    group = (np.cumsum(size) - size) // max(block_rows, BLOCK_ROWS)
    return chunks, Blocks(pivots, cell, low, high, np.where(split, 0, size), group)


# ---- search -------------------------------------------------------------------------------


def _search(needs: DataFrame, chunks: DataFrame, blocks: Blocks, k: int, block_rows: int) -> DataFrame:
    """The best k of each group for the queries ``(query_id, embedding, group, block, bound)``
    that need it: of the block at home where there is no bound, of all others within it else.

    A group is copied once for every ``BLOCK_ROWS`` queries that need it, and queries go to one
    copy each.
    """
    spark = chunks.sparkSession
    grouped = F.broadcast(
        spark.createDataFrame([(i, int(g)) for i, g in enumerate(blocks.group)], "block bigint, group bigint")
    )
    asked = needs.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    copies = asked.select("group", F.ceil(F.col("n") / max(block_rows, BLOCK_ROWS)).cast("int").alias("copies"))
    copies = F.broadcast(stage(copies, "topk-copies"))  # a row for each group, which are bounded
    total = copies.agg(F.sum("copies")).first()[0] or 1
    located = chunks.join(grouped, "block")
    return _matched(needs.join(copies, "group"), located.join(copies, "group"), k, total, blocks)


def _matched(needs: DataFrame, chunks: DataFrame, k: int, total: int, blocks: Blocks | None = None) -> DataFrame:
    """The best k of each group and copy, for both sides with ``group`` and ``copies``.

    ``total`` is the number of all copies.  It grows with the product of both sides and sets the
    number of partitions: with a fixed one a task would search more and more copies in turn.
    """
    parts = min(PARTS, 4 * total)
    left = needs.withColumn("copy", F.pmod(F.xxhash64("query_id"), F.col("copies")))
    every = F.explode(F.sequence(F.lit(0), F.col("copies") - 1))
    right = chunks.withColumn("copy", every).withColumn("copy", F.col("copy").cast("bigint"))

    def match(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        best = _Best(len(ours), k)
        if len(ours) and len(theirs):
            unit = _unit(ours["embedding"])
            if blocks is not None:
                theirs = theirs.sort_values("block", kind="stable")
                some = theirs["block"].unique()
                needed, bound = _needed(ours, blocks, some), ours["bound"].to_numpy(dtype=np.float64)
            for lo in range(0, len(theirs), _CHUNK_TILE):
                part = theirs.iloc[lo : lo + _CHUNK_TILE]
                ids, chunks = part["chunk_id"].to_numpy(), _unit(part["embedding"])
                if blocks is None:
                    best.offer(unit, np.arange(len(ours)), ids, chunks)
                    continue
                own, at = np.unique(part["block"].to_numpy(), return_inverse=True)
                held = needed[:, np.searchsorted(some, own)]
                best.offer(unit, np.flatnonzero(held.any(axis=1)), ids, chunks, held, at, bound)
        return best.frame(ours["query_id"].to_numpy())

    ours, theirs = (
        x.drop("copies").repartition(parts, "group", "copy").groupBy("group", "copy") for x in (left, right)
    )
    return ours.cogroup(theirs).applyInPandas(match, _result_schema(needs, chunks))


def _needed(ours: pd.DataFrame, blocks: Blocks, some: np.ndarray) -> np.ndarray:
    """Which of ``some`` blocks each query needs."""
    home = ours["block"].to_numpy()[:, None] == some
    bound = ours["bound"].to_numpy(dtype=np.float64)
    out = np.zeros(home.shape, bool)
    for at, may in blocks.within(ours["embedding"], bound, some):
        out[at] = may
    # no bound: the first look, into the block at home
    return np.where(np.isnan(bound)[:, None], home, out & ~home)


def _homes(queries: DataFrame, blocks: Blocks, k: int) -> DataFrame:
    """Queries with the block they look into first and a bound on their k-th distance."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in frames:
            if len(part):
                home, bound = blocks.nearest(part["embedding"], k)
                yield part.assign(block=home, group=blocks.group[home], bound=bound)

    added = [T.StructField("block", T.LongType()), T.StructField("group", T.LongType()), T.StructField("bound", T.DoubleType())]
    schema = T.StructType([*queries.schema.fields, *added])
    return queries.mapInPandas(run, schema)


def _others(homes: DataFrame, found: DataFrame, blocks: Blocks, k: int) -> DataFrame:
    """Queries with the further blocks that can still improve on what was found."""
    last = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.max("distance").alias("_last"))
    bound = F.least("bound", F.when(F.col("_n") >= k, F.col("_last")))
    known = homes.join(last, "query_id", "left").select("query_id", "embedding", "block", bound.alias("bound"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups = np.unique(blocks.group)
        first = np.searchsorted(blocks.group, groups)
        for part in frames:
            home = part["block"].to_numpy()
            for at, may in blocks.within(part["embedding"], part["bound"].to_numpy()):
                may[np.arange(len(may)), home[at]] = False
                held = np.logical_or.reduceat(may, first, axis=1)
                yield part.iloc[at].assign(groups=[groups[h] for h in held], looked=may.sum(axis=1))

    fields = [known.schema[c] for c in ("query_id", "embedding", "block", "bound")]
    fields += [T.StructField("groups", T.ArrayType(T.LongType())), T.StructField("looked", T.LongType())]
    return known.mapInPandas(run, T.StructType(fields))


def _candidates(queries: DataFrame, kb: DataFrame, k: int, block_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """``(query_id, chunk_id, rank_key, distance)`` with the best k of all blocks that matter, and
    ``(query_id, looked)`` with the number of blocks looked at after the first one."""
    n = kb.count()
    if n <= block_rows:  # one block: nothing can be ruled out
        total = max(1, -(-queries.count() // block_rows))
        one = {"group": F.lit(0).cast("bigint"), "copies": F.lit(total)}
        return _matched(queries.withColumns(one), kb.withColumns(one), k, total), None
    chunks, blocks = build_blocks(kb, n, block_rows)
    homes = stage(_homes(queries, blocks, k), "topk-homes")
    first = homes.withColumn("bound", F.lit(float("nan")))
    found = stage(_search(first, chunks, blocks, k, block_rows), "topk-first")
    others = stage(_others(homes, found, blocks, k), "topk-others")
    needs = others.select("query_id", "embedding", "block", "bound", F.explode("groups").alias("group"))
    return found.unionByName(_search(needs, chunks, blocks, k, block_rows)), others


def kb_topk(
    queries: DataFrame,
    kb: DataFrame,
    k: int = 3,
    max_distance: float | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(query_id, rank, chunk_id, distance)``: the k nearest chunks of every query.

    ``queries`` holds ``(query_id, embedding)``, ``kb`` ``(chunk_id, embedding)``.  Order is by
    distance at six decimals, then id; rows without embedding take no part.  A task holds one
    block, as many queries and a tile of distances, about 150 MB at 64 dimensions, whatever the
    sizes.
    """
    q, c = _slim(queries, "query_id"), _slim(kb, "chunk_id")
    candidates, _ = _candidates(q, c, k, block_rows)
    order = Window.partitionBy("query_id").orderBy("rank_key", "chunk_id")
    top = (
        candidates.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "chunk_id", "distance")
    )
    return top if max_distance is None else top.where(F.col("distance") <= max_distance)


def block_pairs(queries: DataFrame, kb: DataFrame, k: int = 3, block_rows: int = BLOCK_ROWS) -> dict[str, int]:
    """How many pairs of a query and a block there are, and how many a search leaves out."""
    q, c = _slim(queries, "query_id"), _slim(kb, "chunk_id")
    _, others = _candidates(q, c, k, block_rows)
    if others is None:
        return {"pairs": q.count(), "skipped": 0}
    n = build_blocks(c, c.count(), block_rows)[1].cell.size
    looked, asked = others.agg(F.sum(F.col("looked") + 1), F.count(F.lit(1))).first()
    return {"pairs": n * asked, "skipped": n * asked - (looked or 0)}


#: Parts of a store of page chunks.
SHELVES = 64


def shelf(page: Column | str) -> Column:
    """The part of a store that holds the chunks of a page."""
    return F.pmod(F.xxhash64(page), F.lit(SHELVES)).cast("int")


def store_by_page(chunks: DataFrame, path: str) -> None:
    """Write chunks ``(chunk_id, text, page_id, embedding)`` in folders by shelf."""
    rows = chunks.withColumn("shelf", shelf("page_id")).repartition("shelf", "page_id")
    rows.write.mode("overwrite").partitionBy("shelf").parquet(path)


def best_of_page(topics: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(topic, page_id, options, chunk_id, distance)``: the chunk of a topic's page nearest to it.

    ``topics``: ``(topic, page_id, options, embedding)``, one row per topic, so however many
    prompts ask for a topic it is looked up once.  Only shelves with a page that is asked for are
    read; vectors without texts are compared.
    """
    shelves = [r[0] for r in topics.select(shelf("page_id")).distinct().collect()]  # at most SHELVES
    read = chunks.where(F.col("shelf").isin(shelves)).where("embedding IS NOT NULL")
    vectors = read.select("shelf", "page_id", "chunk_id", F.col("embedding").alias("_v"))
    asked = topics.withColumn("shelf", shelf("page_id"))
    pairs = asked.join(vectors, ["shelf", "page_id"])
    distance = F.lit(1.0) - cosine_similarity("embedding", "_v")
    ranked = pairs.select(
        "topic", "page_id", "options",
        F.struct(F.round(distance, 6).alias("key"), "chunk_id", distance.alias("distance")).alias("hit"),
    )
    # the smallest in every partition goes first, so a long page does not gather in one task
    best = ranked.groupBy("topic", "page_id", "options").agg(F.min("hit").alias("hit"))
    return best.select("topic", "page_id", "options", "hit.chunk_id", "hit.distance")


def rate_hits(hits: DataFrame) -> DataFrame:
    """Add ``points`` and ``band`` for the distance of each hit."""
    return hits.withColumns(
        {"points": distance_points("distance"), "band": distance_band("distance")}
    )


def relevance_total(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """``(query_id, hits, total, strong)`` for every query, with 0 where nothing was found."""
    totals = (
        hits.groupBy("query_id")
        .agg(F.count(F.lit(1)).alias("hits"), F.sum(distance_points("distance")).alias("total"))
    )
    zero = F.lit(0).cast("long")
    out = queries.select("query_id").join(totals, "query_id", "left")
    return out.select(
        "query_id",
        F.coalesce("hits", zero).alias("hits"),
        F.coalesce("total", zero).alias("total"),
        strong_enough(F.coalesce("total", zero)).alias("strong"),
    )


def reingest_candidates(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Queries whose hits are too weak: they go into the next ingest."""
    return relevance_total(queries, hits).where(~F.col("strong")).drop("strong")


def with_fallback(queries: DataFrame, hits: DataFrame, kb: DataFrame) -> DataFrame:
    """Retrieved items ``(query_id, rank, url, topic, snippet, distance)``.

    ``queries`` holds ``(query_id, query)``.  A query without a hit gets one fallback row: its
    own text as topic, no url, no distance.
    """
    # one chunk may be the best answer to very many queries
    items = join_hot(hits, kb.select("chunk_id", "url", "topic", "text"), "chunk_id", "query_id")
    joined = queries.select("query_id", "query").join(items, "query_id", "left")
    found = F.col("chunk_id").isNotNull()
    return joined.select(
        "query_id",
        F.coalesce("rank", F.lit(1)).alias("rank"),
        "url",
        F.when(found, F.col("topic")).otherwise(F.col("query")).alias("topic"),
        F.when(found, F.col("text")).otherwise(F.lit(FALLBACK_SNIPPET)).alias("snippet"),
        "distance",
    )
