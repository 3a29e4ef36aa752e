"""Connected components of a link table: contraction inside tasks, then large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, stage

#: Links that one task contracts.
CHUNK = 200_000


def _large_star(e: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the smallest of its neighbourhood."""
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
        e.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    up = both.where(F.col("v") > F.col("u")).join(least, "u")
    return up.select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them (a > b in ``e``)."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    down = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.unionAll(least.select("a", F.col("m").alias("b")))


def _mark(e: DataFrame) -> tuple:
    row = e.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s"),
    ).first()
    return row["n"], row["s"]


def _contract(e: DataFrame, n: int, chunk: int) -> DataFrame:
    """The same groups with fewer links: about ``chunk`` links at a time become stars."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            root = x
            while (up := parent.setdefault(root, root)) != root:
                root = up
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for b in batches(frames):
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                u, v = top(x), top(y)
                if u != v:
                    parent[max(u, v)] = min(u, v)
        moved = [x for x in parent if top(x) != x]
        yield pa.RecordBatch.from_arrays(
            [pa.array(moved, pa.int64()), pa.array([top(x) for x in moved], pa.int64())], ["a", "b"]
        )

    return e.coalesce(max(1, -(-n // chunk))).mapInArrow(run, "a bigint, b bigint")


def components(links: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b: bigint); the root is the smallest node.

    Each round is written to the shared folder, so neither the plan nor the work to redo after
    the loss of an executor grows.  A round contracts the links inside tasks of bounded size and
    joins what tasks know of each other by stars; it ends when the stars change nothing.
    """
    e = stage(links.select("a", "b").where("a <> b"), "links")
    n = e.count()
    while True:
        e = stage(_contract(e, n, chunk).distinct(), "links")
        before = _mark(e)
        e = stage(_small_star(_large_star(e).distinct()).distinct(), "links")
        now = _mark(e)
        if now == before:
            break
        n = now[0]
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
