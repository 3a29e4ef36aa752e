"""Searches between two tables against plain versions: word postings, and blocks of vectors."""

import collections
import math
import random

import numpy as np
import pytest
from plans import plan_of

from textward.operators import retrieval, sparse


def texts(rng, n, words):
    out = [(i, " ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randint(1, 12)))) for i in range(n)]
    return [*out, (n, None), (n + 1, ""), (n + 2, " .,! "), (None, "alpha beta")]


def plain_pairs(left, right, low):
    count = lambda t: collections.Counter((t or "").lower().split())
    size = lambda c: math.sqrt(sum(n * n for n in c.values()))
    out = {}
    for i, a in left:
        for j, b in right:
            x, y = count(a), count(b)
            if i is not None and j is not None and size(x) * size(y):
                score = sum(n * y[w] for w, n in x.items()) / (size(x) * size(y))
                if round(score, 6) >= low:
                    out[i, j] = round(score, 6)
    return out


@pytest.mark.parametrize(("low", "most"), [(0.3, 4096), (0.8, 3), (1.0, 4096)])
def test_sparse_pairs_like_plain_cosines(spark, low, most):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "é", "zeta", "eta", "theta"]
    # the last texts hold punctuation only, which is no word
    left, right = texts(rng, 40, words), texts(rng, 30, words[2:] + ["iota"])
    plain = [[(i, None if t == " .,! " else t) for i, t in side] for side in (left, right)]
    a, b = (spark.createDataFrame(side, "id bigint, text string") for side in (left, right))
    got = {(r.left_id, r.right_id): round(r.score, 6) for r in sparse.sparse_pairs(a, b, low, most).collect()}
    want = plain_pairs(*plain, low)
    assert got == want and want
    top = collections.defaultdict(list)
    for r in sparse.sparse_topk(a, b, 2, low, most).orderBy("left_id", "rank").collect():
        top[r.left_id].append(r.right_id)
    for i, found in top.items():
        assert found == [j for _, j in sorted((-s, j) for (x, j), s in want.items() if x == i)][:2]


def test_sparse_pairs_need_a_score(spark):
    rows = spark.createDataFrame([(1, "a")], "id bigint, text string")
    with pytest.raises(ValueError):
        sparse.sparse_pairs(rows, rows, 0.0)
    assert sparse.sparse_pairs(rows.limit(0), rows, 0.5).count() == 0


def test_no_pair_below_the_bound_is_built(spark):
    common = [(i, f"the of and w{i}") for i in range(60)]
    rows = spark.createDataFrame(common, "id bigint, text string")
    own = sparse.postings(rows)
    frequency = own.groupBy("word").count().withColumnRenamed("count", "texts")
    found = sparse.prefixes(own, frequency, 0.95)
    # only the text itself shares the rare word, and the common ones weigh too little
    assert {r.word[0] for r in found.collect()} == {"w"}
    pairs = sparse.candidates(found, found, 0.95)
    assert {(r.left_id, r.right_id) for r in pairs.collect()} == {(i, i) for i in range(60)}
    assert "BroadcastNestedLoop" not in plan_of(pairs) and "Cartesian" not in plan_of(pairs)


def clustered(rng, n, dims=6):
    centres = rng.normal(size=(8, dims)) * 5
    rows = centres[rng.integers(0, 8, n)] + rng.normal(size=(n, dims)) * 0.2
    rows[: n // 4] = rows[0]  # many equal vectors
    rows[n // 4 : n // 4 + 3] = 0
    return rows


def plain_topk(queries, chunks, k):
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    apart = np.floor((1 - unit(queries) @ unit(chunks).T) * 1e6 + 0.5).astype(np.int64)
    return [sorted(zip(row.tolist(), range(len(chunks)), strict=True))[:k] for row in apart]


@pytest.mark.parametrize("block_rows", [1000, 40, 7])
def test_topk_in_blocks_is_exact(spark, block_rows, monkeypatch):
    monkeypatch.setattr(retrieval, "RINGS", 4)
    rng = np.random.default_rng(block_rows)
    q, c = clustered(rng, 60), clustered(rng, 300)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)] + [(999, None)], "query_id bigint, embedding array<double>")
    kb = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)] + [(999, None)], "chunk_id bigint, embedding array<double>")
    got = collections.defaultdict(list)
    for r in retrieval.kb_topk(queries, kb, 5, block_rows=block_rows).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.chunk_id)
    want = plain_topk(q, c, 5)
    assert got == {i: [j for _, j in w] for i, w in enumerate(want)}


def test_far_blocks_are_left_out(spark):
    rng = np.random.default_rng(1)
    q, c = clustered(rng, 50), clustered(rng, 400)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q[16:])], "query_id bigint, embedding array<double>")
    kb = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "chunk_id bigint, embedding array<double>")
    counts = retrieval.block_pairs(queries, kb, 3, block_rows=20)
    assert counts["skipped"] > 0.5 * counts["pairs"] > 0
    assert retrieval.block_pairs(queries, kb, 3) == {"pairs": 34, "skipped": 0}


def test_small_blocks_share_a_task_and_a_copy_of_the_query(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(4)
    q, c = rng.normal(size=(30, 6)), rng.normal(size=(400, 6))
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id bigint, embedding array<double>")
    kb = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "chunk_id bigint, embedding array<double>")
    blocks = retrieval.build_blocks(kb, 400, 10)[1]
    assert len(blocks.cell) >= 40 and len(set(blocks.group.tolist())) <= 5
    got = collections.defaultdict(list)
    for r in retrieval.kb_topk(queries, kb, 3, block_rows=10).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.chunk_id)
    assert got == {i: [j for _, j in w] for i, w in enumerate(plain_topk(q, c, 3))}


def test_topk_of_nothing(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, embedding array<double>")
    kb = rows.withColumnRenamed("query_id", "chunk_id")
    assert retrieval.kb_topk(rows, kb.limit(0)).count() == 0
    assert retrieval.kb_topk(rows.limit(0), kb).count() == 0


def test_products_of_blocks_like_plain_cosines(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    left, right = texts(rng, 60, words), texts(rng, 50, words)
    left, right = [[(i, None if t == " .,! " else t) for i, t in side] for side in (left, right)]
    left += [(100 + i, left[0][1]) for i in range(5)]
    right += [(200 + i, left[0][1]) for i in range(4)]
    a, b = (spark.createDataFrame(side, "id bigint, text string") for side in (left, right))
    want = plain_pairs(left, right, 0.3)
    built = []
    plain = sparse.candidates
    monkeypatch.setattr(sparse, "candidates", lambda *x: built.append(1) or plain(*x))
    for common, least, cells in ((1024, 1000, 1 << 20), (5, 7, 64), (0, 1000, 1)):
        for name, value in (("COMMON", common), ("_LEAST", least), ("_CELLS", cells), ("_MEETING", 0.0)):
            monkeypatch.setattr(sparse, name, value)
        got = {(r.left_id, r.right_id): round(r.score, 6) for r in sparse.sparse_pairs(a, b, 0.3).collect()}
        assert got == want and want
        top = collections.defaultdict(list)
        for r in sparse.sparse_topk(a, b, 2, 0.3).orderBy("left_id", "rank").collect():
            top[r.left_id].append(r.right_id)
        for i, found in top.items():
            assert found == [j for _, j in sorted((-s, j) for (x, j), s in want.items() if x == i)][:2]
    assert not built


def test_copies_of_groups_have_partitions_of_their_own(spark):
    def side(key):
        rows = [(i, i % 10, 8, [1.0, i / 320]) for i in range(320)]
        return spark.createDataFrame(rows, f"{key} bigint, group bigint, copies bigint, embedding array<double>")

    found = retrieval._matched(side("query_id"), side("chunk_id"), 2, 80)
    assert found.rdd.getNumPartitions() >= 80
    assert found.count() == 640


def test_products_of_blocks_shuffle_no_pair_and_copy_no_text(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    left, right = ([(i, " ".join(rng.choices(words, k=rng.randint(1, 9)))) for i in range(n)] for n in (60, 50))
    # copies on both sides, and a text in two rows of one id
    left += [(100 + i, left[0][1]) for i in range(30)] + [(200, "w1 w2"), (200, "w2 w3")]
    right += [(100 + i, left[0][1]) for i in range(20)]
    a, b = (spark.createDataFrame(side, "id bigint, text string") for side in (left, right))
    want = plain_pairs([*left[:-2], (200, "w1 w2 w2 w3")], right, 0.5)
    for name, value in (("_MEETING", 0.0), ("_LEAST", 7), ("_OUT", 7), ("LEAST_ROWS", 5), ("_HEAD", 3)):
        monkeypatch.setattr(sparse, name, value)
    stored = []
    plain = sparse._stored
    monkeypatch.setattr(sparse, "_stored", lambda *x: stored.append(plain(*x)) or stored[-1])
    found = sparse.sparse_pairs(a, b, 0.5)
    assert "Exchange" not in plan_of(found)
    assert {(r.left_id, r.right_id): round(r.score, 6) for r in found.collect()} == want and want
    assert found.count() == len(want)
    for path, texts_of in zip(stored, (left[:-1], right), strict=True):
        blocks = spark.read.parquet(path)
        assert blocks.count() == len(texts_of) and blocks.select("block").distinct().count() > 1


def test_only_chunks_within_reach_are_ranked(monkeypatch):
    rng = np.random.default_rng(8)
    unit = lambda n: (lambda m: m / np.linalg.norm(m, axis=1, keepdims=True))(rng.normal(size=(n, 8)))
    queries, chunks = unit(30), unit(900)
    chunks[700] = chunks[20]  # a tie, which the smaller id wins
    queries[3] = chunks[20]
    ids = np.array([f"c{i:03}" for i in range(900)], dtype=object)
    far = np.floor((1.0 - queries @ chunks.T) * 1e6 + 0.5)
    want = np.argsort(far, axis=1, kind="stable")[:, :3]
    best = retrieval._Best(30, 3)
    best.offer(queries, np.arange(30), ids[600:], chunks[600:])
    assert (best.id != None).all()  # noqa: E711
    ranked = []
    plain = best._merge
    monkeypatch.setattr(best, "_merge", lambda at, row, *x: ranked.append(len(row)) or plain(at, row, *x))
    monkeypatch.setattr(retrieval.np, "argpartition", None)
    best.offer(queries, np.arange(30), ids[:600], chunks[:600])
    monkeypatch.undo()
    assert (best.id == ids[want]).all() and (best.key == np.take_along_axis(far, want, 1)).all()
    assert 0 < sum(ranked) < 900
    # a bound rules out what it cannot improve, and nothing else
    bounded = retrieval._Best(30, 3)
    bounded.offer(queries, np.arange(30), ids, chunks, bound=best.dist[:, -1])
    assert (bounded.id == best.id).all()
