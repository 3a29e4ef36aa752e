"""The pipeline, stage by stage, against plain versions."""

import collections

import brute
import pytest

import corpus_pipeline
from textward.llm import quality_rules, tiling
from textward.llm.common import read, stage


@pytest.fixture(scope="module")
def kept(spark, sf_dir):
    """What each stage gets and returns."""
    docs, out = read(spark, sf_dir, "documents"), []
    for name, function in corpus_pipeline.STAGES:
        after = stage(function(spark, docs, sf_dir), f"test-{name}")
        out.append((docs, after))
        docs = after
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_rejected_documents_go(kept):
    before, after = kept[0]
    assert ids(after) == ids(quality_rules.judge(before).where("kept")) != ids(before)
    assert after.columns == before.columns


def test_lines_go(kept):
    before, after = kept[1]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    want = {i: w[2] for (i, _), w in zip(rows, brute.dedup_lines(rows), strict=True)}
    got = after.collect()
    assert {r.doc_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_one_near_duplicate_stays(kept):
    before, after = kept[2]
    rows = sorted((r.doc_id, r.text) for r in before.collect())
    prints = [brute.fingerprint(t) for _, t in rows]
    top = brute.groups(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    assert ids(after) == [rows[i][0] for i, t in enumerate(top) if i == t]


def test_benchmark_goes(spark, sf_dir, kept):
    before, after = kept[3]
    bad = {r.doc_id for r in tiling.contaminated(before, read(spark, sf_dir, "benchmark")).collect()}
    assert bad and ids(after) == [i for i in ids(before) if i not in bad]


def test_mix_repeats_documents(spark, sf_dir, kept):
    before, after = kept[4]
    texts = {r.doc_id: r.text for r in before.collect()}
    copies = collections.Counter(r.doc_id for r in after.collect())
    assert set(copies) <= set(texts) and max(copies.values()) <= 3
    assert {(r.doc_id, r.epoch) for r in after.collect()} == {(i, k + 1) for i, n in copies.items() for k in range(n)}
    whole = corpus_pipeline.run(spark, sf_dir)
    assert collections.Counter(map(tuple, whole.collect())) == collections.Counter(map(tuple, after.collect()))


def test_odd_rows_pass_through(spark, sf_dir, odd, nothing):
    for docs in (odd.select("doc_id", "text", "lang", "source", "n_chars"), nothing.select("doc_id", "text", "lang", "source", "n_chars")):
        for name, function in corpus_pipeline.STAGES:
            docs = stage(function(spark, docs, sf_dir), f"odd-{name}")
    assert docs.count() == 0
