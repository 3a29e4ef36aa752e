"""Literal terms by trie against the same terms unrolled into rules."""

import random
import re

from pyspark.sql import functions as F

from textward.catalog import Rule
from textward.operators import rules, terms

TERMS = ["ab", "AB cd", "cd ab", "é", "straße", "a-b", "x_1", "ab ab", "ab, cd", "kelvin", "sis", "cd\nab", "1"]
TEXTS = [
    None,
    "",
    "ab AB cd ab ab ab ab, cd a-b x_1 x_12 Straße STRASSE É é Kelvin ſis sİs 1 11 1.",
    "cd\nab cd  ab-b ab_",
    " ,ab",
]


def test_terms_like_unrolled_rules(spark):
    rng = random.Random(2)
    letters = [*"ab", "cd", "é", "AB", "-", " ", " ", ",", "\n", "_", "1", "x_1"]
    texts = TEXTS + ["".join(rng.choices(letters, k=60)) for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string")
    names = [(i, "any", f"t{i}", t) for i, t in enumerate(TERMS)]
    table = spark.createDataFrame([*names, (99, "any", "no", "-ab"), (98, "any", "none", None)], "position bigint, language string, rule string, term string")
    unrolled = [Rule("any", n, rf"\b(?:{re.escape(t)})\b") for _, _, n, t in names]
    for chars in (terms.PART_CHARS, 5):
        got = terms.detect_terms(docs.withColumn("_hits", F.lit(1)), table, part_chars=chars)
        want = rules.detect_rules(docs, unrolled)
        assert {r.doc_id: r.detections for r in got.collect()} == {r.doc_id: r.detections for r in want.collect()}
    exact = terms.detect_terms(docs, table, case_insensitive=False).where("doc_id = 2").first()
    assert [d.match for d in exact.detections if d.rule == "t0"] == ["ab"] * 5


def test_no_terms_and_no_texts(spark):
    docs = spark.createDataFrame([(1, "ab")], "doc_id bigint, text string")
    table = spark.createDataFrame([(1, "any", "r", "ab")], "position bigint, language string, rule string, term string")
    assert terms.detect_terms(docs, table.limit(0)).first().detections == []
    assert terms.detect_terms(docs.limit(0), table).count() == 0


def test_no_term_passes_through_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"alpha{i} beta gamma delta epsilon zeta{i} x" * 2) for i in range(40)], "doc_id bigint, text string")
    long = "beta gamma delta epsilon zeta1"
    names = [(i, "any", "t", f"alpha{i}") for i in range(40)] + [(100, "any", "long", long), (101, "any", "longer", f"alpha1 {long}"), (102, "any", "not", f"alpha2 {long}")]
    table = spark.createDataFrame(names, "position bigint, language string, rule string, term string").cache()
    sizes = []
    plain = type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda df: sizes.append(rows := plain(df)) or rows)
    found = terms.detect_terms(docs, table, part_chars=200)
    monkeypatch.undo()
    # the lengths of terms are all that comes back, and no catalogue is broadcast
    assert max(map(len, sizes), default=0) < 10
    got = {r.doc_id: [d.match for d in r.detections] for r in found.collect()}
    want = {r.doc_id: [d.match for d in r.detections] for r in rules.detect_rules(docs, [Rule("any", r, rf"\b(?:{re.escape(t)})\b") for _, _, r, t in names]).collect()}
    assert got == want and any("alpha1 beta" in m for m in got[1])


def test_a_chunk_asks_for_stretches_of_terms_only(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"alpha{i} beta gamma{i} delta " * 3) for i in range(200)], "doc_id bigint, text string")
    names = [(1, "any", "one", "Alpha7"), (2, "any", "two", "beta gamma7"), (3, "any", "again", "delta alpha9 beta gamma9 delta alpha9")]
    table = spark.createDataFrame(names, "position bigint, language string, rule string, term string")
    asked = []
    plain = type(docs).distinct
    monkeypatch.setattr(type(docs), "distinct", lambda df: asked.append(df) or plain(df))
    found = terms.detect_terms(docs, table)
    monkeypatch.undo()
    # of the 600 distinct words and some thousand stretches of three pieces and more
    assert asked[-1].columns == ["chunk", "key"] and asked[-1].count() < 60
    got = {r.doc_id: [(d.rule, d.match) for d in r.detections] for r in found.collect() if r.detections}
    # the long term overlaps itself, so it counts once
    assert got == {7: [("one", "alpha7")] * 3 + [("two", "beta gamma7")] * 3, 9: [("again", "delta alpha9 beta gamma9 delta alpha9")]}
