"""Text features by word, and the trained scorer against its own weights."""

import math
import re
from collections import Counter

import pytest
from plans import plan_of

from textward.operators import features, models

TEXTS = [(1, "The cat and the dog"), (2, "the Cat"), (3, ""), (4, None), (5, "the the"), (6, "Ünïcode cat 42")]


def plain(rows):
    counts = {k: Counter(re.findall(r"[^\W_]+", (t or "").lower())) for k, t in rows}
    seen = Counter(w for c in counts.values() for w in c)
    out = {}
    for k, c in counts.items():
        raw = {w: n * math.log((len(rows) + 1) / (seen[w] + 1)) for w, n in c.items()}
        size = math.sqrt(sum(x * x for x in raw.values()))
        out[k] = {w: x / size if size else x for w, x in raw.items()}
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "k int, text string")


def test_vectors_by_word(docs):
    rows = features.word_vectors(docs, "k").select("k", "terms", features.top_terms("terms", 2).alias("top")).collect()
    got = {r["k"]: {t["word"]: t["weight"] for t in r["terms"]} for r in rows}
    want = plain(TEXTS)
    assert {k: set(v) for k, v in got.items()} == {k: set(v) for k, v in want.items()}
    for k, terms in want.items():
        assert got[k] == pytest.approx(terms)
    ids = {t["word"]: t["word_id"] for r in rows for t in r["terms"]}
    assert sorted(ids.values()) == list(range(1, len(ids) + 1))
    assert all([t["word_id"] for t in r["terms"]] == sorted(t["word_id"] for t in r["terms"]) for r in rows)
    assert next(r["top"] for r in rows if r["k"] == 1) == ["and", "dog"]


def test_words_are_counted_in_their_row(docs):
    assert "Exchange" not in plan_of(features.word_counts(docs, "k"))


def test_texts_of_one_key_count_as_one(spark):
    rows = [(1, "b a b"), (1, "a c"), (2, "a"), (2, None), (None, "a d"), (None, "a"), (3, None), (4, "d")]
    df = spark.createDataFrame(rows, "k int, text string")
    got = {(r["k"], r["word"]): r["n"] for r in features.word_counts(df, "k").collect()}
    assert got == {(1, "a"): 2, (1, "b"): 2, (1, "c"): 1, (2, "a"): 1, (None, "a"): 2, (None, "d"): 1, (4, "d"): 1}
    terms = [(r["k"], [t["word"] for t in r["terms"]]) for r in features.word_vectors(df, "k").collect()]
    assert len(terms) == len(rows)
    assert all(sorted(w) == {1: ["a", "b", "c"], 2: ["a"], 4: ["d"]}.get(k, []) for k, w in terms)


def test_vocabulary_of_another_corpus(spark, docs):
    counts = features.word_counts(docs, "k")
    words = features.vocabulary(counts, docs.count())
    new = spark.createDataFrame([(9, "cat unseen"), (10, "unseen")], "k int, text string")
    got = {r["k"]: [t["word"] for t in r["terms"]] for r in features.word_vectors(new, "k", words=words).collect()}
    assert got == {9: ["cat"], 10: []}


def test_trained_scorer_follows_its_weights(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labelled = docs.join(labels, "doc_id").select("doc_id", "text", "toxic")
    model = models.fit_toxicity(labelled)
    scored = models.predict_toxicity(model, labelled).collect()
    idf, fitted = model.stages[2].idf.toArray(), model.stages[3]
    words = {w for r in scored for w in re.findall(r"[^\W_]+", r["text"].lower())}
    slots = spark.createDataFrame([([w],) for w in sorted(words)], "words array<string>")
    at = {r["words"][0]: int(r["tf"].indices[0]) for r in model.stages[1].transform(slots).collect()}
    weights = fitted.coefficients.toArray()
    for r in scored:
        counts = Counter(re.findall(r"[^\W_]+", r["text"].lower()))
        z = fitted.intercept + sum(n * idf[at[w]] * weights[at[w]] for w, n in counts.items())
        assert r["toxicity"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
    hits = sum((r["toxicity"] >= 0.5) == bool(r["toxic"]) for r in scored)
    assert hits >= 0.9 * len(scored)
