import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textward.catalog import RECOGNISERS, Rule, all_rules, default_rules
from textward.functions import bands, vectors
from textward.functions import text as tx
from textward.operators import evalset, pii, rules

SAMPLES = [
    "",
    "   ",
    "An idiot, two IDIOTS; idiotic ones and a moron.",
    "éidiot idioté idiot",
    "\U0001f600 stupid\U0001f600 trash",
    "ſtupid and Kill",
    "scumbag SCUM scum-bags worthless\nworthless",
    "walang hiya, walang-hiya, WALANGHIYA basura",
]


def one(spark, value, expr, name="text"):
    return spark.createDataFrame([(value,)], f"{name} string").select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("text", SAMPLES)
def test_detections_equal_python(spark, text):
    want = [
        (r.language, r.rule, m.group())
        for r in all_rules()
        for m in re.finditer(r.pattern, text, re.IGNORECASE)
    ]
    got = one(spark, text, rules.detections("text", all_rules()))
    assert [(d["language"], d["rule"], d["match"]) for d in got] == want
    assert one(spark, text, rules.detection_count("text", all_rules())) == len(want)


def test_guard_with_unknown_starts_and_open_alternation(spark):
    odd = [Rule("x", "a", r"\bfoo|bar"), Rule("x", "b", r"\bbaz\b", "b")]
    for text, n in (("xbar foo baz", 3), ("xfoo", 0), ("xbar", 1), ("", 0)):
        assert one(spark, text, rules.detection_count("text", odd)) == n


def test_null_text(spark):
    assert one(spark, None, rules.detections("text", default_rules())) == []
    assert one(spark, None, rules.detection_count("text", default_rules())) == 0
    assert one(spark, None, pii.entities("text")) == []


def test_case_sensitive(spark):
    n = rules.detection_count("text", default_rules(), case_insensitive=False)
    assert one(spark, "idiot IDIOT", n) == 1


def test_policies(spark):
    df = spark.createDataFrame([("idiot trash",)], "text string")
    row = rules.analyze_prompt(df).first()
    assert row["actions"] == ["warn", "block"] and not row["is_safe"]
    only_warn = rules.analyze_prompt(df, policies={"profanity": "warn"}).first()
    assert only_warn["actions"] == ["warn"]
    none = rules.analyze_prompt(df, policies={}).first()
    assert none["actions"] == [] and none["is_safe"]


def test_row_language_picks_pack(spark):
    df = spark.createDataFrame([("en", "trash basura"), ("es", "trash basura")], "lang string, text string")
    found = rules.detect_rules(df, all_rules(), lang="lang").collect()
    assert [[d["language"] for d in r["detections"]] for r in found] == [["english"], ["spanish"]]


PII_TEXT = (
    "My name is Ana Cruz. I live in Manila. My email is ana@mail.com, phone is 09161234567, "
    "username is ana_123, ID number AB-123456. \U0001f600 card 4111 1111 1111 1111, "
    'ip 10.0.0.1 call +1 (555) 123-4567 token = "' + "ab" * 20 + '"'
)


def test_entities_have_right_offsets(spark):
    found = one(spark, PII_TEXT, pii.entities("text"))
    assert [e["start"] for e in found] == sorted(e["start"] for e in found)
    for e in found:
        assert PII_TEXT[e["start"] : e["end"]] == e["text"]
    labels = {e["label"] for e in found}
    assert labels == {
        "person", "location", "email", "mobile_phone_number", "username", "id_number",
        "credit_card_number", "ip_address", "phone_number", "access_token",
    }


def test_counts_and_redaction(spark):
    df = spark.createDataFrame([(PII_TEXT,)], "text string")
    row = pii.analyze_pii(df).first()
    # person, location and the token are not in the counted labels
    assert row["pii_count"] == len(row["entities"]) - 3
    assert "Ana Cruz" not in row["redacted_text"] and "[REDACTED_PERSON]" in row["redacted_text"]
    again = pii.analyze_pii(spark.createDataFrame([(row["redacted_text"],)], "text string")).first()
    assert again["redacted_text"] == row["redacted_text"]
    off = pii.analyze_pii(df, False, False, False).first()["redacted_text"]
    assert "Ana Cruz" in off and "[REDACTED_EMAIL]" in off and "[REDACTED_PH_PHONE]" in off
    people = pii.analyze_pii(df, True, False, False).first()["redacted_text"]
    assert "[REDACTED_PERSON]" in people and "Manila" in people and "AB-123456" in people


def spans(*items):
    return F.array(
        *[
            F.struct(
                F.lit("x").alias("text"), F.lit(label).alias("label"), F.lit(s).alias("start"),
                F.lit(e).alias("end"), F.lit(1.0).alias("score"),
            )
            for label, s, e in items
        ]
    )


def test_overlaps_leftmost_then_longest_then_order(spark):
    found = spans(("b", 5, 9), ("a", 0, 3), ("long", 0, 6), ("c", 6, 8), ("d", 6, 8))
    kept = one(spark, "", pii.resolve_overlaps(found, ["d", "c"]))
    assert [(e["label"], e["start"]) for e in kept] == [("long", 0), ("d", 6)]
    text = one(spark, "0123456789", pii.redact_entities("text", found))
    assert text.startswith("[REDACTED_LONG]") and text.endswith("89")


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet="a@. 01-9\né\U0001f600", max_size=60))
def test_spans_equal_finditer(spark, text):
    mail = [r for r in RECOGNISERS if r.label == "email"]
    want = [(m.start(), m.end(), m.group()) for m in re.finditer(mail[0].pattern, text)]
    got = one(spark, text, pii.entities("text", mail))
    assert [(e["start"], e["end"], e["text"]) for e in got] == want


def test_chunk_bounds(spark):
    text = "\n\n".join(["a" * 50, "b" * 51, "c" * 60, "d" * 10, "e" * 99, "f" * 70])
    assert [c[0] for c in one(spark, text, tx.chunk_text("text", max_chunks=3))] == ["b", "c", "e"]
    assert len(one(spark, text, tx.chunk_text("text"))) == 4


def test_claims(spark):
    text = "0123456789. 01234567890!?  Short.. \n A longer claim here \n"
    assert one(spark, text, tx.extract_claims("text")) == ["01234567890", "A longer claim here"]


def fenced(text):
    lines = text.split("\n")
    marks = [i for i, x in enumerate(lines) if x.startswith("```")]
    if not marks:
        return None
    return "\n".join(lines[marks[0] + 1 : marks[1] if len(marks) > 1 else None])


@pytest.mark.parametrize(
    "text",
    ["", "none", "```", "```\n```", "a\n```x\nbody\nmore\n```\nrest", "```\nopen\nend", "in ```x``` line",
     "a\n```\n\n```", "```\n```\nx\n```"],
)
def test_fenced(spark, text):
    assert one(spark, text, tx.extract_fenced("text")) == fenced(text)


def test_topic_and_marker(spark):
    for topic, ok in (("", False), ("x", True), ("x" * 50, True), ("x" * 51, False), (None, False)):
        assert one(spark, topic, tx.valid_topic("text")) is ok
    assert one(spark, "```\nArt\n```", tx.clean_topic("text")) == "Art"
    assert one(spark, "FILTERED.", tx.is_filtered_marker("text")) is True
    assert one(spark, None, tx.is_filtered_marker("text")) is False


def test_list_text(spark):
    for text, want in (
        ("['a', 'b c']", "a | b c"),
        ('["it\'s", \'x\']', "it's | x"),
        (r"['it\'s']", "it's"),
        ("[]", ""),
        ("None", ""),
        (None, ""),
    ):
        assert one(spark, text, evalset.flatten_attack_type("text")) == want


def test_bands(spark):
    rows = [(d,) for d in (0.0, 0.1999, 0.2, 0.4499, 0.45, 0.5999, 0.6, 2.0, None)]
    df = spark.createDataFrame(rows, "d double")
    got = [tuple(r) for r in df.select(bands.distance_points("d"), bands.distance_band("d")).collect()]
    assert [p for p, _ in got] == [8, 8, 5, 5, 1, 1, 0, 0, 0]
    scores = [(s,) for s in (0.7, 0.69, 0.5, 0.4, 0.39, 0.3, 0.29, None)]
    df = spark.createDataFrame(scores, "s double")
    got = df.select(bands.assessment_band("s").alias("a"), bands.is_hallucination("s").alias("h"))
    assert [r["h"] for r in got.collect()] == [False] * 4 + [True] * 4
    texts = [t for _, t in bands.ASSESSMENT_BANDS]
    want = [texts[0], texts[1], texts[1], *[texts[2]] * 3, bands.ASSESSMENT_REST,
            bands.ASSESSMENT_NO_CONTEXT]
    assert [r["a"] for r in got.collect()] == want


def test_softmax(spark):
    df = spark.createDataFrame([([1.0, 2.0, 800.0],), ([0.0, 0.0, 0.0],)], "l array<double>")
    rows = df.select(
        vectors.max_probability("l").alias("m"), vectors.softmax("l").alias("s"),
        vectors.max_probability("l", "sigmoid").alias("g"), vectors.sigmoid("l").alias("e"),
    ).collect()
    assert rows[0]["m"] == pytest.approx(1.0) and rows[1]["m"] == pytest.approx(1 / 3)
    assert sum(rows[0]["s"]) == pytest.approx(1.0) and rows[1]["g"] == pytest.approx(0.5)
    assert rows[1]["e"] == [0.5, 0.5, 0.5]


def test_sparse_cosine(spark):
    pairs = [("a b b", "b c"), ("", "x"), ("same words", "Words, same!"), ("x", "y"), ("!!", "??")]
    got = [
        r[0]
        for r in spark.createDataFrame(pairs, "a string, b string")
        .select(vectors.sparse_cosine("a", "b"))
        .collect()
    ]
    assert got == pytest.approx([2 / math.sqrt(10), 0.0, 1.0, 0.0, 0.0])


def test_native_expressions_need_no_python(spark, sf_dir):
    from plans import plan_of

    from textward.plans.registry import QUERIES

    for name in ("gate_decisions", "pii_redacted", "rule_detections", "claims", "pair_similarity"):
        plan = plan_of(QUERIES[name](spark, sf_dir))
        assert "EvalPython" not in plan and "InPandas" not in plan


def test_counts_equal_python_on_many_texts(spark):
    import random

    random.seed(5)
    parts = ["idiot", "Idiots", "moronés", "scum", "ſcum", "TRASH", " ", "-", "é", "\n", "basura",
             "hello", "walang hiya", "_", "\U0001f600", "stupid", "K", "imbecil", "imbeciles"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = df.select("id", rules.detection_count("text", all_rules()).alias("n")).collect()
    for r in got:
        want = sum(
            len(re.findall(x.pattern, texts[r["id"]], re.IGNORECASE)) for x in all_rules()
        )
        assert r["n"] == want, texts[r["id"]]


def test_rules_with_groups_of_their_own(spark):
    odd = [Rule("x", "a", r"\b(a)(b)\b"), Rule("x", "b", r"\b(\w)\1\b"), Rule("x", "c", r"(?<n>q)\k<n>")]
    for text, n in (("ab xx", 2), ("qq", 2), ("ac xy", 0)):
        assert one(spark, text, rules.detection_count("text", odd)) == n
