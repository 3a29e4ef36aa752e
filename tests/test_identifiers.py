"""Check digits, and identifiers known by the words before them."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from textward import catalog
from textward.functions import checks
from textward.operators import pii
from textward.plans import inputs

ZONE = "L898902C36UTO7408122F1204159ZE184226B<<<<<10"
CASES = [
    ("luhn", "4111 1111-1111 1111", True),
    ("luhn", "4111111111111112", False),
    ("luhn", "79927398713", True),
    ("luhn", "", False),
    ("mod97", "GB82 WEST 1234 5698 7654 32", True),
    ("mod97", "DE89370400440532013000", True),
    ("mod97", "DE89370400440532013001", False),
    ("mod11", "529.982.247-25", True),
    ("mod11", "529.982.247-52", False),
    ("mod11", "111.111.111-11", False),
    ("mod11", "529.982", False),
    ("machine_zone", ZONE, True),
    ("machine_zone", ZONE.replace("740812", "740813"), False),
    ("machine_zone", ZONE[:43], False),
]


def test_check_digits(spark):
    df = spark.createDataFrame([(i, n, v) for i, (n, v, _) in enumerate(CASES)], "i int, name string, v string")
    test = F.lit(None).cast("boolean")
    for name, check in checks.CHECKS.items():
        test = F.when(F.col("name") == name, check("v")).otherwise(test)
    got = [r[0] for r in df.select("i", test.alias("ok")).orderBy("i").select("ok").collect()]
    assert got == [ok for _, _, ok in CASES]


SAID = [
    ("pay to DE89 3704 0044 0532 0130 00 12 times", "iban", "DE89 3704 0044 0532 0130 00"),
    ("card 4111 1111 1111 1111.", "credit_card_number", "4111 1111 1111 1111"),
    ("CPF 529.982.247-25", "cpf", "529.982.247-25"),
    (f"x {ZONE}\n", "passport_number", ZONE),
    ("Passport no. X1234567 ok", "passport_number", "X1234567"),
    ("passport expires on 2030-01-31", "passport_expiration_date", "2030-01-31"),
    ("card expires 09/27", "credit_card_expiration_date", "09/27"),
    ("the CVV is 123", "cvv", "123"),
    ("CVC: 987", "cvc", "987"),
    ("license plate AB-1234", "license_plate_number", "AB-1234"),
    ("postal code: SW1A 1AA", "postal_code", "SW1A 1AA"),
    ("Landline: +49 30 1234567", "landline_phone_number", "+49 30 1234567"),
    ("fax (030) 555-1234", "fax_number", "(030) 555-1234"),
    ("registration number HRB-12345", "registration_number", "HRB-12345"),
    ("serial no. SN-99887", "serial_number", "SN-99887"),
    ("vehicle registration AB12CDE", "vehicle_registration_number", "AB12CDE"),
    ("national health insurance number: 943476591", "national_health_insurance_number", "943476591"),
    ("flight LH 454", "flight_number", "LH 454"),
    ("blood type AB+", "blood_type", "AB+"),
    ("account number 12345678901", "bank_account_number", "12345678901"),
]


@pytest.fixture(scope="module")
def found(spark):
    texts = [s for s, _, _ in SAID] + ["insurance POLICY", "card 4111 1111 1111 1112", "DE89370400440532013001", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = pii.detect_pii(df, catalog.CHECKED_RECOGNISERS).collect()
    return {r["i"]: [(e["label"], e["text"], r["text"][e["start"] : e["end"]]) for e in r["entities"]] for r in rows}


def test_identifiers_are_found(found):
    assert [found[i] for i in range(len(SAID))] == [[(label, v, v)] for _, label, v in SAID]


def test_wrong_digits_and_empty_texts_give_nothing(found):
    assert all(found[i] == [] for i in range(len(SAID), len(SAID) + 5))


def test_catalogue_as_table_keeps_checks(spark):
    table = catalog.recognisers_frame(spark, catalog.CHECKED_RECOGNISERS)
    assert catalog.recognisers_from_frame(table) == catalog.CHECKED_RECOGNISERS
    assert set(catalog.PII_LABELS) - {r.label for r in catalog.CHECKED_RECOGNISERS} == {
        "nationality", "medication", "medical_condition", "email_address"
    }


def test_places_of_hits_that_stand_before_as_part_of_a_word(spark):
    text = "x09123456789 no. 09123456789\n09123456789, b.09123456789"
    df = spark.createDataFrame([(text,)], "text string")
    (row,) = pii.detect_pii(df).collect()
    assert [(e["label"], e["start"], e["end"]) for e in row["entities"]] == [
        ("mobile_phone_number", at, at + 11) for at in (17, 29, 44)
    ]


def test_failing_hits_take_their_place(spark):
    text = "é 4111111111111112 4111111111111111 4111111111111112 4111-1111-1111-1111"
    df = spark.createDataFrame([(text,)], "text string")
    (row,) = pii.detect_pii(df, catalog.IDENTIFIERS).collect()
    assert [(e["text"], e["start"]) for e in row["entities"]] == [
        ("4111111111111111", 19), ("4111-1111-1111-1111", 53)
    ]


@pytest.mark.parametrize("items", [catalog.RECOGNISERS, catalog.CHECKED_RECOGNISERS])
def test_known_starts_change_no_span(spark, items):
    texts = [s for s, _, _ in SAID] + [" ".join(s for s, _, _ in SAID), "éDE89370400440532013000", "AB-123456 ZAB-123456"]
    df = spark.createDataFrame([(s,) for s in texts], "text string")
    plain = [replace(r, starts=None) for r in items]
    rows = df.select(pii.candidate_spans("text", items).alias("a"), pii.candidate_spans("text", plain).alias("b"))
    found = rows.collect()
    assert any(r["a"] for r in found) and all(r["a"] == r["b"] for r in found)


def test_boundaries_are_looked_at_after_the_first_characters():
    items = [r for r in catalog.CHECKED_RECOGNISERS if r.guard is None or r.lead]
    assert all(pii._looks_first(r).startswith(f"(?=[{r.starts}])") for r in items)
    assert pii._looks_first(catalog.Recogniser("x", "other", r"\b[0-9]+", guard="a")) == r"\b[0-9]+"
    assert pii._looks_first(catalog.Recogniser("x", "other", r"[]^x]", starts="]^x")) == r"(?=[\]\^x])[]^x]"


def test_initials_of_a_wording():
    assert catalog._initials("(?:[Cc]ard )?[Ee]xpires") == "CEce"
    assert set("LlNn") <= set(catalog._initials("(?:[Ll]icen[cs]e|[Nn]umber) plate"))
    assert catalog._initials("CVV2?") == "C"


def test_pieces_of_a_file_are_dealt_to_all_cores(spark, sf_dir):
    texts = inputs.identified_texts(spark, sf_dir)
    sizes = [n for n in texts.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(sizes) >= spark.sparkContext.defaultParallelism and max(sizes) < 2 * sum(sizes) / len(sizes)
