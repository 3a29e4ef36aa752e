"""Rules, recognisers, cues and lexicons as data.

Nothing in the operators knows a word or a pattern: they take the lists below, or lists read from
any table of the same columns.  All entries are small configuration; they are unrolled into
expressions, never joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession

from . import schemas

MAX_CONFIG_ROWS = 2000


@dataclass(frozen=True)
class Rule:
    """One regular expression of a language pack.

    ``starts`` lists the ASCII characters a hit can start with, in small letters; where it is
    known, texts without a hit are told apart much faster.
    """

    language: str
    rule: str
    pattern: str
    starts: str | None = None


@dataclass(frozen=True)
class Recogniser:
    """One kind of personal data.

    ``guard`` is a literal the text must hold for the pattern to be tried at all.
    ``digit_led`` marks patterns whose hits start with a digit: one pass looks for all of them.
    ``lead`` is the wording in front of the value, which is matched but not part of the entity.
    ``check`` names a test of the digits (``functions.checks``) that a value must pass.
    ``starts`` lists the ASCII characters a hit (its lead, where there is one) can start with;
    where it is known, other places in a text are passed over much faster.
    """

    label: str
    group: str
    pattern: str
    guard: str | None = None
    digit_led: bool = False
    lead: str | None = None
    check: str | None = None
    starts: str | None = None


@dataclass(frozen=True)
class WeightedPattern:
    """A pattern that adds ``weight`` to a score for each hit."""

    name: str
    pattern: str
    weight: float
    starts: str | None = None


def _words(*words: str) -> tuple[str, str]:
    """Pattern for whole words, and the letters they start with."""
    return r"\b(?:" + "|".join(words) + r")\b", "".join(sorted({w[0] for w in words}))


def _rule(language: str, name: str, *words: str) -> Rule:
    return Rule(language, name, *_words(*words))


def _terms(name: str, weight: float, *words: str) -> WeightedPattern:
    pattern, starts = _words(*words)
    return WeightedPattern(name, pattern, weight, starts)


# Own word lists, ASCII only.  Packs for other languages or other wordings come in by table.
RULE_PACKS: dict[str, tuple[Rule, ...]] = {
    "english": (
        _rule("english", "profanity", "idiots?", "morons?", "stupid", "losers?", "pathetic"),
        _rule("english", "banned_words", "scum(?:bags?)?", "trash", "worthless", "disgusting", "clowns?"),
    ),
    "filipino": (
        _rule("filipino", "profanity", "engot", "gunggong", "hangal", "inutil"),
        _rule("filipino", "banned_words", "basura", "hampaslupa", "walang[ -]?hiya"),
    ),
    "german": (
        _rule("german", "profanity", "idiot(?:en)?", "trottel", "dummkopf"),
        _rule("german", "banned_words", "abschaum", "dreckskerl"),
    ),
    "french": (
        _rule("french", "profanity", "idiote?s?", "imbeciles?", "cretins?"),
        _rule("french", "banned_words", "ordures?", "racailles?"),
    ),
    "spanish": (
        _rule("spanish", "profanity", "idiotas?", "imbecil(?:es)?", "tontos?"),
        _rule("spanish", "banned_words", "basura", "escoria"),
    ),
}

# Row language codes for packs picked by the row's own language.
LANGUAGE_CODES = {
    "english": "en", "filipino": "fil", "german": "de", "french": "fr", "spanish": "es",
}

# What a rule leads to.
POLICIES = {"profanity": "warn", "banned_words": "block"}

# Replacement patterns applied after entity redaction, in this order.
REGEX_REDACTIONS = (
    (r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+", "[REDACTED_EMAIL]"),
    (r"(09[0-9]{9})", "[REDACTED_PH_PHONE]"),
)
# A text without the literal cannot match the pattern of the same place.
REGEX_REDACTION_GUARDS = ("@", "09")

# Labels that count as personal data.
PII_LABELS = (
    "email",
    "phone_number",
    "id_number",
    "username",
    "nationality",
    "credit_card_number",
    "social_security_number",
    "health_insurance_id_number",
    "date_of_birth",
    "mobile_phone_number",
    "bank_account_number",
    "medication",
    "cpf",
    "driver's_license_number",
    "tax_identification_number",
    "medical_condition",
    "identity_card_number",
    "national_id_number",
    "ip_address",
    "email_address",
    "iban",
    "credit_card_expiration_date",
    "health_insurance_number",
    "registration_number",
    "student_id_number",
    "insurance_number",
    "flight_number",
    "landline_phone_number",
    "blood_type",
    "cvv",
    "license_plate_number",
    "postal_code",
    "passport_number",
    "serial_number",
    "vehicle_registration_number",
    "fax_number",
    "visa_number",
    "identity_document_number",
    "transaction_number",
    "national_health_insurance_number",
    "cvc",
    "birth_certificate_number",
    "train_ticket_number",
    "passport_expiration_date",
)

_DIGITS = "0123456789"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NAME = r"[A-Z][a-z]+(?: [A-Z][a-z]+)*"

RECOGNISERS: tuple[Recogniser, ...] = (
    Recogniser("email", "other",
               r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", guard="@"),
    Recogniser("credit_card_number", "other",
               r"\b[0-9]{4}(?:[ -]?[0-9]{4}){3}\b", digit_led=True, starts=_DIGITS),
    Recogniser("phone_number", "other",
               r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}\b", guard="+"),
    Recogniser("mobile_phone_number", "other", r"\b09[0-9]{9}\b", guard="09", starts="0"),
    Recogniser("ip_address", "other", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", digit_led=True,
               starts=_DIGITS),
    Recogniser("social_security_number", "other",
               r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", digit_led=True, starts=_DIGITS),
    Recogniser("id_number", "other", r"\b[A-Z]{2}-[0-9]{6}\b", guard="-", starts=_CAPITALS),
    Recogniser("access_token", "other",
               r'\b[A-Za-z_]+ = "[0-9a-f]{40}"', guard=' = "'),
    Recogniser("username", "other", r"[A-Za-z0-9_]+", guard="username is ",
               lead=r"\busername is ", starts="u"),
    Recogniser("date_of_birth", "other", r"[0-9]{4}-[0-9]{2}-[0-9]{2}\b", guard="born on ",
               lead=r"\bborn on ", starts="b"),
    Recogniser("person", "person", _NAME, guard="name is ", lead=r"\b[Mm]y name is ", starts="Mm"),
    Recogniser("location", "location", _NAME, guard="live in ", lead=r"\bI live in ", starts="I"),
)

# Lengths of account numbers by country.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20,
    "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26,
    "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15,
    "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}


def _iban() -> str:
    """Countries of one length share a branch, so a number never runs into the next word."""
    branches = []
    for n in sorted(set(IBAN_LENGTHS.values())):
        countries = "|".join(c for c, length in IBAN_LENGTHS.items() if length == n)
        branches.append(rf"(?:{countries})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}")
    return r"\b(?:" + "|".join(branches) + r")\b"


_CODE = r"[A-Z0-9][A-Z0-9-]{4,19}\b"
_LONG = r"[0-9][0-9 -]{6,18}[0-9]\b"
_DAY = r"[0-9]{4}-[0-9]{2}-[0-9]{2}\b"
_CALL = r"\+?[0-9(][0-9() -]{6,18}[0-9]\b"


def _initials(words: str) -> str:
    """All characters the wording can start with, and maybe more: those of each alternative and after an optional part."""
    found = re.findall(r"(?:^|^\(\?:|\||\)\?)(?:\[([A-Za-z]+)\]|([A-Za-z]))", words)
    return "".join(sorted({c for several, one in found for c in several + one}))


def _named(label: str, guard: str, words: str, value: str) -> Recogniser:
    """A value known by the words in front of it."""
    lead = rf"\b(?:{words})(?: number| no\.?| code)?(?: is|:)? ?"
    check = "with_digit" if value == _CODE else None
    return Recogniser(label, "other", value, guard=guard, lead=lead, check=check, starts=_initials(words))


#: Identifiers proved by their check digits, then those known by the words before them.
IDENTIFIERS: tuple[Recogniser, ...] = (
    Recogniser("iban", "other", _iban(), check="mod97",
               starts="".join(sorted({country[0] for country in IBAN_LENGTHS}))),
    Recogniser("credit_card_number", "other", r"\b[0-9]{4}(?:[ -]?[0-9]{4}){3}\b",
               digit_led=True, check="luhn", starts=_DIGITS),
    Recogniser("cpf", "other", r"\b[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}\b",
               digit_led=True, check="mod11", starts=_DIGITS),
    Recogniser("passport_number", "other",
               r"\b[A-Z][A-Z0-9<]{8}[0-9][A-Z<]{3}[0-9]{7}[MFX<][0-9]{7}[A-Z0-9<]{14}[0-9<][0-9]\b",
               guard="<", check="machine_zone", starts=_CAPITALS),
    _named("cvv", "CVV", "CVV2?", r"[0-9]{3,4}\b"),
    _named("cvc", "CVC", "CVC2?", r"[0-9]{3}\b"),
    _named("passport_expiration_date", "assport expir", "[Pp]assport expir(?:es on|es|y|y date|ation date)", _DAY),
    _named("credit_card_expiration_date", "xpir", "(?:[Cc]ard )?[Ee]xpir(?:es on|es|y|y date|ation date)",
           r"(?:0[1-9]|1[0-2])/[0-9]{2}(?:[0-9]{2})?\b"),
    _named("passport_number", "assport", "[Pp]assport", r"[A-Z]{0,2}[0-9]{6,9}\b"),
    _named("visa_number", "isa", "[Vv]isa", r"[A-Z]{0,2}[0-9]{7,10}\b"),
    _named("vehicle_registration_number", "ehicle registration", "[Vv]ehicle registration", _CODE),
    _named("license_plate_number", " plate", "(?:[Ll]icen[cs]e|[Nn]umber) plate", r"[A-Z0-9]{1,4}[ -][A-Z0-9]{2,5}\b"),
    _named("driver's_license_number", "river", "[Dd]river'?s? licen[cs]e", _CODE),
    _named("registration_number", "egistration", "[Rr]egistration", _CODE),
    _named("serial_number", "erial", "[Ss]erial", _CODE),
    _named("student_id_number", "tudent ID", "[Ss]tudent ID", _CODE),
    _named("national_health_insurance_number", "ational health insurance", "[Nn]ational health insurance", _CODE),
    _named("health_insurance_id_number", "ealth insurance ID", "[Hh]ealth insurance ID", _CODE),
    _named("health_insurance_number", "ealth insurance", "[Hh]ealth insurance", _CODE),
    _named("insurance_number", "nsurance", "[Ii]nsurance", _CODE),
    _named("national_id_number", "ational ID", "[Nn]ational ID", _CODE),
    _named("identity_card_number", "dentity card", "[Ii]dentity card", _CODE),
    _named("identity_document_number", "dentity document", "[Ii]dentity document", _CODE),
    _named("tax_identification_number", "ax ", "[Tt]ax (?:ID|identification)", _CODE),
    _named("birth_certificate_number", "irth certificate", "[Bb]irth certificate", _CODE),
    _named("bank_account_number", "ccount", "(?:[Bb]ank )?[Aa]ccount", _LONG),
    _named("transaction_number", "ransaction", "[Tt]ransaction", _CODE),
    _named("train_ticket_number", "rain ticket", "[Tt]rain ticket", _CODE),
    _named("flight_number", "light", "[Ff]light", r"[A-Z][A-Z0-9] ?[0-9]{1,4}\b"),
    _named("postal_code", "ode", "(?:[Pp]ostal|[Pp]ost|ZIP|[Zz]ip)", r"[A-Z0-9]{3,5}(?:[ -][0-9][A-Z0-9]{2,3})?\b"),
    _named("fax_number", "ax", "[Ff]ax", _CALL),
    _named("landline_phone_number", "andline", "[Ll]andline(?: phone)?", _CALL),
    _named("blood_type", "lood", "[Bb]lood (?:type|group)", r"(?:AB|A|B|O)[+-]"),
)

#: All recognisers: a card number must pass its check here.
CHECKED_RECOGNISERS: tuple[Recogniser, ...] = IDENTIFIERS + tuple(
    r for r in RECOGNISERS if r.label != "credit_card_number"
)

# Toxicity lexicon: weight per hit.
TOXIC_TERMS: tuple[WeightedPattern, ...] = (
    _terms("strong", 1.0, "scum(?:bags?)?", "worthless", "disgusting", "morons?"),
    _terms("mild", 0.6, "idiots?", "stupid", "trash", "clowns?", "pathetic", "losers?"),
)
TOXIC_RATE = 1.0

# Injection cues: weight per hit.
INJECTION_CUES: tuple[WeightedPattern, ...] = (
    WeightedPattern(
        "override",
        r"\b(?:ignore|disregard|forget)(?: all| any)?(?: of)?(?: the| your)?"
        r" (?:previous|prior|above|earlier) (?:instructions?|prompts?|rules?|messages?)\b",
        1.5,
        "dfi",
    ),
    WeightedPattern(
        "leak",
        r"\b(?:reveal|print|show|repeat)(?: me)?(?: the| your)?"
        r" (?:hidden |initial |system )+(?:prompt|instructions?|message)\b",
        1.2,
        "prs",
    ),
    WeightedPattern(
        "role", r"\b(?:you are now|pretend to be|developer mode|jailbreak)\b", 0.8, "djpy"
    ),
    WeightedPattern("delimiter", r"(?:#{3,}|%{3,}|&{3,})", 0.02, "#%&"),
)
INJECTION_RATE = 1.0
INJECTION_LABEL = "INJECTION"
NO_INJECTION_LABEL = "NO_INJECTION"
INJECTION_LABEL_ABOVE = 0.5


def add_pack(rules: Sequence[Rule], pack: str | Iterable[Rule]) -> tuple[Rule, ...]:
    """Add a language pack, by name or as rules; what is there under the same key stays."""
    new = RULE_PACKS[pack] if isinstance(pack, str) else tuple(pack)
    known = {(r.language, r.rule) for r in rules}
    return tuple(rules) + tuple(r for r in new if (r.language, r.rule) not in known)


def default_rules() -> tuple[Rule, ...]:
    """English and Filipino packs."""
    return add_pack(add_pack((), "english"), "filipino")


def all_rules() -> tuple[Rule, ...]:
    rules: tuple[Rule, ...] = ()
    for name in RULE_PACKS:
        rules = add_pack(rules, name)
    return rules


def select_languages(rules: Sequence[Rule], languages: Sequence[str] | None) -> tuple[Rule, ...]:
    """Rules of the named languages in the order named; None takes all."""
    if languages is None:
        return tuple(rules)
    missing = set(languages) - {r.language for r in rules}
    if missing:
        raise KeyError(f"no rule pack for {sorted(missing)}")
    return tuple(r for lang in languages for r in rules if r.language == lang)


def rules_frame(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """Catalogue as a table ``(position, language, rule, pattern, action, starts)``."""
    rows = [
        (i, r.language, r.rule, r.pattern, POLICIES.get(r.rule), r.starts) for i, r in enumerate(rules)
    ]
    return spark.createDataFrame(rows, schemas.RULES)


def _config_rows(df: DataFrame) -> list[Row]:
    rows = df.limit(MAX_CONFIG_ROWS + 1).collect()
    if len(rows) > MAX_CONFIG_ROWS:
        raise ValueError(f"a catalogue holds at most {MAX_CONFIG_ROWS} entries")
    return rows


def rules_from_frame(df: DataFrame) -> tuple[Rule, ...]:
    """Read a catalogue table; it is configuration, so its size is checked."""
    rows = sorted(_config_rows(df), key=lambda r: r["position"])
    out: tuple[Rule, ...] = ()
    for r in rows:
        out = add_pack(out, [Rule(r["language"], r["rule"], r["pattern"], r["starts"])])
    return out


def recognisers_frame(spark: SparkSession, items: Sequence[Recogniser] = RECOGNISERS) -> DataFrame:
    """Recogniser catalogue as a table."""
    rows = [
        (i, r.label, r.group, r.pattern, r.guard, r.digit_led, r.lead, r.check, r.starts)
        for i, r in enumerate(items)
    ]
    return spark.createDataFrame(rows, schemas.RECOGNISERS)


def recognisers_from_frame(df: DataFrame) -> tuple[Recogniser, ...]:
    rows = sorted(_config_rows(df), key=lambda r: r["position"])
    return tuple(
        Recogniser(
            r["label"], r["group"], r["pattern"], r["guard"], bool(r["digit_led"]), r["lead"],
            r["check"] if "check" in r else None, r["starts"] if "starts" in r else None,
        )
        for r in rows
    )
