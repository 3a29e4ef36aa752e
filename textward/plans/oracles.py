"""SQL (DuckDB) that gives the result of each named query on the same tables.

The statements are written from the definitions, not from the Spark plans: spans come from split
pieces, similarities from joins on words, top-k from ranking all pairs.  Catalogue entries and
policy values are filled in from the same data the operators use.
"""

from __future__ import annotations

from .. import catalog
from ..config import ScreeningPolicy
from . import registry

# RE2 knows ASCII word boundaries only: accented letters become word characters of ASCII.
ACCENTED = r"[\x{00C0}-\x{024F}]"


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def num(value: float) -> str:
    return f"CAST({float(value)!r} AS DOUBLE)"


def r6(expr: str) -> str:
    return f"(round({expr}, 6) + 0.0)"


def mask(text: str) -> str:
    return f"regexp_replace({text}, {q(ACCENTED)}, '_', 'g')"


def hits(pattern: str, text: str = "m") -> str:
    return f"regexp_extract_all({text}, {q('(?i)' + pattern)})"


def n_hits(pattern: str, text: str = "m") -> str:
    return f"len({hits(pattern, text)})"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


TEXTS = f"""
texts AS (
  SELECT *, {mask("text")} AS m FROM (
    SELECT 'doc-' || doc_id AS text_id, lang, text FROM documents
    UNION ALL
    SELECT 'conv-' || conv_id || '-' || turn, NULL, text FROM conversations WHERE role = 'user'
  )
)"""
DOCS = f"docs AS (SELECT *, {mask('text')} AS m FROM documents)"

_ALL = catalog.all_rules()
_DEFAULT = catalog.default_rules()


def rule_list(rules) -> str:
    parts = [
        f"list_transform({hits(r.pattern)}, lambda x: struct_pack(language := {q(r.language)}, "
        f"rule := {q(r.rule)}, match := x))"
        for r in rules
    ]
    return "flatten([" + ", ".join(parts) + "])"


def rule_count(rules) -> str:
    return "(" + " + ".join(n_hits(r.pattern) for r in rules) + ")"


def weighted(patterns) -> str:
    return "(" + " + ".join(f"{n_hits(p.pattern)} * {num(p.weight)}" for p in patterns) + ")"


TOXICITY = f"(1 - exp(-{num(catalog.TOXIC_RATE)} * {weighted(catalog.TOXIC_TERMS)}))"
INJECTION = f"(1 - exp(-{num(catalog.INJECTION_RATE)} * {weighted(catalog.INJECTION_CUES)}))"


def spans(source: str, key: str, recognisers=catalog.RECOGNISERS) -> str:
    """CTE ``spans``: one row per entity of the texts of ``source``."""
    parts = []
    for place, r in enumerate(recognisers):
        p = q((r.lead or "") + r.pattern)
        lead = q("^" + r.lead) if r.lead else "'^$'"
        parts.append(
            f"SELECT {key}, {q(r.label)} AS label, {place} AS place, {lead} AS lead, "
            f"regexp_split_to_array(m, {p}) AS sp, regexp_extract_all(m, {p}) AS hi FROM {source}"
        )
    union = "\nUNION ALL ".join(parts)
    return f"""
found AS ({union}),
numbered AS (SELECT *, unnest(range(1, len(hi) + 1)) AS k FROM found WHERE len(hi) > 0),
located AS (
  SELECT {key}, label, place, hi[k] AS whole, regexp_replace(hi[k], lead, '') AS value,
    list_sum(list_transform(sp[1:k], lambda x: length(x)))
      + coalesce(list_sum(list_transform(hi[1:k-1], lambda x: length(x))), 0)
      + length(hi[k]) AS span_end
  FROM numbered
),
spans AS (
  SELECT {key}, label, place, CAST(span_end - length(value) AS BIGINT) AS span_start,
    CAST(span_end AS BIGINT) AS span_end FROM located
)"""


def resolved_spans(key: str, recognisers) -> str:
    """CTEs up to ``kept``: the spans whose digits hold, leftmost, then longest, then by place.

    ``walk`` goes through the spans of a text in that order and keeps what starts behind the last kept one.
    """
    value = "substr(text, CAST(span_start AS INT) + 1, CAST(span_end - span_start AS INT))"
    digit = "strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', {0}[i]) - 1"

    def values(x: str) -> str:
        return f"list_transform(range(1, length({x}) + 1), lambda i: greatest({digit.format(x)}, 0))"

    only = "regexp_replace(v, '[^{0}]', '', 'g')"
    luhn = (
        f"(list_sum(list_transform({values('reverse(' + only.format('0-9') + ')')}, lambda x, i: "
        "CASE WHEN i % 2 = 1 THEN x WHEN x > 4 THEN 2 * x - 9 ELSE 2 * x END)) % 10 = 0)"
    )
    account = only.format("A-Z0-9")
    mod97 = (
        f"(list_reduce(list_prepend(0::BIGINT, {values(f'({account}[5:] || {account}[:4])')}), "
        "lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1)"
    )
    taxpayer = only.format("0-9")

    def weighted_digit(n: int) -> str:
        total = " + ".join(f"{n + 2 - i} * {taxpayer}[{i}]::INT" for i in range(1, n + 1))
        return f"(({total}) * 10 % 11 % 10 = {taxpayer}[{n + 1}]::INT)"

    mod11 = (
        f"(length(replace({taxpayer}, {taxpayer}[1], '')) > 0 AND {weighted_digit(9)} AND {weighted_digit(10)})"
    )
    tests = {"luhn": luhn, "mod97": mod97, "mod11": mod11, "machine_zone": "false",
             "with_digit": "regexp_matches(v, '[0-9]')"}
    cases = " ".join(
        f"WHEN place = {i} THEN {tests[r.check]}" for i, r in enumerate(recognisers) if r.check
    )
    return f"""
valued AS (SELECT s.*, {value} AS v FROM spans s JOIN texts USING ({key})),
proved AS (SELECT * FROM valued WHERE CASE {cases} ELSE true END),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY span_start, span_end DESC, place) AS n FROM proved),
walk AS (
  SELECT {key}, n, label, v, span_start, span_end, span_end AS pos, true AS good FROM ordered WHERE n = 1
  UNION ALL
  SELECT o.{key}, o.n, o.label, o.v, o.span_start, o.span_end,
    CASE WHEN o.span_start >= w.pos THEN o.span_end ELSE w.pos END, o.span_start >= w.pos
  FROM walk w JOIN ordered o ON o.{key} = w.{key} AND o.n = w.n + 1),
kept AS (SELECT * FROM walk WHERE good)"""


def pii_counts(key: str, labels=catalog.PII_LABELS) -> str:
    names = ", ".join(q(x) for x in labels)
    return f"pii AS (SELECT {key}, count(*) AS n FROM spans WHERE label IN ({names}) GROUP BY 1)"


def decision_cte(
    source: str, key: str, policy: ScreeningPolicy, toxicity: str | None = None
) -> str:
    """CTEs up to ``decisions`` (unrounded) for the texts of ``source``."""
    rules = catalog.select_languages(_DEFAULT, policy.languages)
    p = policy
    tox = TOXICITY if toxicity is None else toxicity
    if p.mode == "compat":
        inj, inj_limit = "CASE WHEN injection > 0.5 THEN 99999.0 ELSE 0.0 END", 0.99
    else:
        inj, inj_limit = "injection", p.threshold_injection
    base = f"(1 + (banned_words * {num(p.weight_banned_word)} + pii_count * {num(p.weight_pii)}))"
    overall = f"{base} * ((1 + toxicity) * {num(p.weight_toxicity)})"
    limit = (
        f"{num(p.weight_overall)} * ((1 + (banned_words + pii_count)) * (1 + toxicity))"
    )
    table = [
        ("Banned_Words", "CAST(banned_words AS DOUBLE)", num(p.banned_word_tolerance)),
        ("Toxicity_Score", "toxicity", num(p.threshold_toxicity)),
        ("Personable_Interifiable_Information", "CAST(pii_count AS DOUBLE)", num(p.threshold_pii)),
        ("Prompt_Injection", f"CAST({inj} AS DOUBLE)", num(inj_limit)),
        ("Overall_Score", overall, limit),
    ]
    ladder = []
    for kind in ("filter", "flag") if p.enable_reword else ("filter",):
        for name, score, bound in table:
            if kind == "filter":
                test = f"{score} > {bound}"
            else:
                test = (
                    f"{score} > {bound} * {num(p.reword_factor)} AND NOT ({score} > {bound})"
                )
            ladder.append(
                f"WHEN {test} THEN struct_pack(action := '{kind}', gate := {q(name)}, "
                f"score := {score}, threshold := {bound})"
            )
    return f"""
{spans(source, key)},
{pii_counts(key)},
scored AS (
  SELECT t.*, CAST({rule_count(rules)} AS BIGINT) AS banned_words,
    CAST({tox} AS DOUBLE) AS toxicity,
    coalesce(p.n, 0) AS pii_count, CAST({INJECTION} AS DOUBLE) AS injection
  FROM {source} t LEFT JOIN pii p USING ({key})
),
picked AS (
  SELECT *, CASE {" ".join(ladder)}
    ELSE struct_pack(action := 'pass', gate := NULL::VARCHAR, score := NULL::DOUBLE,
                     threshold := NULL::DOUBLE) END AS d
  FROM scored
),
decisions AS (
  SELECT * EXCLUDE (d), d.action AS action, d.gate AS gate, d.score AS score,
    d.threshold AS threshold,
    CASE WHEN d.action <> 'filter' THEN NULL
      WHEN d.gate IN ('Banned_Words', 'Personable_Interifiable_Information')
      THEN 'Filtered due to ' || d.gate || ', ' || CAST(CAST(d.score AS BIGINT) AS VARCHAR)
        || ' > ' || CAST(CAST(d.threshold AS BIGINT) AS VARCHAR)
      ELSE 'Filtered due to ' || d.gate || ', ' || printf('%.6f', d.score) || ' > '
        || printf('%.6f', d.threshold) END AS reason
  FROM picked
)"""


def decisions(source_cte: str, source: str, key: str, policy, toxicity: str | None = None) -> str:
    return f"""WITH {source_cte}, {decision_cte(source, key, policy, toxicity)}
SELECT {key}, banned_words, {r6("toxicity")} AS toxicity, CAST(pii_count AS BIGINT) AS pii_count,
  {r6("injection")} AS injection, action, gate, {r6("score")} AS score,
  {r6("threshold")} AS threshold, reason
FROM decisions"""


def redaction(key: str, source: str, which: str = "true") -> str:
    """CTE ``redacted(key, text)`` from ``spans``: entities, then the replacement patterns."""
    out = "raw"
    for pattern, new in catalog.REGEX_REDACTIONS:
        out = f"regexp_replace({out}, {q(pattern)}, {q(new)}, 'g')"
    return f"""
ordered AS (
  SELECT s.*, t.text, lag(span_end, 1, 0) OVER (PARTITION BY {key} ORDER BY span_start) AS prev
  FROM spans s JOIN {source} t USING ({key}) WHERE {which}
),
glued AS (
  SELECT {key}, max(span_end) AS last, string_agg(
    substr(text, prev + 1, span_start - prev) || '[REDACTED_' || upper(label) || ']', ''
    ORDER BY span_start) AS head
  FROM ordered GROUP BY 1
),
redacted AS (
  SELECT {key}, {out} AS redacted_text FROM (
    SELECT t.{key}, coalesce(head, '') || substr(text, coalesce(last, 0) + 1) AS raw
    FROM {source} t LEFT JOIN glued USING ({key}))
)"""


def tokens(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[\\p{{L}}0-9]+')"


def slots(text: str) -> str:
    return (
        f"list_transform({tokens(text)}, "
        "lambda t: CAST('0x' || substr(md5(t), 1, 6) AS BIGINT) % 64)"
    )


def embedded(name: str, select: str) -> str:
    """CTE ``name`` of ``select`` (which gives ``slots``) with the vector ``e``."""
    return f"""{name} AS (
  SELECT * EXCLUDE (slots), list_transform(range(0, 64),
    lambda d: CAST(len(list_filter(slots, lambda s: s = d)) AS DOUBLE)) AS e
  FROM ({select})
)"""


def top_k(name: str, queries: str, store: str, k: int, extra: str = "") -> str:
    """CTE ``name(query_id, rank, chunk_id, distance)`` by ranking all pairs."""
    return f"""{name}_pairs AS (
  SELECT query_id, chunk_id, 1 - CASE WHEN list_sum(list_transform(a.e, lambda x: x * x)) = 0
      OR list_sum(list_transform(b.e, lambda x: x * x)) = 0 THEN 0
      ELSE list_cosine_similarity(a.e, b.e) END AS distance
  FROM {queries} a, {store} b
),
{name} AS (
  SELECT query_id, CAST(rank AS BIGINT) AS rank, chunk_id, distance FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id
      ORDER BY floor(distance * 1000000 + 0.5), chunk_id) AS rank FROM {name}_pairs)
  WHERE rank <= {k} {extra}
)"""


def word_cosine(name: str, pairs: str, key: str) -> str:
    """CTE ``name(key, score)``: cosine of word counts of ``a`` and ``b`` of each pair."""
    return f"""{name}_a AS (
  SELECT {key}, w, count(*) AS n FROM (SELECT {key}, unnest({tokens("a")}) AS w FROM {pairs})
  GROUP BY ALL),
{name}_b AS (
  SELECT {key}, w, count(*) AS n FROM (SELECT {key}, unnest({tokens("b")}) AS w FROM {pairs})
  GROUP BY ALL),
{name}_na AS (SELECT {key}, CAST(sum(n * n) AS DOUBLE) AS s FROM {name}_a GROUP BY ALL),
{name}_nb AS (SELECT {key}, CAST(sum(n * n) AS DOUBLE) AS s FROM {name}_b GROUP BY ALL),
{name}_d AS (
  SELECT {key}, CAST(sum(x.n * y.n) AS DOUBLE) AS s
  FROM {name}_a x JOIN {name}_b y USING ({key}, w) GROUP BY ALL),
{name} AS (
  SELECT p.*, coalesce(d.s / (sqrt(na.s) * sqrt(nb.s)), 0.0) AS score
  FROM {pairs} p LEFT JOIN {name}_d d USING ({key}) LEFT JOIN {name}_na na USING ({key})
  LEFT JOIN {name}_nb nb USING ({key})
)"""


def clip(text: str) -> str:
    return f"CASE WHEN length({text}) > 200 THEN substr({text}, 1, 200) || '...' ELSE {text} END"


STRICT, OVERALL, COMPAT = registry.STRICT, registry.OVERALL, registry.COMPAT
DEFAULT = registry.DEFAULT

ORACLES: dict[str, str] = {}

# --- rules ---------------------------------------------------------------------------------

ORACLES["rule_detections"] = f"""WITH {TEXTS},
d AS (SELECT text_id, {rule_list(_ALL)} AS found FROM texts)
SELECT text_id, hit_no, h.language AS language, h.rule AS rule, h.match AS match FROM (
  SELECT text_id, unnest(range(0, len(found))) AS hit_no, unnest(found) AS h FROM d)"""

_by_lang = " + ".join(
    f"CASE WHEN lang = {q(catalog.LANGUAGE_CODES[r.language])} THEN {n_hits(r.pattern)} ELSE 0 END"
    for r in _ALL
)
ORACLES["language_packs"] = f"""WITH {DOCS}
SELECT doc_id, lang, CAST({_by_lang} AS BIGINT) AS detections FROM docs"""

_acts = "list_transform(found, lambda h: CASE h.rule " + " ".join(
    f"WHEN {q(k)} THEN {q(v)}" for k, v in catalog.POLICIES.items()
) + " END)"
ORACLES["prompt_policy"] = f"""WITH {TEXTS},
d AS (SELECT text_id, {rule_list(_DEFAULT)} AS found FROM texts),
a AS (SELECT text_id, found, {_acts} AS acts FROM d)
SELECT text_id, CAST(len(found) AS BIGINT) AS detections,
  CAST(len(list_filter(acts, lambda x: x = 'warn')) AS BIGINT) AS warnings,
  CAST(len(list_filter(acts, lambda x: x = 'block')) AS BIGINT) AS blocks,
  coalesce(array_to_string(acts, ','), '') AS actions, len(acts) = 0 AS is_safe FROM a"""

ORACLES["detections_by_rule"] = f"WITH {DOCS}\n" + "\nUNION ALL\n".join(
    f"SELECT lang, {q(r.language)} AS language, {q(r.rule)} AS rule, "
    f"CAST(sum({n_hits(r.pattern)}) AS BIGINT) AS hits, "
    f"count_if({n_hits(r.pattern)} > 0)::BIGINT AS texts FROM docs GROUP BY lang"
    for r in _ALL
)

_PIECE = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"
ORACLES["term_detections"] = rf"""WITH p AS (
  SELECT doc_id, i, p[i] AS a, p[i + 1] AS gap, p[i + 2] AS b FROM (
    SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(lower(text), '{_PIECE}+|[^{_PIECE[1:]}+') AS p FROM documents))),
said AS (
  SELECT p[i] AS a, p[i + 1] AS gap, p[i + 2] AS b FROM (
    SELECT p, unnest(range(1, len(p) - 1)) AS i FROM (
      SELECT regexp_extract_all(lower(text), '{_PIECE}+|[^{_PIECE[1:]}+') AS p FROM benchmark))),
pairs AS (SELECT DISTINCT a, b FROM said WHERE gap = ' ' AND a <> b),
hits AS (
  SELECT doc_id, 'word' AS rule, a AS hit FROM p WHERE length(a) >= 8 AND regexp_matches(a, '^{_PIECE}+$')
  UNION ALL SELECT doc_id, 'pair', a || ' ' || b FROM p JOIN pairs USING (a, b) WHERE gap = ' ')
SELECT doc_id, count(hit) FILTER (WHERE rule = 'word') AS words, count(hit) FILTER (WHERE rule = 'pair') AS pairs,
  md5(coalesce(string_agg(hit, '|' ORDER BY encode(hit)), '')) AS matches_md5
FROM documents LEFT JOIN hits USING (doc_id) GROUP BY doc_id"""

# --- personal data -------------------------------------------------------------------------

ORACLES["pii_entities"] = f"""WITH {TEXTS}, {spans("texts", "text_id")}
SELECT s.text_id, CAST(row_number() OVER (PARTITION BY s.text_id ORDER BY span_start) - 1 AS BIGINT)
    AS entity_no,
  label, substr(t.text, span_start + 1, span_end - span_start) AS entity, span_start, span_end
FROM spans s JOIN texts t USING (text_id)"""

_digits = "translate(md5(doc_id || ':' || n), 'abcdef', '012345')"


def _cut(start: int, n: int) -> str:
    return f"substr({_digits}, {start}, {n})"


_piece = " || ".join(
    [q("Card "), _cut(1, 16), q(", DE"), _cut(1, 20), q(", GB"), _cut(3, 2), q(" WEST "), _cut(5, 14),
     q(", CPF "), _cut(1, 3), q("."), _cut(4, 3), q("."), _cut(7, 3), q("-"), _cut(10, 2),
     q(", CVV is "), _cut(20, 3), q(", expires "), _cut(23, 2), q("/"), _cut(25, 2),
     q(", vehicle registration AB"), _cut(8, 6), q(", insurance POLICY, fax "), _cut(9, 9)]
)
ORACLES["pii_identifiers"] = f"""WITH RECURSIVE texts AS (SELECT *, {mask("text")} AS m FROM (
  SELECT doc_id || '-' || n AS text_id,
    CASE WHEN n = 1 THEN coalesce(text, '') ELSE '' END || chr(10) || {_piece} AS text
  FROM (SELECT doc_id, text, unnest(range(1, 21)) AS n FROM documents))),
{spans("texts", "text_id", catalog.CHECKED_RECOGNISERS)}, {resolved_spans("text_id", catalog.CHECKED_RECOGNISERS)}
SELECT text_id, CAST(row_number() OVER (PARTITION BY text_id ORDER BY span_start) - 1 AS BIGINT) AS entity_no,
  label, v AS entity, span_start, span_end FROM kept"""

_labels = ", ".join(f"({q(r.label)})" for r in catalog.RECOGNISERS)
ORACLES["pii_by_label"] = f"""WITH {DOCS}, {spans("docs", "doc_id")},
names(label) AS (VALUES {_labels}), langs AS (SELECT DISTINCT lang FROM docs),
c AS (SELECT lang, label, count(*) AS n, count(DISTINCT doc_id) AS t
      FROM spans JOIN docs USING (doc_id) GROUP BY ALL)
SELECT l.lang, names.label, coalesce(n, 0)::BIGINT AS entities, coalesce(t, 0)::BIGINT AS texts
FROM langs l CROSS JOIN names LEFT JOIN c ON c.lang = l.lang AND c.label = names.label"""

ORACLES["pii_redacted"] = f"""WITH {DOCS}, {spans("docs", "doc_id")}, {pii_counts("doc_id")},
{redaction("doc_id", "docs")}
SELECT doc_id, coalesce(n, 0)::BIGINT AS pii_count, length(redacted_text)::BIGINT
  AS redacted_chars, md5(redacted_text) AS redacted_md5
FROM redacted LEFT JOIN pii USING (doc_id)"""

_LEFT_ALONE = {
    "redact_person": "label <> 'person'",
    "redact_location": "label <> 'location'",
    "redact_other": "label IN ('person', 'location')",
}
ORACLES["pii_redacted_switches"] = f"WITH {DOCS}, {spans('docs', 'doc_id')}\n" + "\nUNION ALL\n".join(
    f"SELECT * FROM (WITH {redaction('doc_id', 'docs', which)} "
    f"SELECT doc_id, {q(off)} AS off, md5(redacted_text) AS redacted_md5 FROM redacted)"
    for off, which in _LEFT_ALONE.items()
)

_rx = "text"
for _pattern, _new in catalog.REGEX_REDACTIONS:
    _rx = f"regexp_replace({_rx}, {q(_pattern)}, {q(_new)}, 'g')"
ORACLES["pii_regex_redacted"] = f"SELECT doc_id, md5({_rx}) AS redacted_md5 FROM documents"

# --- scores --------------------------------------------------------------------------------

ORACLES["toxicity_lexicon"] = f"WITH {DOCS} SELECT doc_id, {r6(TOXICITY)} AS toxicity FROM docs"

ORACLES["softmax_max"] = f"""WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS l FROM embeddings),
w AS (SELECT vec_id, l, list_max(l) AS top FROM v)
SELECT vec_id, {r6("1 / list_sum(list_transform(l, lambda x: exp(x - top)))")} AS softmax_max,
  {r6("1 / (1 + exp(-top))")} AS sigmoid_max FROM w"""

ORACLES["injection_cues"] = f"""WITH {TEXTS}, s AS (SELECT text_id, {INJECTION} AS s FROM texts)
SELECT text_id, CASE WHEN s > 0.5 THEN 'INJECTION' ELSE 'NO_INJECTION' END AS label,
  {r6("CASE WHEN s > 0.5 THEN s ELSE 1 - s END")} AS score FROM s"""

# --- gates ---------------------------------------------------------------------------------

ORACLES["gate_decisions"] = decisions(TEXTS, "texts", "text_id", DEFAULT)
ORACLES["gate_decisions_strict"] = decisions(TEXTS, "texts", "text_id", STRICT)
ORACLES["gate_decisions_overall"] = decisions(TEXTS, "texts", "text_id", OVERALL)
ORACLES["gate_decisions_compat"] = decisions(TEXTS, "texts", "text_id", COMPAT)
ORACLES["gate_policies"] = "\nUNION ALL\n".join(
    f"SELECT {q(p.name)} AS policy, text_id, action, gate, score, reason "
    f"FROM ({ORACLES[name]})"
    for p, name in (
        (DEFAULT, "gate_decisions"),
        (STRICT, "gate_decisions_strict"),
        (OVERALL, "gate_decisions_overall"),
    )
)
_STRICT_DOCS = f"{DOCS}, {decision_cte('docs', 'doc_id', STRICT)}"

ORACLES["gate_funnel"] = f"""WITH {_STRICT_DOCS}
SELECT lang, action, coalesce(gate, 'none') AS gate, count(*) AS texts FROM decisions GROUP BY ALL"""

_STAMP = "(TIMESTAMP '2024-01-01' + to_minutes(doc_id))"
ORACLES["audit_log"] = f"""WITH {_STRICT_DOCS}
SELECT CAST(doc_id AS VARCHAR) AS text_id, action, gate, {r6("score")} AS score, reason,
  strftime({_STAMP}, '%Y-%m-%d') AS run_date FROM decisions"""

ORACLES["filtered_marker"] = f"""WITH {_STRICT_DOCS}
SELECT doc_id, action = 'filter' AS is_marker, md5(CASE WHEN action = 'filter' THEN 'Filtered.'
  ELSE 'Use the following as context for the prompt: "' || source || '"' || chr(10) || text END) AS prompt_md5
FROM decisions"""

# --- evaluation ----------------------------------------------------------------------------


def categories(separator: str = " | ") -> str:
    names = ", ".join(
        f"CASE WHEN {n_hits(r.pattern)} > 0 THEN {q(r.language + ' ' + r.rule)} END" for r in _ALL
    )
    return (
        f"coalesce(array_to_string(list_filter([{names}], lambda x: x IS NOT NULL), "
        f"{q(separator)}), '')"
    )


_EVAL = f"""{DOCS}, passages AS (SELECT *, {mask("text")} AS m FROM benchmark),
evals AS (
  SELECT text AS prompt, '' AS attack_type, toxic = 1 AS malicious, 'documents' AS source
  FROM docs JOIN labels USING (doc_id)
  UNION ALL
  SELECT text, role, false, 'conversations' FROM conversations WHERE role = 'user'
  UNION ALL
  SELECT text, {categories()}, true, 'benchmark' FROM passages
)"""
ORACLES["eval_union"] = f"""WITH {_EVAL}
SELECT md5(prompt) AS prompt_md5, attack_type, malicious, source FROM evals"""
ORACLES["eval_subset"] = f"""WITH {_EVAL}
SELECT source, malicious, count(*) AS prompts FROM evals
WHERE source IN ('documents', 'benchmark') GROUP BY ALL"""
ORACLES["eval_files"] = f"""WITH {DOCS}
SELECT md5(text) AS prompt_md5, '' AS attack_type, toxic = 1 AS malicious, 'labelled' AS source
FROM docs JOIN labels USING (doc_id)
UNION ALL SELECT md5(text), {categories()}, true, 'red' FROM docs"""
ORACLES["attack_types"] = f"WITH {DOCS} SELECT doc_id, {categories()} AS attack_type FROM docs"
ORACLES["eval_batches"] = """
SELECT doc_id, row_no, (row_no - 1) // 16 AS batch_no FROM (
  SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) AS row_no
  FROM documents)"""

_COUNTS = """count_if(f AND b)::BIGINT AS tp, count_if(f AND NOT b)::BIGINT AS fp,
  count_if(NOT f AND b)::BIGINT AS fn, count_if(NOT f AND NOT b)::BIGINT AS tn"""
_RATES = """SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM counted"""
_FINAL = f"""tp, fp, fn, tn, {r6("p::DOUBLE")} AS precision, {r6("r::DOUBLE")} AS recall,
  {r6("(CASE WHEN p + r > 0 THEN 2 * (p * r) / (p + r) ELSE 0.0 END)::DOUBLE")} AS f1"""
_JUDGED = f"""{_STRICT_DOCS},
judged AS (SELECT d.*, action = 'filter' AS f, toxic = 1 AS b
           FROM decisions d JOIN labels USING (doc_id))"""
_CONFUSION = f"""WITH {_JUDGED}, counted AS (SELECT {_COUNTS} FROM judged), rates AS ({_RATES})
SELECT {_FINAL} FROM rates"""
ORACLES["confusion_metrics"] = _CONFUSION
ORACLES["metrics_report"] = _CONFUSION
ORACLES["metrics_from_log"] = _CONFUSION
ORACLES["metrics_from_split_log"] = _CONFUSION
ORACLES["metrics_by_slice"] = f"""WITH {_JUDGED}, counted AS (
  SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source'
    ELSE '(all)' END AS slice, coalesce(lang, source) AS value, {_COUNTS}
  FROM judged GROUP BY GROUPING SETS ((lang), (source), ())), rates AS ({_RATES})
SELECT slice, value, {_FINAL} FROM rates"""
ORACLES["results_log"] = f"""WITH {_JUDGED}, lines AS (
  SELECT doc_id, unnest(['Prompt', 'Attack Type', 'Malicious',
    CASE WHEN f THEN 'Filtered' ELSE 'Passed' END]) AS kind FROM judged)
SELECT 'RESULTS' AS level, kind, strftime({_STAMP}, '%Y-%m-%d') AS day, count(*) AS lines,
  sum(CASE WHEN kind = 'Prompt' THEN length(text) + 7 ELSE 0 END)::BIGINT AS prompt_chars
FROM lines JOIN (SELECT doc_id, text FROM documents) USING (doc_id) GROUP BY ALL"""

# --- knowledge base ------------------------------------------------------------------------


def chunked(text: str, sep: str, first: int | None) -> str:
    cut = f"[1:{first}]" if first else ""
    return f"list_filter(string_split({text}, {sep}), lambda c: length(c) > 50){cut}"


def unnested(columns: str, chunks: str, source: str) -> str:
    return f"""SELECT {columns}, unnest(range(0, len(cs))) AS chunk_no, unnest(cs) AS chunk
  FROM (SELECT *, {chunks} AS cs FROM {source})"""


ORACLES["kb_chunks"] = f"""
SELECT doc_id, chunk_no, md5(chunk) AS chunk_id, length(chunk)::BIGINT AS chars
FROM ({unnested("doc_id", chunked("text", "chr(10)", None), "documents")})"""
ORACLES["kb_first_chunks"] = f"""
SELECT doc_id, chunk_no, md5(chunk) AS chunk_id
FROM ({unnested("doc_id", chunked("text", "chr(10)", 3), "documents")})"""


def doc_batch(batch_no: int, which: str = "true") -> str:
    return f"""SELECT md5(chunk) AS chunk_id, 'doc://' || doc_id AS url, lang AS topic, chunk_no,
  {batch_no}::BIGINT AS batch_no
FROM ({unnested("doc_id, lang", chunked("text", "chr(10)", None), "documents")}) WHERE {which}"""


_LATEST = """SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY chunk_id
    ORDER BY batch_no DESC, url NULLS FIRST, topic NULLS FIRST, chunk_no) AS rn FROM {0}) WHERE rn = 1"""
_KB = f"""both_batches AS ({doc_batch(0)} UNION ALL {doc_batch(1, "lang = 'en'")}),
kb AS ({_LATEST.format("both_batches")})"""
ORACLES["kb_upsert"] = f"WITH {_KB} SELECT * FROM kb"
ORACLES["kb_browse"] = f"WITH {_KB} SELECT * FROM kb ORDER BY chunk_id LIMIT 100"
ORACLES["kb_dedupe"] = f"""WITH stored AS ({doc_batch(0, "lang = 'en'")}), fresh AS ({doc_batch(1)}),
one AS ({_LATEST.format("fresh")})
SELECT * FROM one WHERE chunk_id NOT IN (SELECT chunk_id FROM stored)"""
ORACLES["stream_kb_upsert"] = f"""WITH fresh AS ({doc_batch(0)})
SELECT chunk_id, url, topic, chunk_no FROM ({_LATEST.format("fresh")})"""

ORACLES["chunk_store_upsert"] = f"WITH {_KB} SELECT *, chunk_id AS text_md5 FROM kb"
_ARRIVED = " UNION ALL ".join(doc_batch(i, f"doc_id % 4 = {i}") for i in range(4))
ORACLES["stream_chunk_store"] = f"""WITH arrived AS ({_ARRIVED}),
kb AS ({_LATEST.format("arrived")}) SELECT *, chunk_id AS text_md5 FROM kb"""


def unescape(expr: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        expr = f"replace({expr}, {q(entity)}, {q(char)})"
    return expr


_dropped = q(r"(?is)<(?:script|style|nav|head)\b.*?</(?:script|style|nav|head)>|<!--.*?-->")
_breaks = q(r"(?i)</(?:p|div|h[1-6]|li|article|section)>|<br\s*/?>")
_content = f"regexp_replace(html, {_dropped}, '', 'g')"
_content = f"regexp_replace({_content}, {_breaks}, chr(10) || chr(10), 'g')"
_content = f"regexp_replace({_content}, '(?s)<[^>]*>', '', 'g')"
_title = "regexp_extract(html, '(?is)<title>(.*?)</title>', 1)"
PAGES = f"""parsed AS (SELECT page_id, url, {strip(unescape(_title))} AS title,
  {strip(unescape(_content))} AS content FROM pages)"""


def norm(expr: str) -> str:
    collapsed = f"regexp_replace({expr}, '\\s+', ' ', 'g')"
    return f"lower({strip(collapsed)})"


_TOPICS = "all_topics AS (SELECT unnest([title, lower(title), reverse(title)]) AS topic FROM parsed)"
_RESOLVED = f"""resolved AS (
  SELECT topic, coalesce(
    (SELECT min(page_id) FROM parsed p WHERE p.title = t.topic AND length(p.title) > 0),
    (SELECT min(page_id) FROM parsed p WHERE {norm("p.title")} = {norm("t.topic")}
     AND length(p.title) > 0)) AS page_id
  FROM (SELECT DISTINCT topic FROM all_topics) t)"""
_SEP2 = "chr(10) || chr(10)"

ORACLES["page_chunks"] = f"""WITH {PAGES}
SELECT page_id, title, chunk_no, md5(chunk) AS chunk_id
FROM ({unnested("page_id, title", chunked("content", _SEP2, None), "parsed")})"""
ORACLES["topic_resolve"] = f"WITH {PAGES}, {_TOPICS}, {_RESOLVED} SELECT topic, page_id FROM resolved"
ORACLES["topic_unresolved"] = f"""WITH {PAGES}, {_TOPICS}
SELECT DISTINCT topic FROM all_topics
WHERE {norm("topic")} NOT IN (SELECT {norm("title")} FROM parsed)"""
ORACLES["topic_valid"] = f"""WITH {PAGES}, {_TOPICS}
SELECT topic, count(*) AS requests FROM (SELECT {strip("replace(topic, '`', '')")} AS topic
  FROM all_topics) WHERE length(topic) BETWEEN 1 AND 50 GROUP BY 1"""
ORACLES["topic_ingest"] = f"""WITH {PAGES}, {_TOPICS}, {_RESOLVED},
hit AS (SELECT topic, url, content FROM resolved JOIN parsed USING (page_id))
SELECT topic, url, chunk_no, md5(chunk) AS chunk_id
FROM ({unnested("topic, url", chunked("content", _SEP2, None), "hit")})"""

# --- retrieval -----------------------------------------------------------------------------

_VECTORS = """vectors AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
mixed AS (
  SELECT a.vec_id AS query_id, CASE WHEN b.v IS NULL THEN a.v ELSE
    list_transform(list_zip(a.v, b.v),
      lambda p: p[1] + ((a.vec_id % 9) / CAST(4.0 AS DOUBLE)) * p[2]) END AS e
  FROM vectors a LEFT JOIN vectors b ON b.vec_id = a.vec_id + 1
),
store AS (SELECT vec_id AS chunk_id, v AS e FROM vectors)"""
_HITS = f"{_VECTORS}, {top_k('hits', 'mixed', 'store', 3)}"


def points(distance: str) -> str:
    return (
        f"CASE WHEN {distance} < 0.2::DOUBLE THEN 8 WHEN {distance} < 0.45::DOUBLE THEN 5 "
        f"WHEN {distance} < 0.6::DOUBLE THEN 1 ELSE 0 END"
    )


def band(distance: str) -> str:
    return (
        f"CASE WHEN {distance} < 0.2::DOUBLE THEN 'STRONG' WHEN {distance} < 0.45::DOUBLE THEN 'GOOD' "
        f"WHEN {distance} < 0.6::DOUBLE THEN 'WEAK' ELSE 'IRRELEVANT' END"
    )


ORACLES["kb_topk"] = f"""WITH {_HITS}
SELECT query_id, rank, chunk_id, {r6("distance")} AS distance FROM hits"""
ORACLES["kb_topk_blocks"] = ORACLES["kb_topk"]
ORACLES["kb_ratings"] = f"""WITH {_HITS}
SELECT {band("distance")} AS band, CAST({points("distance")} AS BIGINT) AS points, count(*) AS hits
FROM hits GROUP BY ALL"""
_TOTALS = f"""totals AS (
  SELECT query_id, count(chunk_id) AS hits, CAST(coalesce(sum(CASE WHEN chunk_id IS NULL THEN 0
    ELSE {points("distance")} END), 0) AS BIGINT) AS total
  FROM mixed LEFT JOIN hits USING (query_id) GROUP BY 1)"""
ORACLES["kb_relevance"] = f"""WITH {_HITS}, {_TOTALS}
SELECT query_id, hits, total, total >= 8 AS strong FROM totals"""
ORACLES["reingest_candidates"] = f"""WITH {_HITS}, {_TOTALS}
SELECT query_id, hits, total FROM totals WHERE total < 8"""
ORACLES["retrieve_fallback"] = f"""WITH {_VECTORS},
{top_k("hits", "mixed", "store", 3, "AND distance <= 0.2")}
SELECT query_id, coalesce(rank, 1)::BIGINT AS rank,
  CASE WHEN chunk_id IS NOT NULL THEN 'vec://' || chunk_id END AS url,
  CASE WHEN chunk_id IS NOT NULL THEN CAST(label AS VARCHAR) ELSE 'query ' || query_id END AS topic,
  md5(CASE WHEN chunk_id IS NOT NULL THEN 'vector ' || chunk_id
      ELSE 'Nothing in the chunk store is close to this query; answer without added context.' END) AS snippet_md5,
  {r6("distance")} AS distance
FROM mixed LEFT JOIN hits USING (query_id) LEFT JOIN vectors ON vec_id = chunk_id"""

_PASSAGES = embedded(
    "passages", f"SELECT item_id AS chunk_id, text, {slots('text')} AS slots FROM benchmark"
)
_USERS = embedded(
    "users",
    f"SELECT conv_id || '-' || turn AS query_id, text, {slots('text')} AS slots "
    "FROM conversations WHERE role = 'user'",
)
_ENRICHED = f"""{_PASSAGES}, {_USERS}, {top_k("best", "users", "passages", 1)},
enriched AS (
  SELECT query_id, u.text, distance, p.text AS context,
    'Use the following as context for the prompt: "' || p.text || '"' || chr(10) || u.text AS prompt
  FROM users u JOIN best USING (query_id) JOIN passages p USING (chunk_id))"""
ORACLES["prompt_with_context"] = f"""WITH {_ENRICHED}
SELECT query_id, {r6("distance")} AS distance, {band("distance")} AS band,
  md5(context) AS context_md5, md5(prompt) AS prompt_md5 FROM enriched"""

_main = "regexp_replace({0}, '\\s*[(,:.].*$', '', 's')".format
_cells = embedded(
    "cells",
    f"SELECT page_id, md5(chunk) AS chunk_id, chunk, {slots('chunk')} AS slots "
    f"FROM ({unnested('page_id', chunked('content', _SEP2, None), 'parsed')})",
)
_asked = embedded(
    "asked", f"SELECT topic, page_id, options, {slots('topic')} AS slots FROM wanted"
)
ORACLES["enrich_by_topic"] = f"""WITH {PAGES},
options AS (
  SELECT {norm("title")} AS alias, 0 AS kind, title, page_id FROM parsed WHERE length(title) > 0
  UNION ALL
  SELECT {norm(_main("title"))}, 1, title, page_id FROM parsed WHERE length(title) > 0),
aliases AS (
  SELECT alias, count(DISTINCT title) AS options,
    first(page_id ORDER BY kind, encode(title), page_id) AS page_id
  FROM options WHERE alias <> '' GROUP BY alias),
said AS (
  SELECT conv_id || '-' || turn AS query_id, c.text, CASE (conv_id * 7 + turn) % 3
    WHEN 0 THEN '```' || title || '```' || chr(10) WHEN 1 THEN lower(title) ELSE {_main("title")} END AS reply
  FROM conversations c LEFT JOIN parsed p
    ON p.page_id = (conv_id * 7 + turn) % (SELECT count(*) FROM pages)
  WHERE role = 'user'),
named AS (
  SELECT query_id, text, CASE WHEN length(t) BETWEEN 1 AND 50 THEN t END AS topic
  FROM (SELECT *, {strip("replace(reply, '`', '')")} AS t FROM said)),
wanted AS (
  SELECT topic, page_id, options FROM (SELECT DISTINCT topic FROM named) n JOIN aliases ON alias = {norm("topic")}),
{_cells}, {_asked},
scored AS (
  SELECT topic, a.page_id, options, chunk, chunk_id,
    1 - CASE WHEN list_sum(a.e) = 0 OR list_sum(b.e) = 0 THEN 0 ELSE list_cosine_similarity(a.e, b.e) END AS distance
  FROM asked a JOIN cells b USING (page_id)),
best AS (
  SELECT * FROM scored WHERE true
  QUALIFY row_number() OVER (PARTITION BY topic ORDER BY floor(distance * 1000000 + 0.5), chunk_id) = 1)
SELECT query_id, topic, page_id, options, {r6("distance")} AS distance,
  md5(CASE WHEN chunk IS NULL OR lower(text) = 'filtered.' THEN text
    ELSE 'Use the following as context for the prompt: "' || chunk || '"' || chr(10) || text END) AS prompt_md5
FROM named LEFT JOIN best USING (topic)"""

_TITLES = embedded(
    "titles",
    f"SELECT md5(title) AS query_id, title, {slots('title')} AS slots "
    "FROM (SELECT DISTINCT title FROM parsed)",
)
_FIRST_STORE = embedded(
    "first_store",
    f"SELECT md5(text) AS chunk_id, {slots('text')} AS slots FROM (SELECT DISTINCT text FROM benchmark)",
)
_ADDED = embedded(
    "added", f"SELECT DISTINCT md5(chunk) AS chunk_id, {slots('chunk')} AS slots FROM weak_chunks"
)
ORACLES["retrieve_reingest"] = f"""WITH {PAGES}, {_TITLES}, {_FIRST_STORE},
{top_k("first_hits", "titles", "first_store", 3)},
weak AS (
  SELECT query_id, title, e FROM titles WHERE query_id NOT IN (
    SELECT query_id FROM first_hits GROUP BY 1 HAVING sum({points("distance")}) >= 8)),
weak_pages AS (
  SELECT content FROM parsed WHERE length(title) > 0 AND page_id IN (
    SELECT min(page_id) FROM parsed JOIN weak USING (title) GROUP BY title)),
weak_chunks AS ({unnested("1 AS one", chunked("content", _SEP2, None), "weak_pages")}),
{_ADDED},
second_store AS (SELECT chunk_id, e FROM first_store
  UNION ALL SELECT chunk_id, e FROM added WHERE chunk_id NOT IN (SELECT chunk_id FROM first_store)),
{top_k("second_hits", "weak", "second_store", 3)}
SELECT query_id, rank, chunk_id, {r6("distance")} AS distance FROM (
  SELECT * FROM first_hits WHERE query_id NOT IN (SELECT query_id FROM weak)
  UNION ALL SELECT * FROM second_hits)"""

# --- grounding -----------------------------------------------------------------------------

ORACLES["pair_similarity"] = f"""WITH pairs AS (
  SELECT row_number() OVER () AS pid, conv_id, turn, text AS a, prev AS b FROM (
    SELECT *, lag(text) OVER o AS prev, lag(turn) OVER o AS before
    FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)
    WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text))
  WHERE role = 'assistant' AND before IS NOT NULL),
{word_cosine("scored", "pairs", "pid")}
SELECT conv_id, turn, {r6("score")} AS similarity FROM scored"""



def sparse_scores(left: str, right: str, low: float) -> str:
    """CTE ``scored(l, r, score)`` of two queries of (id, text): all pairs that share a word."""
    return f"""l_words AS (
  SELECT id, w, count(*) AS n FROM (SELECT id, unnest({tokens("text")}) AS w FROM ({left})) GROUP BY ALL),
r_words AS (
  SELECT id, w, count(*) AS n FROM (SELECT id, unnest({tokens("text")}) AS w FROM ({right})) GROUP BY ALL),
l_size AS (SELECT id, sqrt(CAST(sum(n * n) AS DOUBLE)) AS s FROM l_words GROUP BY 1),
r_size AS (SELECT id, sqrt(CAST(sum(n * n) AS DOUBLE)) AS s FROM r_words GROUP BY 1),
products AS (
  SELECT x.id AS l, y.id AS r, CAST(sum(x.n * y.n) AS DOUBLE) AS s FROM l_words x JOIN r_words y USING (w) GROUP BY ALL),
scored AS (
  SELECT * FROM (SELECT l, r, p.s / (a.s * b.s) AS score FROM products p
    JOIN l_size a ON a.id = l JOIN r_size b ON b.id = r) WHERE round(score, 6) >= {low}::DOUBLE)"""


ORACLES["sparse_topk"] = f"""WITH {sparse_scores(
    "SELECT conv_id || '-' || turn AS id, text FROM conversations WHERE role = 'assistant'",
    "SELECT item_id AS id, text FROM benchmark", registry.SPARSE_SCORE)},
ranked AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY round(score, 6) DESC, r) AS rank FROM scored)
SELECT l AS response_id, rank, r AS chunk_id, {r6("score")} AS score FROM ranked WHERE rank <= 3"""

ORACLES["sparse_pairs"] = f"""WITH {sparse_scores(
    "SELECT doc_id AS id, text FROM documents",
    "SELECT doc_id AS id, text FROM documents JOIN labels USING (doc_id) WHERE quality = 1", 0.9)}
SELECT l AS doc_id, count(*) AS close, {r6("max(score)")} AS closest FROM scored WHERE l <> r GROUP BY 1"""

ORACLES["dense_similarity"] = f"""WITH {_VECTORS}
SELECT query_id, {r6("list_cosine_similarity(e, v)")} AS similarity
FROM mixed JOIN vectors ON vec_id = query_id"""

_ANSWERS = embedded(
    "answers",
    f"SELECT conv_id || '-' || turn AS query_id, text, {slots('text')} AS slots "
    "FROM conversations WHERE role = 'assistant'",
)


def contexts(k: int) -> str:
    return f"""{_PASSAGES}, {_ANSWERS}, {top_k("best", "answers", "passages", k)},
pairs AS (
  SELECT a.query_id || '/' || rank AS pid, a.query_id AS response_id, rank - 1 AS pos,
    a.text AS a, p.text AS b, {clip("p.text")} AS shown
  FROM answers a JOIN best USING (query_id) JOIN passages p USING (chunk_id)),
{word_cosine("scored", "pairs", "pid")}"""


ORACLES["context_scores"] = f"""WITH {contexts(3)}
SELECT response_id, pos, md5(shown) AS shown_md5, {r6("score")} AS score FROM scored"""


def dense_contexts(k: int) -> str:
    return f"""{_PASSAGES}, {_ANSWERS}, {top_k("best", "answers", "passages", k)},
scored AS (
  SELECT a.query_id AS response_id, rank - 1 AS pos, {clip("p.text")} AS shown,
    coalesce(CASE WHEN list_sum(a.e) > 0 AND list_sum(p.e) > 0
      THEN list_cosine_similarity(a.e, p.e) END, 0) AS score
  FROM answers a JOIN best USING (query_id) JOIN passages p USING (chunk_id))"""


def assessed(overall: str, pairs: str | None = None) -> str:
    ladder = """WHEN overall >= 0.7::DOUBLE THEN 'Response is highly consistent with the provided context.'
    WHEN overall >= 0.5::DOUBLE THEN 'Response shows moderate consistency with context.'
    WHEN overall >= 0.3::DOUBLE THEN 'Response shows weak consistency. Potential partial hallucination.'
    ELSE 'Response appears to be hallucinated or unrelated to context.'"""
    return f"""WITH {pairs or contexts(3)},
per AS (
  SELECT response_id, count(*) AS contexts, {overall} AS overall,
    first(shown ORDER BY round(score, 6) DESC, pos) AS best FROM scored GROUP BY 1)
SELECT response_id, contexts, {r6("overall")} AS overall_score, md5(best) AS best_md5,
  overall < 0.4::DOUBLE AS is_hallucination,
  CASE {ladder} END AS assessment FROM per"""


ORACLES["assess_response_max"] = assessed("max(score)")
ORACLES["assess_response_dense"] = assessed("max(score)", dense_contexts(3))
ORACLES["assess_response_avg"] = assessed("avg(score)")
ORACLES["assess_response_weighted"] = assessed(
    "sum(score * length(b)) / sum(length(b))"
)


def claim_list(text: str) -> str:
    return (
        f"list_filter(list_transform(regexp_split_to_array({text}, '[.!?]+'), "
        f"lambda c: {strip('c')}), lambda c: length(c) > 10)"
    )


ORACLES["claims"] = f"""
SELECT doc_id, unnest(range(0, len(cs))) AS claim_no,
  unnest(list_transform(cs, lambda c: md5(c))) AS claim_md5
FROM (SELECT doc_id, {claim_list("text")} AS cs FROM documents)"""

_CLAIMS = f"""{contexts(3)},
claim_rows AS (
  SELECT response_id, pos, b, unnest(range(0, len(cs))) AS claim_no, unnest(cs) AS claim
  FROM (SELECT response_id, pos, b, {claim_list("a")} AS cs FROM pairs)),
claim_pairs AS (
  SELECT response_id || '/' || pos || '/' || claim_no AS cid, response_id, claim_no, claim,
    claim AS a, b FROM claim_rows),
{word_cosine("claim_scored", "claim_pairs", "cid")},
claim_best AS (
  SELECT response_id, claim_no, claim, max(score) AS score FROM claim_scored GROUP BY ALL)"""
ORACLES["claim_scores"] = f"""WITH {_CLAIMS}
SELECT response_id, claim_no, md5(claim) AS claim_md5, {r6("score")} AS score FROM claim_best"""
ORACLES["claim_flags"] = f"""WITH {_CLAIMS}
SELECT response_id, claim_no, {r6("score")} AS score, score < 0.4::DOUBLE AS is_hallucination FROM claim_best"""
ORACLES["assess_claims"] = f"""WITH {_CLAIMS}
SELECT query_id AS response_id, count(claim_no) AS total_claims,
  count_if(score < 0.4::DOUBLE)::BIGINT AS hallucinated_claims,
  {r6("coalesce(avg(score), 0.0)")} AS avg_claim_score
FROM answers LEFT JOIN claim_best ON response_id = query_id GROUP BY 1"""

for _name, _sign in (("output_gate", "<"), ("output_gate_compat", ">")):
    ORACLES[_name] = f"""WITH {contexts(1)}
SELECT response_id, CASE WHEN score {_sign} 0.4 THEN 'filter' ELSE 'pass' END AS action,
  CASE WHEN score {_sign} 0.4 THEN 'Hallucination' END AS gate,
  CASE WHEN score {_sign} 0.4 THEN 'Filtered due to Hallucination, ' || printf('%.6f', score)
    || ' {_sign} ' || printf('%.6f', 0.4::DOUBLE) END AS reason
FROM scored"""

# --- conversations -------------------------------------------------------------------------

_HISTORY = f"""history AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL
  SELECT conv_id, first_turn - 1, 'system', 'You are a helpful assistant.' FROM (
    SELECT conv_id, min(turn) AS first_turn, first(role ORDER BY turn) AS first_role
    FROM conversations GROUP BY 1) WHERE first_role <> 'system')"""
ORACLES["chat_history"] = f"""WITH {_HISTORY}
SELECT conv_id, turn, role, md5(text) AS text_md5 FROM history"""
_SEGMENTS = f"""WITH {_HISTORY}
SELECT conv_id, greatest(turn, 0) // 4 AS segment, count(*) AS n_messages,
  md5(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS messages_md5
FROM history GROUP BY 1, 2"""
ORACLES["chat_segments"] = _SEGMENTS
ORACLES["stream_history"] = _SEGMENTS

_F = "```"
ORACLES["fenced_block"] = f"""WITH f AS (
  SELECT conv_id, turn, CASE turn % 5
    WHEN 0 THEN 'intro' || chr(10) || '{_F}txt' || chr(10) || text || chr(10) || '{_F}' || chr(10)
      || 'rest'
    WHEN 1 THEN '{_F}' || chr(10) || text
    WHEN 2 THEN text || chr(10) || '{_F}' || chr(10) || '{_F}'
    WHEN 3 THEN 'inline {_F}' || text || '{_F}'
    ELSE text END AS t FROM conversations),
l AS (SELECT conv_id, turn, string_split(t, chr(10)) AS ls FROM f),
marks AS (
  SELECT conv_id, turn, ls,
    list_filter(range(1, len(ls) + 1), lambda i: starts_with(ls[i], '{_F}')) AS fences FROM l)
SELECT conv_id, turn, CASE WHEN len(fences) > 0 THEN md5(coalesce(array_to_string(
    ls[fences[1] + 1 : CASE WHEN len(fences) > 1 THEN fences[2] - 1 ELSE len(ls) END], chr(10)), '')) END
  AS block_md5
FROM marks"""

# --- streams -------------------------------------------------------------------------------

ORACLES["stream_screen"] = decisions(DOCS, "docs", "doc_id", STRICT)
_RATE = f"""SELECT date_trunc('hour', ts) AS window_start, count(*) AS decisions,
  count_if(event_type = 'error')::BIGINT AS filtered,
  {r6("count_if(event_type = 'error') / count(*)")} AS rate FROM events GROUP BY 1"""
ORACLES["audit_rates"] = _RATE
ORACLES["stream_audit_rates"] = _RATE

# --- models --------------------------------------------------------------------------------

_LENGTH = (
    f"CASE WHEN {rule_count(_DEFAULT)} > {DEFAULT.banned_word_tolerance} THEN 0.0 "
    "ELSE least(1.0, length(text) / CAST(20000.0 AS DOUBLE)) END"
)
ORACLES["scorer_plugin"] = decisions(
    DOCS, "docs", "doc_id", ScreeningPolicy(threshold_toxicity=0.4), _LENGTH
)
ORACLES["embedder_plugin"] = """
SELECT doc_id, CAST(length(regexp_replace(lower(text), '[^a-z]', '', 'g')) AS DOUBLE) AS letters,
  CAST(length(regexp_replace(lower(text), '[^e]', '', 'g')) AS DOUBLE) AS letter_e
FROM documents"""
_ips = [r for r in catalog.RECOGNISERS if r.label == "ip_address"]
ORACLES["recogniser_plugin"] = f"""WITH {DOCS}, {spans("docs", "doc_id", _ips)},
{pii_counts("doc_id")}, {redaction("doc_id", "docs")}
SELECT doc_id, coalesce(n, 0)::BIGINT AS pii_count, md5(redacted_text) AS redacted_md5
FROM redacted LEFT JOIN pii USING (doc_id)"""
ORACLES["generate_plugin"] = f"""WITH {_ENRICHED},
prompts AS (SELECT query_id, text, {mask("text")} AS m FROM users),
{decision_cte("prompts", "query_id", DEFAULT)},
pairs AS (
  SELECT e.query_id AS pid, prompt || ' done' AS a, context AS b
  FROM enriched e JOIN decisions d USING (query_id) WHERE d.action <> 'filter'),
{word_cosine("likeness", "pairs", "pid")}
SELECT d.query_id, d.action AS input_action, md5(s.a) AS answer_md5,
  {r6("s.score")} AS similarity,
  CASE WHEN s.pid IS NULL THEN NULL WHEN s.score < 0.5 THEN 'filter' ELSE 'pass' END
    AS output_action
FROM decisions d LEFT JOIN likeness s ON s.pid = d.query_id"""
ORACLES["text_features"] = f"""WITH {embedded("v", f"SELECT doc_id, {slots('text')} AS slots FROM documents")},
seen AS (
  SELECT d, ln((count(*) + 1) / (count_if(x > 0) + 1)) AS w
  FROM (SELECT unnest(e) AS x, unnest(range(0, 64)) AS d FROM v) GROUP BY d),
idf AS (SELECT list(w ORDER BY d) AS w FROM seen),
t AS (SELECT doc_id, list_transform(range(1, 65), lambda i: e[i] * w[i]) AS t FROM v, idf),
u AS (SELECT doc_id, t, sqrt(list_sum(list_transform(t, lambda x: x * x))) AS size FROM t),
n AS (SELECT doc_id, CASE WHEN size > 0 THEN list_transform(t, lambda x: x / size) ELSE t END AS t FROM u)
SELECT doc_id, {r6("list_max(t)")} AS largest, {r6("list_sum(t)")} AS total, {r6("t[8]")} AS slot_7 FROM n"""
ORACLES["word_features"] = f"""WITH c AS (
  SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({tokens("text")}) AS word FROM documents) GROUP BY ALL),
v AS (
  SELECT word, row_number() OVER (ORDER BY md5('0:' || word), word) AS word_id,
    ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) AS idf FROM c GROUP BY word),
w AS (SELECT doc_id, word_id, word, n * idf AS w FROM c JOIN v USING (word)),
u AS (
  SELECT doc_id, word_id, word, CASE WHEN s > 0 THEN w / s ELSE w END AS w
  FROM w JOIN (SELECT doc_id, sqrt(sum(w * w)) AS s FROM w GROUP BY 1) USING (doc_id)),
t AS (
  SELECT doc_id, count(*) AS n_terms,
    array_to_string(list(word ORDER BY round(w, 6) DESC, encode(word))[1:5], ' ') AS top_terms,
    md5(string_agg(word_id || ':' || CAST(floor(w * 1000000 + 0.5) AS BIGINT), ',' ORDER BY word_id)) AS vector_md5
  FROM u GROUP BY 1)
SELECT doc_id, coalesce(n_terms, 0) AS n_terms, coalesce(top_terms, '') AS top_terms,
  coalesce(vector_md5, md5('')) AS vector_md5 FROM documents LEFT JOIN t USING (doc_id)"""
