"""SQL with the results of the queries on words, runs and secrets, for a second engine."""

from __future__ import annotations

from . import secret_scan

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, bit by bit."""
    return f"""xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(strlen({text})),
        lambda k: CAST('0x' || substr(hex(encode({text})), 2 * k + 1, 2) AS BIGINT))),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""


# words are found by wild-cards and deletions, which is no method of the operator
OP11 = rf"""
WITH RECURSIVE o AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
         unnest(regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[A-Za-zÀ-ÿ]{{7,}}')) AS run
  FROM documents
), r AS (SELECT id || ':' || run AS name, run, count(*) AS n FROM o GROUP BY id, run
), h AS (SELECT run, n, {_crc32("name")} AS h FROM r
), c AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END
           AS word, n
  FROM h
), w AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM c WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), p AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w
), star AS (
  SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS k FROM p
), cut AS (
  SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS k FROM p
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM star a JOIN star b USING (k) WHERE a.word <> b.word
  UNION ALL SELECT cut.word, cut.n, w.word, w.n FROM cut JOIN w ON cut.k = w.word
  UNION ALL SELECT w.word, w.n, cut.word, cut.n FROM cut JOIN w ON cut.k = w.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-m, encode(other))) AS other, max(m) AS m FROM near GROUP BY word
), f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * w.n THEN other END AS form,
         CASE WHEN m >= 10 * w.n THEN m END AS form_n
  FROM w LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS place, 0 AS step FROM f
  UNION ALL SELECT walk.word, f.form, step + 1 FROM walk JOIN f ON walk.place = f.word WHERE f.form IS NOT NULL
), ends AS (SELECT word, arg_max(place, step) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN ends USING (word)
"""

# a run of at least max(24, 3 q) words repeats 16 words at distance q, place after place
OP12 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, CAST(doc_id AS VARCHAR) AS name,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), h AS (
  SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n, {_crc32("name")} AS h FROM d
), g AS (
  SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a, (h // 10) % 8 + 3 AS v FROM h
), u AS (
  SELECT rid, unnest(range(len(w))) AS i, unnest(w) AS word FROM d
), t AS (
  SELECT u.rid, u.i, n, CASE WHEN u.i >= a THEN a + (u.i - a) % (1 + (n - a) // v) ELSE u.i END AS j
  FROM u JOIN g USING (rid)
), x AS (
  SELECT t.rid, t.i, n, u.word FROM t JOIN u ON u.rid = t.rid AND u.i = t.j
), ids AS (
  SELECT rid, i, n, word, dense_rank() OVER (ORDER BY word) AS v FROM x
), grams AS (
  SELECT rid, i, n, list(v) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS g FROM ids
), many AS (
  SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS c FROM grams WHERE len(g) = 16) WHERE c > 1
), pairs AS (
  SELECT a.rid, a.i, b.i - a.i AS q FROM many a JOIN many b ON a.rid = b.rid AND a.g = b.g AND b.i > a.i
  WHERE 3 * (b.i - a.i) <= a.n
), isles AS (
  SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS isle FROM pairs
), stretches AS (
  SELECT rid, min(i) AS s, count(*) + 15 + q AS l, q FROM isles GROUP BY rid, q, isle
), long AS (
  SELECT * FROM stretches WHERE l >= greatest(24, 3 * q)
), runs AS (
  SELECT * FROM long a WHERE NOT EXISTS (
    SELECT 1 FROM long b WHERE b.rid = a.rid AND b.s <= a.s AND b.s + b.l >= a.s + a.l AND b.q < a.q)
), each_text AS (
  SELECT rid, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS listed
  FROM runs GROUP BY rid
), best AS (
  SELECT * FROM runs a WHERE NOT EXISTS (
    SELECT 1 FROM runs b WHERE b.rid = a.rid AND (b.l * a.q > a.l * b.q
      OR (b.l * a.q = a.l * b.q AND (b.s < a.s OR (b.s = a.s AND b.q < a.q)))))
), gone AS (
  SELECT DISTINCT rid, unnest(range(s + q, s + l)) AS i FROM runs
), left_over AS (
  SELECT x.rid, string_agg(word, ' ' ORDER BY x.i) AS kept FROM x ANTI JOIN gone ON x.rid = gone.rid AND x.i = gone.i
  GROUP BY x.rid
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(s AS BIGINT) AS start, CAST(l AS BIGINT) AS length,
       CAST(q AS BIGINT) AS period, CAST(1000 * l // q AS BIGINT) AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM g LEFT JOIN each_text USING (rid) LEFT JOIN best USING (rid) LEFT JOIN left_over USING (rid)
"""


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_ASSIGN = (
    "(" + "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
    r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
)


def _places(kind: str, pattern: str, enough: str, rows: str = "d") -> str:
    """Matches of a pattern and their places, from the texts between them."""
    return f"""
  SELECT rid, '{kind}' AS kind, start AS s, start + length(m) AS e, m FROM (
    SELECT rid, found[i] AS m, CAST(list_sum(list_transform(between[1:i], lambda x: length(x)))
             + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
    FROM (SELECT rid, found, between, unnest(range(1, len(found) + 1)) AS i FROM (
      SELECT rid, regexp_extract_all(t, '{pattern}') AS found, string_split_regex(t, '{pattern}') AS between
      FROM {rows}))
  ) WHERE {enough}"""


def _class(c: secret_scan.CharacterClass) -> str:
    letters = {"0123456789": "0-9", "abcdefABCDEF": "a-fA-F"}
    needs = " AND ".join(
        f"max(CAST(regexp_matches(x, '[{letters.get(k, f'{k[0]}-{k[-1]}')}]') AS INT)) = 1" for k in c.needs
    )
    of = c.characters.replace("-", "") + "-"
    return f"""
  SELECT rid, kind, s, p, s + p AS a FROM (
    SELECT rid, kind, s, p, x, count(*) AS n
    FROM (SELECT *, unnest(string_split(substr(m, p + 1, {c.window}), '')) AS x
          FROM (SELECT *, unnest(range(length(m) - {c.window - 1})) AS p FROM ({_places(c.kind, f"[{of}]{{{c.window},}}", "true")})))
    GROUP BY rid, kind, s, p, x
  ) GROUP BY rid, kind, s, p
  HAVING sum(CAST(round(n * log2(n) * {secret_scan.UNIT}) AS BIGINT)) <= {secret_scan.most_weight(c)} AND {needs}"""


_KINDS = ", ".join(f"'{k}'" for k in secret_scan.KINDS)
_WINDOWS = " UNION ALL ".join(_class(c) for c in secret_scan.CLASSES)
_WIDTH = "CASE kind " + " ".join(f"WHEN '{c.kind}' THEN {c.window}" for c in secret_scan.CLASSES) + " END"

OP13 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), base AS (
  {_places("assign", _ASSIGN, f"length(regexp_extract(m, '{_ASSIGN}', 2)) >= 8")}
  UNION ALL {_places("access", "AKIA[A-Z0-9]+", "length(m) >= 16")}
  UNION ALL {_places("hex", "[0-9a-f]+", "length(m) >= 32", "(SELECT * FROM d WHERE regexp_matches(t, '[0-9a-f]{32}'))")}
), high AS (
  SELECT *, {_WIDTH} AS width FROM ({_WINDOWS})
), marked AS (
  SELECT *, CASE WHEN a - lag(a) OVER o <= width THEN 0 ELSE 1 END AS fresh FROM high
  WINDOW o AS (PARTITION BY rid, kind, s ORDER BY a)
), spans AS (
  SELECT rid, kind, min(a) AS s, max(a) + any_value(width) AS e
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY rid, kind, s ORDER BY a) AS span FROM marked)
  GROUP BY rid, kind, s, span
), worded AS (
  SELECT spans.*, substr(t, s + 1, e - s) AS m, lower(substr(t, greatest(1, s - 15), least(s, 16))) AS before
  FROM spans JOIN d USING (rid)
), letters AS (
  SELECT rid, kind, s, count(*) FILTER (WHERE abs(ord(x) - y) = 1) AS steps
  FROM (SELECT *, lag(ord(x)) OVER (PARTITION BY rid, kind, s ORDER BY i) AS y
        FROM (SELECT rid, kind, s, unnest(string_split(m, '')) AS x, unnest(range(length(m))) AS i FROM worded))
  GROUP BY rid, kind, s
), added AS (
  SELECT w.rid, w.kind, w.s, w.e FROM worded w JOIN letters USING (rid, kind, s)
  WHERE NOT regexp_matches(lower(m), '{"|".join(secret_scan.ALLOWED_PARTS)}')
    AND NOT regexp_matches(m, '[0-9A-Fa-f]{{8}}(-[0-9A-Fa-f]{{4}}){{3}}-[0-9A-Fa-f]{{12}}')
    AND NOT regexp_matches(before, '({"|".join(secret_scan.ALLOWED_LABELS)})[ :="''-]*$')
    AND 2 * steps < length(m) - 1
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = w.rid AND b.s <= w.s AND w.e <= b.e)
), all_spans AS (
  SELECT *, list_position([{_KINDS}], kind) AS k FROM (
    SELECT rid, kind, s, e, true AS known FROM base UNION ALL SELECT rid, kind, s, e, false FROM added)
), listed AS (
  SELECT rid, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
         count(*) FILTER (WHERE kind = 'hex') AS n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) FILTER (WHERE known) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS spans
  FROM all_spans GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (rid)
"""
