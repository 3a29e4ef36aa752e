"""Named queries of the operators and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    lbl,
    line_index,
    mixing,
    periodic_runs,
    quality_rank,
    quality_rules,
    secret_scan,
    simhash,
    spelling,
    style_tree,
    suffix_array,
    tiling,
    token_counts,
)
from ..functions.text import let
from .common import WORD, read
from .sql import OP11, OP12, OP13


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op2_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return style_tree.extract(read(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", "n_chars", "by_tree", "by_prior"
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule ledger and verdict of every document."""
    rows = quality_rules.judge(read(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "failures",
    )


def op4_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality_rank.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before, lines dropped and digest of what is left of every document."""
    rows = line_index.dedup_lines(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    vocabulary = importlib.import_module("public_tokenizers").path("byte_bpe_50k.json")
    rows = token_counts.count_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    return rows.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold."""
    return tiling.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document under the model and under smoothed word counts."""
    return lbl.score(read(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    rows = mixing.mix(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes removed from every document because they repeat, and digest of what is left."""
    rows = suffix_array.dedup(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every word of the documents, with letters dropped by rule."""
    docs = read(spark, sf_dir, "documents")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))

    def drop_letter(word: Column) -> Column:
        h = F.crc32(F.concat(name, F.lit(":"), word).cast("binary"))
        at = (h % F.length(word)).cast("int")
        cut = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
        return F.when(h % 31 == 0, cut).otherwise(word)

    return spelling.variants(spelling.word_counts(docs, change=drop_letter))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, a tenth of them with a stretch repeated by rule."""
    docs = read(spark, sf_dir, "documents")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))

    def repeated(w: Column) -> Column:
        g, n = F.floor(h / 10), F.size(w).cast("bigint")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))

        def build(c: Column) -> Column:
            place = lambda i: F.when(i >= c["a"], c["a"] + (i - c["a"]) % c["p"]).otherwise(i).cast("int")
            return F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, place(i)))

        return F.array_join(let(F.struct(a.alias("a"), p.alias("p")), build), " ")

    # words inside `let` are split once
    text = F.when((h % 10 == 0) & F.col("text").rlike(WORD), let(words, repeated)).otherwise(F.col("text"))
    rows = periodic_runs.with_runs(docs.select("doc_id", text.alias("text")))
    runs = F.col("runs")

    def better(acc: Column, r: Column) -> Column:
        return F.when(
            acc.isNull() | (r["length"] * acc["period"] > acc["length"] * r["period"]), r
        ).otherwise(acc)

    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    best = F.reduce(runs, none, better)
    each = F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size(runs) > 0, F.concat(F.array_join(each, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    return rows.select(
        "doc_id",
        F.size(runs).cast("bigint").alias("n_runs"),
        best.alias("best"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select(
        "doc_id",
        "n_runs",
        "best.start",
        "best.length",
        "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts of the known forms, digest, and all spans."""
    rows = secret_scan.with_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    found = F.col("secrets")
    count = lambda kind: F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("bigint")
    base = secret_scan.listed(found, secret_scan.KINDS[:3])
    return rows.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(base, 256).alias("base_sha256"),
        secret_scan.listed(found).alias("spans"),
    )


QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_style_tree": op2_style_tree,
    "op3_quality_rules": op3_quality_rules,
    "op4_quality_ranking": op4_quality_ranking,
    "op5_line_dedup": op5_line_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_decontamination": op7_decontamination,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_mixing": op9_mixing,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_secret_scan": op13_secret_scan,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP3 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents
), x AS (
  SELECT rid, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM d
), g AS (
  SELECT rid, i, list(word) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS g,
         word = lag(word) OVER (PARTITION BY rid ORDER BY i) AS again
  FROM x
), t AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, g) > 1 AND len(g) = 8 AS twice, again FROM g
), c AS (
  SELECT rid, again, max(CASE WHEN twice THEN i END) OVER (PARTITION BY rid ORDER BY i) AS last_start, i FROM t
), r AS (
  SELECT rid, count(*) FILTER (WHERE i < last_start + 8) AS n_repeat_words, count(*) FILTER (WHERE again) AS n_stutter
  FROM c GROUP BY rid
), l AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
), m AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_stutter, 0) AS n_stutter,
         length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_upper,
         length(regexp_replace(text, '[^!]+', '', 'g')) AS n_marks
  FROM d LEFT JOIN r USING (rid) LEFT JOIN l USING (rid)
), f AS (
  SELECT *, CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 20 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 2 * n_upper > word_chars THEN 64 ELSE 0 END + CASE WHEN 10 * n_marks > 3 * n_words THEN 128 ELSE 0 END
    + CASE WHEN 3 * n_stutter > n_words THEN 256 ELSE 0 END AS failures
  FROM m
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, (failures & 3) <> 0 AS base_failed,
       (failures & (1 + 2 + 4 + 16 + 64 + 128 + 256)) = 0 AS kept, CAST(failures AS BIGINT) AS failures
FROM f
"""

_OP5 = r"""
WITH l AS (
  SELECT doc_id, rid, unnest(lines) AS line, generate_subscripts(lines, 1) AS i
  FROM (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), r AS (
  SELECT k.*, c.last IS NOT NULL AND k.doc_id <> c.last AS gone FROM k LEFT JOIN c USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM r GROUP BY rid, doc_id
"""

ORACLES = {
    "op3_quality_rules": _OP3,
    "op5_line_dedup": _OP5,
    "op11_spelling_variants": OP11,
    "op12_periodic_runs": OP12,
    "op13_secret_scan": OP13,
}
