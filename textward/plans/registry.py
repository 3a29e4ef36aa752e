"""The named queries: each takes a session and a folder of tables and gives a frame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog
from ..config import ScreeningPolicy
from ..functions import text as tx
from ..functions.bands import distance_band
from ..functions.vectors import (
    cosine_similarity,
    hash_embedding,
    max_probability,
    sparse_cosine,
)
from ..operators import chat, evalset, features, gates, grounding, kb, metrics, models, pii, retrieval, rules
from ..operators import scores, sparse, terms
from ..schemas import CONVERSATIONS, DOCUMENTS, EVENTS
from ..session import scratch_dir, stage
from ..sources import chunk_store, logs, sinks, tables
from ..sources.tables import fixture
from ..streaming import screening as streams
from . import flows, inputs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DEFAULT = ScreeningPolicy()
# Low thresholds, so that every threshold gate decides some texts.
STRICT = ScreeningPolicy(
    name="strict",
    banned_word_tolerance=1,
    threshold_toxicity=0.6,
    threshold_pii=1,
    threshold_injection=0.3,
)
# Weights with which the overall gate can decide.
OVERALL = ScreeningPolicy(
    name="overall",
    weight_banned_word=0.9,
    weight_pii=0.5,
    weight_toxicity=0.8,
    weight_overall=0.7,
    reword_factor=0.9,
)
#: Least cosine of words at which a passage counts as close to an answer.
SPARSE_SCORE = 0.2
#: Least number of documents in a file that arrives in a stream.
ARRIVING_ROWS = 10_000
COMPAT = ScreeningPolicy(name="compat", mode="compat", enable_reword=False)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# --- rules ---------------------------------------------------------------------------------


@query
def rule_detections(spark: SparkSession, d: str) -> DataFrame:
    found = rules.detect_rules(inputs.screening_texts(spark, d), catalog.all_rules())
    return rules.detection_rows(found, "text_id").withColumn("hit_no", long("hit_no"))


@query
def language_packs(spark: SparkSession, d: str) -> DataFrame:
    docs = inputs.documents(spark, d)
    n = rules.detection_count("text", catalog.all_rules(), lang=F.col("lang"))
    return docs.select("doc_id", "lang", long(n).alias("detections"))


@query
def prompt_policy(spark: SparkSession, d: str) -> DataFrame:
    done = rules.analyze_prompt(inputs.screening_texts(spark, d), catalog.default_rules())

    def count(action: str) -> Column:
        return long(F.size(F.filter("actions", lambda a: a == action)))

    return done.select(
        "text_id",
        long(F.size("detections")).alias("detections"),
        count("warn").alias("warnings"),
        count("block").alias("blocks"),
        F.array_join("actions", ",").alias("actions"),
        "is_safe",
    )


@query
def detections_by_rule(spark: SparkSession, d: str) -> DataFrame:
    return rules.detections_by_rule(
        inputs.documents(spark, d), catalog.all_rules(), by=["lang"]
    )


@query
def term_detections(spark: SparkSession, d: str) -> DataFrame:
    """Hits of a large catalogue: the longer words of all texts, and word pairs of the passages."""
    cut = lambda c: F.array_distinct(F.transform(terms.pieces(c), F.lower))
    words = inputs.documents(spark, d).select(F.explode(cut("text")).alias("term"))
    words = words.where("length(term) >= 8 AND term RLIKE '(?U)^\\\\w+$'").distinct()
    said = fixture(spark, d, "benchmark").select(terms.pieces(F.lower("text")).alias("p"))
    triples = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("p") - 2, F.lit(1))), lambda i: F.slice("p", i, 3)
    )
    pairs = said.select(F.explode(triples).alias("t")).where("t[1] = ' ' AND t[0] <> t[2]")
    pairs = pairs.select(F.array_join("t", "").alias("term")).distinct()
    both = words.select("term", F.lit("word").alias("rule")).unionAll(
        pairs.select("term", F.lit("pair").alias("rule"))
    )
    catalogue = both.select(
        F.xxhash64("rule", "term").alias("position"), F.lit("any").alias("language"), "rule", "term"
    )
    found = terms.detect_terms(inputs.documents(spark, d), stage(catalogue, "terms"))
    of = lambda rule: F.filter("detections", lambda h: h["rule"] == rule)
    matches = F.array_sort(F.transform("detections", lambda h: F.lower(h["match"])))
    return found.select(
        "doc_id",
        long(F.size(of("word"))).alias("words"),
        long(F.size(of("pair"))).alias("pairs"),
        F.md5(F.array_join(matches, "|")).alias("matches_md5"),
    )


# --- personal data -------------------------------------------------------------------------


@query
def pii_entities(spark: SparkSession, d: str) -> DataFrame:
    rows = pii.entity_rows(pii.detect_pii(inputs.screening_texts(spark, d)), "text_id")
    return rows.select(
        "text_id",
        long("entity_no").alias("entity_no"),
        "label",
        "entity",
        long("start").alias("span_start"),
        long("end").alias("span_end"),
    )


@query
def pii_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers with check digits or words in front, overlaps resolved."""
    found = pii.detect_pii(inputs.identified_texts(spark, d), catalog.CHECKED_RECOGNISERS)
    return pii.entity_rows(found, "text_id").select(
        "text_id",
        long("entity_no").alias("entity_no"),
        "label",
        "entity",
        long("start").alias("span_start"),
        long("end").alias("span_end"),
    )


@query
def pii_by_label(spark: SparkSession, d: str) -> DataFrame:
    found = pii.detect_pii(inputs.documents(spark, d))
    return pii.pii_by_label(found, [r.label for r in catalog.RECOGNISERS], by=["lang"])


@query
def pii_redacted(spark: SparkSession, d: str) -> DataFrame:
    done = pii.analyze_pii(inputs.documents(spark, d))
    return done.select(
        "doc_id",
        long("pii_count").alias("pii_count"),
        long(F.length("redacted_text")).alias("redacted_chars"),
        F.md5("redacted_text").alias("redacted_md5"),
    )


#: Each redaction switch once off, the others on.
REDACTION_SWITCHES = ("redact_person", "redact_location", "redact_other")


@query
def pii_redacted_switches(spark: SparkSession, d: str) -> DataFrame:
    """Redaction by policies that leave one group of entities alone."""
    found = pii.detect_pii(inputs.documents(spark, d)).select("doc_id", "text", "entities")
    rows = []
    for off in REDACTION_SWITCHES:
        policy = ScreeningPolicy(**{name: name != off for name in REDACTION_SWITCHES})
        done = pii.redact_by_policy(found, policy)
        rows.append(done.select("doc_id", F.lit(off).alias("off"), F.md5("redacted_text").alias("redacted_md5")))
    return reduce(DataFrame.unionByName, rows)


@query
def pii_regex_redacted(spark: SparkSession, d: str) -> DataFrame:
    docs = inputs.documents(spark, d)
    return docs.select("doc_id", F.md5(pii.redact_regex("text")).alias("redacted_md5"))


# --- scores --------------------------------------------------------------------------------


@query
def toxicity_lexicon(spark: SparkSession, d: str) -> DataFrame:
    docs = inputs.documents(spark, d)
    return docs.select("doc_id", r6(scores.score_toxicity("text")).alias("toxicity"))


@query
def softmax_max(spark: SparkSession, d: str) -> DataFrame:
    logits = F.col("embedding")
    return fixture(spark, d, "embeddings").select(
        "vec_id",
        r6(max_probability(logits)).alias("softmax_max"),
        r6(max_probability(logits, "sigmoid")).alias("sigmoid_max"),
    )


@query
def injection_cues(spark: SparkSession, d: str) -> DataFrame:
    texts = inputs.screening_texts(spark, d)
    scored = texts.select("text_id", scores.score_injection("text").alias("s"))
    verdict = scores.injection_verdict("s")
    return scored.select(
        "text_id", verdict["label"].alias("label"), r6(verdict["score"]).alias("score")
    )


# --- gates ---------------------------------------------------------------------------------


def _decision_columns(df: DataFrame, key: str = "text_id") -> DataFrame:
    return df.select(
        key,
        long("banned_words").alias("banned_words"),
        r6("toxicity").alias("toxicity"),
        long("pii_count").alias("pii_count"),
        r6("injection").alias("injection"),
        "action",
        "gate",
        r6("score").alias("score"),
        r6("threshold").alias("threshold"),
        "reason",
    )


@query
def gate_decisions(spark: SparkSession, d: str) -> DataFrame:
    return _decision_columns(gates.screen_input(inputs.screening_texts(spark, d), DEFAULT))


@query
def gate_decisions_strict(spark: SparkSession, d: str) -> DataFrame:
    return _decision_columns(gates.screen_input(inputs.screening_texts(spark, d), STRICT))


@query
def gate_decisions_overall(spark: SparkSession, d: str) -> DataFrame:
    return _decision_columns(gates.screen_input(inputs.screening_texts(spark, d), OVERALL))


@query
def gate_decisions_compat(spark: SparkSession, d: str) -> DataFrame:
    return _decision_columns(gates.screen_input(inputs.screening_texts(spark, d), COMPAT))


@query
def gate_policies(spark: SparkSession, d: str) -> DataFrame:
    """Every text under several policies, scored once."""
    rows = gates.screen_policies(inputs.screening_texts(spark, d), [DEFAULT, STRICT, OVERALL])
    return rows.select(
        "policy", "text_id", "action", "gate", r6("score").alias("score"), "reason"
    )


@query
def gate_funnel(spark: SparkSession, d: str) -> DataFrame:
    return gates.gate_funnel(gates.screen_input(inputs.documents(spark, d), STRICT), ["lang"])


def _audit(spark: SparkSession, d: str) -> DataFrame:
    screened = gates.screen_input(inputs.documents(spark, d), STRICT)
    return screened.withColumns(
        {"text_id": F.col("doc_id").cast("string"), "ts": inputs.stamped(F.col("doc_id"))}
    )


@query
def audit_log(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_dir(spark, "audit")
    sinks.write_audit(_audit(spark, d), path)
    return sinks.read_audit(spark, path).select(
        "text_id",
        "action",
        "gate",
        r6("score").alias("score"),
        "reason",
        F.col("run_date").cast("string").alias("run_date"),
    )


@query
def filtered_marker(spark: SparkSession, d: str) -> DataFrame:
    screened = gates.screen_input(inputs.documents(spark, d), STRICT)
    shown = screened.withColumn(
        "text", F.when(F.col("action") == gates.FILTER, "Filtered.").otherwise(F.col("text"))
    )
    return shown.select(
        "doc_id",
        tx.is_filtered_marker("text").alias("is_marker"),
        F.md5(chat.attach_context("text", F.col("source"))).alias("prompt_md5"),
    )


# --- evaluation ----------------------------------------------------------------------------


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = inputs.documents(spark, d), fixture(spark, d, "labels")
    return docs.join(labels.select("doc_id", (F.col("toxic") == 1).alias("malicious")), "doc_id")


def _categories(rule_list=None) -> Column:
    """Names of the rules a text hits, as the text form of a list."""
    names = [
        F.when(
            rules.detection_count("text", [r]) > 0,
            F.concat(F.lit("'"), F.lit(f"{r.language} {r.rule}"), F.lit("'")),
        )
        for r in (rule_list or catalog.all_rules())
    ]
    return F.concat(F.lit("["), F.concat_ws(", ", *names), F.lit("]"))


def _eval_sets(spark: SparkSession, d: str) -> list[DataFrame]:
    docs = evalset.labelled_set(
        _labelled(spark, d).select(
            F.col("text").alias("prompt"), F.lit(None).cast("string").alias("attack_type"),
            "malicious",
        ),
        "documents",
    )
    users = evalset.labelled_set(
        inputs.messages(spark, d).where("role = 'user'").select(
            F.col("text").alias("prompt"), F.col("role").alias("attack_type"),
            F.lit(False).alias("malicious"),
        ),
        "conversations",
    )
    passages = evalset.red_team_set(
        fixture(spark, d, "benchmark").select(
            F.col("text").alias("prompt"), _categories().alias("harm_category")
        ),
        "benchmark",
    )
    return [docs, users, passages]


@query
def eval_union(spark: SparkSession, d: str) -> DataFrame:
    rows = evalset.combine_eval(*_eval_sets(spark, d))
    return rows.select(F.md5("prompt").alias("prompt_md5"), "attack_type", "malicious", "source")


@query
def eval_subset(spark: SparkSession, d: str) -> DataFrame:
    rows = evalset.eval_subset(
        evalset.combine_eval(*_eval_sets(spark, d)), "documents", "benchmark"
    )
    return rows.groupBy("source", "malicious").agg(F.count(F.lit(1)).alias("prompts"))


@query
def eval_files(spark: SparkSession, d: str) -> DataFrame:
    base = scratch_dir(spark, "eval")
    labelled = _labelled(spark, d).select(
        F.col("text").alias("prompt"), F.lit(None).cast("string").alias("attack_type"), "malicious"
    )
    labelled.write.parquet(f"{base}/labelled")
    inputs.documents(spark, d).select(
        F.col("text").alias("prompt"), _categories().alias("harm_category")
    ).write.json(f"{base}/red")
    rows = evalset.combine_eval(
        tables.load_eval_set(spark, f"{base}/labelled", "labelled"),
        tables.load_eval_set(spark, f"{base}/red", "red", fmt="json", red_team=True),
    )
    return rows.select(F.md5("prompt").alias("prompt_md5"), "attack_type", "malicious", "source")


@query
def attack_types(spark: SparkSession, d: str) -> DataFrame:
    listed = inputs.documents(spark, d).select("doc_id", _categories().alias("harm_category"))
    return listed.select(
        "doc_id", evalset.flatten_attack_type("harm_category").alias("attack_type")
    )


@query
def eval_batches(spark: SparkSession, d: str) -> DataFrame:
    docs = fixture(spark, d, "documents").select("doc_id")
    return evalset.eval_batches(docs, "doc_id", batch_size=16, seed=7)


def _judged(spark: SparkSession, d: str) -> DataFrame:
    # the truth is joined first: texts without a label need no screening
    decisions = gates.screen_input(_labelled(spark, d), STRICT)
    return decisions.withColumn("is_filtered", F.col("action") == gates.FILTER)


def _report(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(
        *keys, "tp", "fp", "fn", "tn", *[r6(c).alias(c) for c in ("precision", "recall", "f1")]
    )


@query
def confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _report(metrics.confusion_metrics(_judged(spark, d)))


@query
def metrics_by_slice(spark: SparkSession, d: str) -> DataFrame:
    return _report(
        metrics.metrics_by_slice(_judged(spark, d), ["lang", "source"]), "slice", "value"
    )


@query
def metrics_report(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_dir(spark, "metrics")
    decisions = _audit(spark, d)
    judged = metrics.join_labels(
        decisions.select("doc_id", "action"), fixture(spark, d, "labels"), "doc_id",
        F.col("toxic") == 1,
    )
    sinks.write_metrics(metrics.confusion_metrics(judged), path)
    return _report(spark.read.parquet(path))


def _logged(spark: SparkSession, d: str) -> str:
    path = scratch_dir(spark, "log")
    judged = _judged(spark, d).withColumns(
        {"attack_type": F.lit("none"), "ts": inputs.stamped(F.col("doc_id"))}
    )
    logs.write_log(judged, path)
    return path


@query
def metrics_from_log(spark: SparkSession, d: str) -> DataFrame:
    blocks = logs.log_blocks(spark, _logged(spark, d))
    return _report(metrics.confusion_metrics(blocks))


@query
def metrics_from_split_log(spark: SparkSession, d: str) -> DataFrame:
    """The same numbers where blocks are counted over the splits of the log."""
    blocks = logs.log_blocks_by_line(spark, _logged(spark, d))
    return _report(metrics.confusion_metrics(blocks))


@query
def results_log(spark: SparkSession, d: str) -> DataFrame:
    lines = logs.read_results_log(spark, _logged(spark, d))
    kind = F.regexp_extract("message", r"^(Prompt|Attack Type|Malicious|Filtered|Passed)", 1)
    return lines.groupBy(
        "level", kind.alias("kind"), F.to_date("ts").cast("string").alias("day")
    ).agg(
        F.count(F.lit(1)).alias("lines"),
        # prompts may hold line breaks; all of them is in the record
        long(F.sum(F.when(kind == "Prompt", F.length("message")).otherwise(0))).alias("prompt_chars"),
    )


# --- knowledge base ------------------------------------------------------------------------


@query
def kb_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = kb.chunk_rows(inputs.documents(spark, d), "text", "doc_id", separator="\n")
    return rows.select(
        "doc_id", long("chunk_no").alias("chunk_no"), "chunk_id",
        long(F.length("text")).alias("chars"),
    )


@query
def kb_first_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The first three chunks of every text, where only a head is wanted."""
    rows = kb.chunk_rows(
        inputs.documents(spark, d), "text", "doc_id", separator="\n", max_chunks=3
    )
    return rows.select("doc_id", long("chunk_no").alias("chunk_no"), "chunk_id")


def _kb_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "chunk_id", "url", "topic", long("chunk_no").alias("chunk_no"), long("batch_no").alias("batch_no")
    )


@query
def kb_upsert(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_dir(spark, "kb")
    sinks.kb_append(inputs.document_chunks(spark, d, 0), path, 0)
    sinks.kb_append(inputs.document_chunks(spark, d, 1, "lang = 'en'"), path, 1)
    return _kb_columns(sinks.kb_current(spark, path))


@query
def chunk_store_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Two batches, the first one run again, then the store compacted."""
    store = chunk_store.open_store(spark, scratch_dir(spark, "chunks"))
    for number, which in ((0, "true"), (1, "lang = 'en'"), (0, "true")):
        chunk_store.append(spark, store, inputs.document_chunks(spark, d, number, which), number)
    small = chunk_store.compact(spark, store, scratch_dir(spark, "chunks"))
    rows = chunk_store.current(spark, small)
    return rows.select(
        "chunk_id", "url", "topic", long("chunk_no").alias("chunk_no"),
        long("batch_no").alias("batch_no"), F.md5("text").alias("text_md5"),
    )


@query
def kb_dedupe(spark: SparkSession, d: str) -> DataFrame:
    stored = kb.latest(inputs.document_chunks(spark, d, 0, "lang = 'en'"))
    return _kb_columns(kb.new_chunks(inputs.document_chunks(spark, d, 1), stored))


@query
def kb_browse(spark: SparkSession, d: str) -> DataFrame:
    old = inputs.document_chunks(spark, d, 0)
    new = inputs.document_chunks(spark, d, 1, "lang = 'en'")
    return _kb_columns(kb.browse(kb.upsert(old, new)))


@query
def page_chunks(spark: SparkSession, d: str) -> DataFrame:
    parsed = kb.parse_pages(fixture(spark, d, "pages"))
    rows = kb.chunk_rows(parsed, "content", "page_id", "url", "title")
    return rows.select("page_id", "title", long("chunk_no").alias("chunk_no"), "chunk_id")


@query
def topic_resolve(spark: SparkSession, d: str) -> DataFrame:
    parsed = kb.parse_pages(fixture(spark, d, "pages"))
    return kb.resolve_topics(inputs.page_topics(spark, d), parsed)


@query
def topic_unresolved(spark: SparkSession, d: str) -> DataFrame:
    parsed = kb.parse_pages(fixture(spark, d, "pages"))
    return kb.unresolved_topics(inputs.page_topics(spark, d), parsed)


@query
def topic_valid(spark: SparkSession, d: str) -> DataFrame:
    replies = inputs.page_topics(spark, d).select(
        F.concat(F.lit("```"), F.col("topic"), F.lit("```\n")).alias("topic_reply")
    )
    return (
        chat.topic_requests(replies).groupBy("topic").agg(F.count(F.lit(1)).alias("requests"))
    )


@query
def topic_ingest(spark: SparkSession, d: str) -> DataFrame:
    rows = kb.ingest_topics(inputs.page_topics(spark, d), fixture(spark, d, "pages"))
    return rows.select("topic", "url", long("chunk_no").alias("chunk_no"), "chunk_id")


# --- retrieval -----------------------------------------------------------------------------


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.kb_topk(inputs.mixed_queries(spark, d), inputs.vector_store(spark, d), 3)


@query
def kb_topk(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).select(
        "query_id", long("rank").alias("rank"), "chunk_id", r6("distance").alias("distance")
    )


@query
def kb_topk_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The same in many small blocks, as large inputs have them."""
    hits = retrieval.kb_topk(
        inputs.mixed_queries(spark, d), inputs.vector_store(spark, d), 3, block_rows=150
    )
    return hits.select(
        "query_id", long("rank").alias("rank"), "chunk_id", r6("distance").alias("distance")
    )


@query
def kb_ratings(spark: SparkSession, d: str) -> DataFrame:
    rated = retrieval.rate_hits(_hits(spark, d))
    return rated.groupBy("band", long("points").alias("points")).agg(
        F.count(F.lit(1)).alias("hits")
    )


@query
def kb_relevance(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.relevance_total(inputs.mixed_queries(spark, d), _hits(spark, d))


@query
def reingest_candidates(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.reingest_candidates(inputs.mixed_queries(spark, d), _hits(spark, d))


@query
def retrieve_fallback(spark: SparkSession, d: str) -> DataFrame:
    queries = inputs.mixed_queries(spark, d).withColumn(
        "query", F.concat(F.lit("query "), F.col("query_id").cast("string"))
    )
    store = inputs.vector_store(spark, d)
    hits = stage(retrieval.kb_topk(queries, store, 3, max_distance=0.2), "hits")
    return retrieval.with_fallback(queries, hits, store).select(
        "query_id", long("rank").alias("rank"), "url", "topic",
        F.md5("snippet").alias("snippet_md5"), r6("distance").alias("distance"),
    )


@query
def retrieve_reingest(spark: SparkSession, d: str) -> DataFrame:
    """Page titles as queries against the passages; weak ones bring in their pages."""
    titles = kb.parse_pages(fixture(spark, d, "pages")).select("title").distinct()
    queries = titles.select(
        F.md5("title").alias("query_id"), F.col("title").alias("query"),
        hash_embedding("title").alias("embedding"),
    )
    store = inputs.passages(spark, d).select(
        tx.content_id("text").alias("chunk_id"), "text", F.lit("passages").alias("source"),
        F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("topic"),
        F.lit(0).alias("chunk_no"), "embedding", F.lit(0).cast("bigint").alias("batch_no"),
    )
    hits, _ = flows.retrieve_with_reingest(
        queries, store, fixture(spark, d, "pages"), hash_embedding
    )
    return hits.select(
        "query_id", long("rank").alias("rank"), "chunk_id", r6("distance").alias("distance")
    )


@query
def prompt_with_context(spark: SparkSession, d: str) -> DataFrame:
    prompts = inputs.messages(spark, d).where("role = 'user'").select(
        inputs.message_id().alias("query_id"), "text", hash_embedding("text").alias("embedding")
    )
    done = flows.enrich_prompts(prompts, inputs.passages(spark, d))
    return done.select(
        "query_id",
        r6("distance").alias("distance"),
        distance_band("distance").alias("band"),
        F.md5("context").alias("context_md5"),
        F.md5("prompt").alias("prompt_md5"),
    )


@query
def enrich_by_topic(spark: SparkSession, d: str) -> DataFrame:
    """Every user message asks about a page: by title, in small letters, or by the main part."""
    parsed = stage(kb.parse_pages(fixture(spark, d, "pages")), "pages")
    path = scratch_dir(spark, "shelves")
    chunks = kb.chunk_rows(parsed, "content", "page_id")
    retrieval.store_by_page(chunks.withColumn("embedding", hash_embedding("text")), path)
    n = parsed.count()
    number = F.col("conv_id") * 7 + F.col("turn")
    title = F.col("title")
    reply = (
        F.when(number % 3 == 0, F.concat(F.lit("```"), title, F.lit("```\n")))
        .when(number % 3 == 1, F.lower(title))
        .otherwise(kb.main_title(title))
    )
    users = inputs.messages(spark, d).where("role = 'user'").withColumn("page_id", F.pmod(number, F.lit(n)))
    prompts = users.join(parsed.select("page_id", "title"), "page_id", "left").select(
        inputs.message_id().alias("query_id"), "text", reply.alias("topic_reply")
    )
    store = spark.read.parquet(path)
    done = flows.enrich_by_topic(prompts, store, kb.title_aliases(parsed), hash_embedding)
    return done.select(
        "query_id", "topic", "page_id", long("options").alias("options"),
        r6("distance").alias("distance"), F.md5("prompt").alias("prompt_md5"),
    )


# --- grounding -----------------------------------------------------------------------------


@query
def pair_similarity(spark: SparkSession, d: str) -> DataFrame:
    pairs = chat.with_previous_turn(inputs.messages(spark, d))
    return pairs.select(
        "conv_id", "turn", r6(sparse_cosine("text", "prev_text")).alias("similarity")
    )


@query
def sparse_topk(spark: SparkSession, d: str) -> DataFrame:
    """The passages closest in words to every answer, found by postings."""
    answers = inputs.responses(spark, d).select(
        F.col("response_id").alias("id"), F.col("response").alias("text")
    )
    store = fixture(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return sparse.sparse_topk(answers, store, 3, SPARSE_SCORE).select(
        F.col("left_id").alias("response_id"),
        long("rank").alias("rank"),
        F.col("right_id").alias("chunk_id"),
        r6("score").alias("score"),
    )


@query
def sparse_pairs(spark: SparkSession, d: str) -> DataFrame:
    """How many documents are close in words to how many others."""
    docs = inputs.documents(spark, d).select(F.col("doc_id").alias("id"), "text")
    labelled = fixture(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality")
    good = docs.join(labelled.where("quality = 1"), "id").select("id", "text")
    pairs = sparse.sparse_pairs(docs, good, 0.9).where("left_id <> right_id")
    return pairs.groupBy(F.col("left_id").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("close"), r6(F.max("score")).alias("closest")
    )


@query
def dense_similarity(spark: SparkSession, d: str) -> DataFrame:
    queries = inputs.mixed_queries(spark, d).withColumnRenamed("embedding", "q")
    vectors = fixture(spark, d, "embeddings").withColumnRenamed("vec_id", "query_id")
    return queries.join(vectors, "query_id").select(
        "query_id", r6(cosine_similarity("q", "embedding")).alias("similarity")
    )


@query
def context_scores(spark: SparkSession, d: str) -> DataFrame:
    pairs = grounding.score_pairs(inputs.responses(spark, d), inputs.retrieved_contexts(spark, d))
    return pairs.select(
        "response_id",
        long("pos").alias("pos"),
        F.md5(tx.clip("context")).alias("shown_md5"),
        r6("score").alias("score"),
    )


def _assessed(spark: SparkSession, d: str, method: str) -> DataFrame:
    done = grounding.semantic_similarity_run(
        inputs.responses(spark, d), inputs.retrieved_contexts(spark, d), method
    )
    return _assessment_columns(done)


def _assessment_columns(done: DataFrame) -> DataFrame:
    return done.select(
        "response_id",
        "contexts",
        r6("overall_score").alias("overall_score"),
        F.md5("max_similar_chunk").alias("best_md5"),
        "is_hallucination",
        "assessment",
    )


@query
def assess_response_max(spark: SparkSession, d: str) -> DataFrame:
    return _assessed(spark, d, "max_similarity")


@query
def assess_response_dense(spark: SparkSession, d: str) -> DataFrame:
    """The same with embeddings in place of word counts."""
    answers = inputs.responses(spark, d).withColumn("answer_vec", hash_embedding("response"))
    found = inputs.retrieved_contexts(spark, d)
    found = found.withColumn("context_vec", hash_embedding("context"))
    pairs = grounding.score_pairs(answers, found, cosine_similarity, "answer_vec", "context_vec")
    return _assessment_columns(grounding.assess_response(pairs))


@query
def assess_response_avg(spark: SparkSession, d: str) -> DataFrame:
    return _assessed(spark, d, "average")


@query
def assess_response_weighted(spark: SparkSession, d: str) -> DataFrame:
    return _assessed(spark, d, "weighted_average")


@query
def claims(spark: SparkSession, d: str) -> DataFrame:
    rows = grounding.claim_rows(inputs.documents(spark, d), "text", "doc_id")
    return rows.select(
        "doc_id", long("claim_no").alias("claim_no"), F.md5("claim").alias("claim_md5")
    )


@query
def claim_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = grounding.score_claims(inputs.responses(spark, d), inputs.retrieved_contexts(spark, d))
    return rows.select(
        "response_id",
        long("claim_no").alias("claim_no"),
        F.md5("claim").alias("claim_md5"),
        r6("score").alias("score"),
    )


@query
def claim_flags(spark: SparkSession, d: str) -> DataFrame:
    scored = grounding.score_claims(inputs.responses(spark, d), inputs.retrieved_contexts(spark, d))
    return grounding.flag_claims(scored).select(
        "response_id", long("claim_no").alias("claim_no"), r6("score").alias("score"), "is_hallucination"
    )


@query
def assess_claims(spark: SparkSession, d: str) -> DataFrame:
    answers = inputs.responses(spark, d)
    scored = grounding.score_claims(answers, inputs.retrieved_contexts(spark, d))
    done = grounding.assess_claims(answers, scored)
    return done.withColumn("avg_claim_score", r6("avg_claim_score"))


def _output_gate(spark: SparkSession, d: str, mode: str) -> DataFrame:
    pairs = grounding.score_pairs(
        inputs.responses(spark, d), inputs.retrieved_contexts(spark, d, 1)
    )
    policy = ScreeningPolicy(threshold_similarity=0.4, mode=mode)
    done = gates.screen_output(pairs, policy, answer="response", similarity="score")
    return done.select("response_id", "action", "gate", "reason")


@query
def output_gate(spark: SparkSession, d: str) -> DataFrame:
    return _output_gate(spark, d, "fixed")


@query
def output_gate_compat(spark: SparkSession, d: str) -> DataFrame:
    """Answers above the threshold are filtered."""
    return _output_gate(spark, d, "compat")


# --- conversations -------------------------------------------------------------------------


@query
def chat_history(spark: SparkSession, d: str) -> DataFrame:
    return inputs.history(spark, d).select(
        "conv_id", "turn", "role", F.md5("text").alias("text_md5")
    )


@query
def chat_segments(spark: SparkSession, d: str) -> DataFrame:
    packed = chat.history_segments(inputs.history(spark, d), turns=4)
    joined = F.array_join(
        F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n"
    )
    return packed.select(
        "conv_id", "segment", long(F.size("messages")).alias("n_messages"),
        F.md5(joined).alias("messages_md5"),
    )


@query
def fenced_block(spark: SparkSession, d: str) -> DataFrame:
    """Message texts with fences: closed, open, empty, inline and none, by turn."""
    kind = F.col("turn") % 5
    fence, text = F.lit("```"), F.col("text")
    fenced = (
        F.when(kind == 0, F.concat(F.lit("intro\n"), fence, F.lit("txt\n"), text, F.lit("\n"),
                                   fence, F.lit("\nrest")))
        .when(kind == 1, F.concat(fence, F.lit("\n"), text))
        .when(kind == 2, F.concat(text, F.lit("\n"), fence, F.lit("\n"), fence))
        .when(kind == 3, F.concat(F.lit("inline "), fence, text, fence))
        .otherwise(text)
    )
    return inputs.messages(spark, d).select(
        "conv_id", "turn", F.md5(tx.extract_fenced(fenced)).alias("block_md5")
    )


# --- streams -------------------------------------------------------------------------------


def _stream(spark: SparkSession, d: str, name: str, ddl: str) -> DataFrame:
    # a table may be one file or a folder of files; a stream takes a file by a pattern only
    return streams.read_stream(spark, f"{d.rstrip('/')}/[{name[0]}]{name[1:]}.parquet", ddl)


@query
def stream_screen(spark: SparkSession, d: str) -> DataFrame:
    base = scratch_dir(spark, "stream-screen")
    docs = _stream(spark, d, "documents", DOCUMENTS)
    screened = streams.stream_screen(docs, STRICT).drop("entities")
    run = streams.write_stream(screened, f"{base}/out", f"{base}/state").start()
    run.awaitTermination()
    return _decision_columns(spark.read.parquet(f"{base}/out"), "doc_id")


@query
def stream_history(spark: SparkSession, d: str) -> DataFrame:
    """Messages arrive in several batches, in no order; some of them twice."""
    base = scratch_dir(spark, "stream-history")
    said = inputs.messages(spark, d)
    again = said.where("turn % 5 = 0")
    mixed = said.unionByName(again).withColumn("_order", F.xxhash64("conv_id", "turn", "text"))
    mixed.repartition(4, "_order").drop("_order").write.parquet(f"{base}/in")
    arriving = streams.read_stream(spark, f"{base}/in", CONVERSATIONS, files_per_trigger=1)
    streams.stream_history(arriving, f"{base}/out", f"{base}/state").start().awaitTermination()
    joined = F.array_join(
        F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n"
    )
    return streams.read_history(spark, f"{base}/out", turns=4).select(
        "conv_id", "segment", long(F.size("messages")).alias("n_messages"),
        F.md5(joined).alias("messages_md5"),
    )


@query
def stream_kb_upsert(spark: SparkSession, d: str) -> DataFrame:
    base = scratch_dir(spark, "stream-kb")
    docs = _stream(spark, d, "documents", DOCUMENTS).select(
        F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("url"),
        F.col("lang").alias("topic"), "source", "text",
    )
    run = streams.stream_kb_upsert(docs, f"{base}/kb", f"{base}/state", separator="\n").start()
    run.awaitTermination()
    return sinks.kb_current(spark, f"{base}/kb").select(
        "chunk_id", "url", "topic", long("chunk_no").alias("chunk_no")
    )


@query
def stream_chunk_store(spark: SparkSession, d: str) -> DataFrame:
    """Documents arrive in four parts, one batch each; then all batches run again."""
    base = scratch_dir(spark, "stream-chunks")
    quarters = [inputs.documents(spark, d).where(F.col("doc_id") % 4 == part) for part in range(4)]
    # every batch has as many files, and every file some rows
    files = max(1, min(rows.count() for rows in quarters) // ARRIVING_ROWS)
    for rows in quarters:
        rows = rows.coalesce(1) if files == 1 else rows.repartition(files)
        rows.write.mode("append").parquet(f"{base}/in")
    for state in ("state", "again"):
        docs = streams.read_stream(spark, f"{base}/in", DOCUMENTS, files_per_trigger=files).select(
            F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("url"),
            F.col("lang").alias("topic"), "source", "text",
        )
        run = streams.stream_chunk_store(docs, f"{base}/kb", f"{base}/{state}", separator="\n")
        run.start().awaitTermination()
    rows = chunk_store.current(spark, chunk_store.open_store(spark, f"{base}/kb"))
    return rows.select(
        "chunk_id", "url", "topic", long("chunk_no").alias("chunk_no"),
        long("batch_no").alias("batch_no"), F.md5("text").alias("text_md5"),
    )


@query
def audit_rates(spark: SparkSession, d: str) -> DataFrame:
    rates = metrics.filter_rates(fixture(spark, d, "events"), F.col("event_type") == "error")
    return rates.withColumn("rate", r6("rate"))


@query
def stream_audit_rates(spark: SparkSession, d: str) -> DataFrame:
    base = scratch_dir(spark, "stream-rates")
    events = _stream(spark, d, "events", EVENTS)
    rates = streams.stream_filter_rates(events, F.col("event_type") == "error")
    streams.store_updates(rates, f"{base}/out", f"{base}/state").start().awaitTermination()
    last = streams.last_windows(spark.read.parquet(f"{base}/out"))
    return last.withColumn("rate", r6("rate"))


# --- models --------------------------------------------------------------------------------


def _length_scorer():
    """A stand-in model: long texts score high."""
    return lambda texts: [min(1.0, len(t) / 20000.0) for t in texts]


@query
def toxicity_model(spark: SparkSession, d: str) -> DataFrame:
    joined = inputs.documents(spark, d).join(fixture(spark, d, "labels"), "doc_id")
    model = models.fit_toxicity(joined.select("text", "toxic"))
    scored = models.predict_toxicity(model, inputs.documents(spark, d).select("doc_id", "text"))
    return scored.select("doc_id", r6("toxicity").alias("toxicity"))


@query
def scorer_plugin(spark: SparkSession, d: str) -> DataFrame:
    score = models.register_scorer(spark, "length_score", _length_scorer)
    policy = ScreeningPolicy(threshold_toxicity=0.4)
    done = models.screen_with_models(inputs.documents(spark, d), policy, toxicity=score)
    return _decision_columns(done, "doc_id")


@query
def embedder_plugin(spark: SparkSession, d: str) -> DataFrame:
    def letters():
        alphabet = "abcdefghijklmnopqrstuvwxyz"
        return lambda texts: np.array([[t.lower().count(a) for a in alphabet] for t in texts])

    embed = models.register_embedder(spark, "letter_counts", letters, dims=26)
    rows = inputs.documents(spark, d).select("doc_id", embed(F.col("text")).alias("v"))
    return rows.select(
        "doc_id",
        F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("letters"),
        F.element_at("v", 5).cast("double").alias("letter_e"),
    )


@query
def recogniser_plugin(spark: SparkSession, d: str) -> DataFrame:
    def ips():
        import re

        pattern = re.compile(r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b")

        def find(texts):
            return [
                [
                    {"text": m.group(), "label": "ip_address", "start": m.start(),
                     "end": m.end(), "score": 1.0}
                    for m in pattern.finditer(t)
                ]
                for t in texts
            ]

        return find

    find = models.register_recogniser(spark, "find_ips", ips)
    found = inputs.documents(spark, d).withColumn("entities", find(F.col("text")))
    done = pii.analyze_pii(found)
    return done.select(
        "doc_id", long("pii_count").alias("pii_count"), F.md5("redacted_text").alias("redacted_md5")
    )


@query
def text_features(spark: SparkSession, d: str) -> DataFrame:
    rows = models.text_features(inputs.documents(spark, d).select("doc_id", "text"))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return rows.select(
        "doc_id",
        r6(F.array_max("embedding")).alias("largest"),
        r6(total).alias("total"),
        r6(F.col("embedding")[7]).alias("slot_7"),
    )


@query
def word_features(spark: SparkSession, d: str) -> DataFrame:
    """Sparse tf-idf vectors of all documents: top terms, and every entry in a digest."""
    rows = features.word_vectors(inputs.documents(spark, d), "doc_id")
    micro = lambda t: F.floor(t["weight"] * 1000000 + 0.5).cast("bigint").cast("string")
    entries = F.transform("terms", lambda t: F.concat_ws(":", t["word_id"].cast("string"), micro(t)))
    return rows.select(
        "doc_id",
        long(F.size("terms")).alias("n_terms"),
        F.array_join(features.top_terms("terms"), " ").alias("top_terms"),
        F.md5(F.array_join(entries, ",")).alias("vector_md5"),
    )


@query
def generate_plugin(spark: SparkSession, d: str) -> DataFrame:
    def echo():
        return lambda prompts: [p + " done" for p in prompts]

    generate = models.register_generator(spark, "echo_done", echo)
    prompts = inputs.messages(spark, d).where("role = 'user'").select(
        inputs.message_id().alias("query_id"), "text", hash_embedding("text").alias("embedding")
    )
    done = flows.screen_and_answer(prompts, inputs.passages(spark, d), generate)
    return done.select(
        "query_id", "input_action", F.md5("answer").alias("answer_md5"),
        r6("similarity").alias("similarity"), "output_action",
    )
