"""End-to-end plans: screen and answer prompts, build a knowledge base, evaluate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ScreeningPolicy
from ..functions.text import clean_topic, valid_topic
from ..functions.vectors import sparse_cosine
from ..operators import chat, gates, kb, metrics, retrieval
from ..operators.skew import join_hot
from ..session import stage

ColumnFn = Callable[[Column], Column]


def enrich_prompts(
    prompts: DataFrame,
    store: DataFrame,
    policy: ScreeningPolicy | None = None,
) -> DataFrame:
    """Put the best context in front of every prompt.

    ``prompts``: ``(query_id, text, embedding)``; ``store``: chunks with embeddings.  Adds
    ``context``, ``distance`` and ``prompt``.
    """
    policy = policy or ScreeningPolicy()
    if not policy.enable_context:
        none = F.lit(None)
        return prompts.withColumns(
            {"context": none.cast("string"), "distance": none.cast("double"),
             "prompt": F.col("text")}
        )
    top = stage(retrieval.kb_topk(prompts, store, 1, policy.max_context_distance), "best-hits")
    texts = store.select("chunk_id", F.col("text").alias("context"))
    best = join_hot(top, texts, "chunk_id", "query_id").select("query_id", "context", "distance")
    out = prompts.join(best, "query_id", "left")
    return out.withColumn("prompt", chat.attach_context("text", "context"))


def enrich_by_topic(
    prompts: DataFrame,
    chunks: DataFrame,
    aliases: DataFrame,
    embed: ColumnFn,
    policy: ScreeningPolicy | None = None,
) -> DataFrame:
    """Put the best passage of the page a prompt is about in front of it.

    ``prompts``: ``(query_id, text, topic_reply)`` with the reply of a topic model; ``chunks``: a
    store by page (``retrieval.store_by_page``); ``aliases``: ``kb.title_aliases``.  Adds ``topic``,
    ``page_id``, ``options`` (titles that share the name), ``distance``, ``context`` and
    ``prompt``.  A reply that is no usable topic, or one no page goes by, leaves the prompt as it
    is; so does a policy without context.
    """
    policy = policy or ScreeningPolicy()
    topic = F.when(valid_topic(clean_topic("topic_reply")), clean_topic("topic_reply"))
    named = prompts.withColumn("topic", topic).drop("topic_reply")
    if not policy.enable_context:
        none = {"page_id": "bigint", "options": "bigint", "distance": "double", "context": "string"}
        return named.withColumns(
            {**{k: F.lit(None).cast(v) for k, v in none.items()}, "prompt": F.col("text")}
        )
    asked = kb.name_topics(named, aliases).withColumn("embedding", embed(F.col("topic")))
    best = retrieval.best_of_page(stage(asked, "topics"), chunks)
    if policy.max_context_distance is not None:
        best = best.where(F.col("distance") <= policy.max_context_distance)
    best = stage(best, "topic-hits")
    shelves = [r[0] for r in best.select(retrieval.shelf("page_id")).distinct().collect()]
    # a chunk may lie on several pages: its text is taken from the topic's own
    texts = chunks.where(F.col("shelf").isin(shelves)).select(
        "page_id", "chunk_id", F.col("text").alias("context")
    ).dropDuplicates(["page_id", "chunk_id"])
    contexts = stage(best.join(texts, ["page_id", "chunk_id"]).drop("chunk_id"), "topic-contexts")
    out = join_hot(stage(named, "topic-prompts"), contexts, "topic", "query_id", "left")
    return out.withColumn("prompt", chat.attach_context("text", "context"))


def screen_and_answer(
    prompts: DataFrame,
    store: DataFrame,
    generate: ColumnFn,
    policy: ScreeningPolicy | None = None,
) -> DataFrame:
    """Screen prompts, enrich the survivors, generate, check the answers.

    ``prompts``: ``(query_id, text, embedding)``.  The result has one row per prompt with the
    ``input_*`` decision and, for survivors, ``answer`` and the ``output_*`` decision.
    """
    policy = policy or ScreeningPolicy()
    # used for the decisions and, by several jobs, for the survivors
    screened = stage(gates.screen_input(prompts, policy), "screened")
    parts = {f"input_{c}": F.col(c) for c in ("action", "gate", "score", "threshold", "reason")}
    decided = screened.select("query_id", *[v.alias(k) for k, v in parts.items()])
    survivors = screened.where(F.col("action") != gates.FILTER).select(
        "query_id", "text", "embedding"
    )
    enriched = enrich_prompts(survivors, store, policy)
    answered = enriched.withColumn("answer", generate(F.col("prompt")))
    scored = answered.withColumn("similarity", sparse_cosine("answer", "context"))
    checked = gates.screen_output(scored, policy).select(
        "query_id", "context", "answer", "similarity",
        F.col("action").alias("output_action"), F.col("reason").alias("output_reason"),
    )
    return decided.join(checked, "query_id", "left")


def retrieve_with_reingest(
    queries: DataFrame,
    store: DataFrame,
    pages: DataFrame,
    embed: ColumnFn,
    k: int = 3,
    next_batch: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """Top-k, one ingest for all weak queries, and a second top-k for them.

    ``queries``: ``(query_id, query, embedding)``; ``store``: chunks with ``batch_no``.  Gives
    the hits and the enlarged store.  The query text serves as the topic of the ingest.
    """
    first = stage(retrieval.kb_topk(queries, store, k), "first-hits")
    weak_ids = stage(retrieval.reingest_candidates(queries, first).select("query_id"), "weak")
    weak = queries.join(weak_ids, "query_id", "left_semi")
    found = kb.ingest_topics(weak.select(F.col("query").alias("topic")), pages)
    batch = stage(found.withColumn("batch_no", F.lit(next_batch).cast("bigint")), "ingested")
    # content that is stored already needs no new embedding
    fresh = kb.new_chunks(batch, store).withColumn("embedding", embed(F.col("text")))
    # a chunk of very many pages is one row before it meets the store
    known = kb.latest(batch).join(store.select("chunk_id", "embedding"), "chunk_id")
    columns = store.columns
    changed = known.select(columns).unionByName(fresh.select(columns))
    enlarged = stage(kb.upsert(store, changed), "enlarged-store")
    second = retrieval.kb_topk(weak, enlarged, k)
    kept = first.join(weak_ids, "query_id", "left_anti")
    return kept.unionByName(second), enlarged


def evaluate(
    labelled: DataFrame, policy: ScreeningPolicy | None = None, slices: tuple[str, ...] = ()
) -> DataFrame:
    """Screen labelled prompts ``(prompt, malicious, ...)`` and report the metrics."""
    screened = gates.screen_input(labelled, policy, text="prompt")
    decided = screened.withColumn("is_filtered", F.col("action") == gates.FILTER)
    if slices:
        return metrics.metrics_by_slice(decided, slices)
    return metrics.confusion_metrics(decided)
