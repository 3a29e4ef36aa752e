"""Frames of prompts, answers and contexts derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import hash_embedding
from ..operators import chat, kb, retrieval
from ..operators.skew import join_hot
from ..session import stage
from ..sources.tables import fixture


def documents(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "documents")


def screening_texts(spark: SparkSession, d: str) -> DataFrame:
    """``(text_id, lang, text)``: all documents and all user messages."""
    docs = fixture(spark, d, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("text_id"), "lang", "text"
    )
    users = fixture(spark, d, "conversations").where("role = 'user'").select(
        F.concat_ws("-", F.lit("conv"), "conv_id", "turn").alias("text_id"),
        F.lit(None).cast("string").alias("lang"),
        "text",
    )
    return docs.unionByName(users)


#: Pieces with derived identifiers for each document; the first one follows its text.
IDENTIFIED_PIECES = 20

#: Tasks for each core where few rows make much work, so that no core waits long for the last ones.
DEALT = 4


def dealt(rows: DataFrame) -> DataFrame:
    """The rows in equal shares: a file of one row group would otherwise be the work of one task."""
    return rows.repartition(DEALT * rows.sparkSession.sparkContext.defaultParallelism)


def identified_texts(spark: SparkSession, d: str) -> DataFrame:
    """``(text_id, text)``: every document, and pieces with identifiers made of the digits of its id's md5.

    Few of the cards, accounts and taxpayer numbers pass their check digits by chance.
    """
    key = F.concat_ws(":", F.col("doc_id").cast("string"), "n")
    digits = F.translate(F.md5(key), "abcdef", "012345")
    cut = lambda start, n: F.substring(digits, start, n)
    piece = F.concat(
        F.lit("Card "), cut(1, 16),
        F.lit(", DE"), cut(1, 20),
        F.lit(", GB"), cut(3, 2), F.lit(" WEST "), cut(5, 14),
        F.lit(", CPF "), cut(1, 3), F.lit("."), cut(4, 3), F.lit("."), cut(7, 3), F.lit("-"), cut(10, 2),
        F.lit(", CVV is "), cut(20, 3),
        F.lit(", expires "), cut(23, 2), F.lit("/"), cut(25, 2),
        F.lit(", vehicle registration AB"), cut(8, 6),
        F.lit(", insurance POLICY, fax "), cut(9, 9),
    )
    numbered = dealt(documents(spark, d).select("doc_id", "text")).select(
        "doc_id", "text", F.explode(F.sequence(F.lit(1), F.lit(IDENTIFIED_PIECES))).alias("n")
    )
    return numbered.select(
        F.concat_ws("-", "doc_id", "n").alias("text_id"),
        F.concat(F.when(F.col("n") == 1, F.coalesce("text", F.lit(""))).otherwise(""), F.lit("\n"), piece).alias("text"),
    )


def stamped(c: Column) -> Column:
    """A fixed time per document, one minute apart, so results can be repeated."""
    return F.timestamp_seconds(F.lit(1704067200) + c * 60)


def messages(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "conversations")


def message_id() -> Column:
    return F.concat_ws("-", "conv_id", "turn")


def passages(spark: SparkSession, d: str) -> DataFrame:
    """The reference passages as a chunk store with embeddings."""
    return fixture(spark, d, "benchmark").select(
        F.col("item_id").alias("chunk_id"), "text", hash_embedding("text").alias("embedding")
    )


def responses(spark: SparkSession, d: str) -> DataFrame:
    """``(response_id, response)``: the assistant messages."""
    said = messages(spark, d).where("role = 'assistant'")
    return said.select(message_id().alias("response_id"), F.col("text").alias("response"))


def retrieved_contexts(spark: SparkSession, d: str, k: int = 3) -> DataFrame:
    """``(response_id, pos, context)``: the k nearest passages of every assistant message."""
    queries = responses(spark, d).select(
        F.col("response_id").alias("query_id"), hash_embedding("response").alias("embedding")
    )
    store = passages(spark, d)
    # read more than once by the operators that follow
    hits = stage(retrieval.kb_topk(queries, store, k), "contexts")
    return join_hot(hits, store.select("chunk_id", "text"), "chunk_id", "query_id").select(
        F.col("query_id").alias("response_id"),
        (F.col("rank") - 1).alias("pos"),
        F.col("text").alias("context"),
    )


def mixed_queries(spark: SparkSession, d: str) -> DataFrame:
    """``(query_id, embedding)``: every vector mixed with the next one, in varying parts."""
    vectors = fixture(spark, d, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("v")
    )
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    share = (F.col("vec_id") % 9) / F.lit(4.0)
    return vectors.join(following, "vec_id", "left").select(
        F.col("vec_id").alias("query_id"),
        F.when(F.col("w").isNull(), F.col("v"))
        .otherwise(F.zip_with("v", "w", lambda a, b: a + share * b))
        .alias("embedding"),
    )


def vector_store(spark: SparkSession, d: str) -> DataFrame:
    """The embeddings as a chunk store."""
    vid = F.col("vec_id").cast("string")
    return fixture(spark, d, "embeddings").select(
        F.col("vec_id").alias("chunk_id"),
        F.concat(F.lit("vector "), vid).alias("text"),
        F.concat(F.lit("vec://"), vid).alias("url"),
        F.col("label").cast("string").alias("topic"),
        "embedding",
    )


def document_chunks(spark: SparkSession, d: str, batch_no: int, which: str = "true") -> DataFrame:
    """Chunks of the documents ``which`` holds for, one line each, as a batch of the store."""
    docs = documents(spark, d).where(which).select(
        F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("url"),
        F.col("lang").alias("topic"),
        "source",
        "text",
    )
    rows = kb.chunk_rows(docs, "text", "url", "topic", "source", separator="\n")
    return rows.withColumn("batch_no", F.lit(batch_no).cast("bigint"))


def page_topics(spark: SparkSession, d: str) -> DataFrame:
    """Topics to look up: the titles as they are, in small letters, and backwards."""
    titles = kb.parse_pages(fixture(spark, d, "pages")).select(F.col("title").alias("topic"))
    return titles.select(
        F.explode(F.array("topic", F.lower("topic"), F.reverse("topic"))).alias("topic")
    )


def history(spark: SparkSession, d: str) -> DataFrame:
    return chat.chat_history(messages(spark, d))
