"""Explicit schemas of every table the package reads or writes (DDL, checked on read)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# inputs
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"
LABELS = "doc_id bigint, quality int, toxic int"
PAGES = "page_id bigint, url string, html string"
BENCHMARK = "item_id bigint, text string"
EMBEDDINGS = "vec_id bigint, embedding array<float>, label int"
EVENTS = (
    "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
)

# configuration
RULES = (
    "position int, language string, rule string, pattern string, action string, starts string"
)
RECOGNISERS = (
    "position int, label string, group string, pattern string, guard string, "
    "digit_led boolean, lead string, check string, starts string"
)

# results
DETECTIONS = "array<struct<language:string,rule:string,match:string>>"
EVAL_SET = "prompt string, attack_type string, malicious boolean, source string"
KB = (
    "chunk_id string, text string, source string, url string, topic string, chunk_no int, "
    "embedding array<float>"
)
AUDIT = (
    "text_id string, action string, gate string, score double, threshold double, reason string, "
    "ts timestamp"
)

TABLES = {
    "documents": DOCUMENTS,
    "conversations": CONVERSATIONS,
    "labels": LABELS,
    "pages": PAGES,
    "benchmark": BENCHMARK,
    "embeddings": EMBEDDINGS,
    "events": EVENTS,
}


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Project to the columns and types of ``ddl``; a missing column is an error."""
    schema = df.sparkSession.createDataFrame([], ddl).schema
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
