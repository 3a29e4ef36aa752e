"""Conversation history and the context put in front of a prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import _col, clean_topic, is_filtered_marker, strip, valid_topic
from .skew import join_hot

# Fixed values
DEFAULT_SYSTEM = "You are a helpful assistant."
CONTEXT_PREFIX = 'Use the following as context for the prompt: "'
CONTEXT_SUFFIX = '"\n'

SEGMENT_TURNS = 256
MESSAGE_TYPE = "array<struct<turn:bigint,role:string,content:string>>"


def chat_history(conversations: DataFrame, system: str = DEFAULT_SYSTEM) -> DataFrame:
    """Message rows ``(conv_id, turn, role, text)``; every conversation opens with a system row.

    A conversation that does not start with one gets ``system`` one turn before its first.  Only
    one small row per conversation is aggregated; the messages themselves are not shuffled.
    """
    first = conversations.groupBy("conv_id").agg(
        F.min("turn").alias("_first"),
        F.min(F.when(F.col("role") == "system", F.col("turn"))).alias("_system"),
    )
    opening = first.where(
        F.col("_system").isNull() | (F.col("_system") > F.col("_first"))
    ).select(
        "conv_id",
        (F.col("_first") - 1).alias("turn"),
        F.lit("system").alias("role"),
        F.lit(system).alias("text"),
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(opening)


def after_reset(conversations: DataFrame, role: str = "reset") -> DataFrame:
    """Messages since the last reset of their conversation (a message of role ``role``).

    Only conversations with a reset are looked up, one number each.
    """
    resets = conversations.where(F.col("role") == role)
    last = resets.groupBy("conv_id").agg(F.max("turn").alias("_reset"))
    joined = join_hot(conversations, last, "conv_id", "turn", "left")
    return joined.where(F.col("_reset").isNull() | (F.col("turn") > F.col("_reset"))).drop("_reset")


def history_segments(history: DataFrame, turns: int = SEGMENT_TURNS) -> DataFrame:
    """Histories as ordered message arrays, ``turns`` turns to a segment.

    ``(conv_id, segment, messages)``: reading segments in order gives the whole history.  A
    segment is bounded by its turns, so no conversation, however long, ends up in one row or
    one task.  Messages that share a turn all stay, ordered by role and text; only exact repeats
    (same turn, role and text) are dropped.
    """
    unique = history.select("conv_id", "turn", "role", "text").distinct()
    message = F.struct("turn", "role", F.col("text").alias("content"))
    # an added system row may stand at turn -1; it belongs to the first segment
    place = F.when(F.col("turn") == -1, 0).otherwise(F.col("turn"))
    return (
        unique.withColumn("segment", F.floor(place / turns).cast("bigint"))
        .groupBy("conv_id", "segment")
        .agg(F.sort_array(F.collect_list(message)).cast(MESSAGE_TYPE).alias("messages"))
    )


def attach_context(prompt: Column | str, context: Column | str, enabled: bool = True) -> Column:
    """Prompt with its context in front; unchanged without context, when off, or if filtered."""
    text, extra = _col(prompt), _col(context)
    if not enabled:
        return text
    joined = F.concat(F.lit(CONTEXT_PREFIX), extra, F.lit(CONTEXT_SUFFIX), text)
    # blank context counts as none
    use = (F.coalesce(strip(extra), F.lit("")) != "") & ~is_filtered_marker(text)
    return F.when(use, joined).otherwise(text)


def topic_requests(df: DataFrame, reply: str = "topic_reply") -> DataFrame:
    """Rows with a usable ``topic`` taken from the reply of a topic model."""
    return df.withColumn("topic", clean_topic(reply)).where(valid_topic("topic"))


def with_previous_turn(conversations: DataFrame, role: str = "assistant", turns: int = SEGMENT_TURNS) -> DataFrame:
    """Messages of ``role`` with the last earlier message of their conversation.

    Messages are ordered by turn, role and text, so turns may have gaps or hold several messages;
    exact repeats count once, as in the history.  The message before is looked up inside segments
    of ``turns`` turns, and the last one of a segment is joined to the next segment that has
    rows: a long conversation spreads over all tasks, only its segment numbers meet in one.
    Messages without conversation or turn have no place and are left out, and so is the first.
    """
    unique = conversations.select("conv_id", "turn", "role", "text").distinct()
    placed = unique.where("conv_id IS NOT NULL AND turn IS NOT NULL").withColumn(
        "_segment", F.floor(F.col("turn") / turns).cast("bigint")
    )
    message = F.struct("turn", "role", "text")
    last = placed.groupBy("conv_id", "_segment").agg(F.max(message).alias("_handed"))
    following = placed.select("conv_id", "_segment").distinct().select(
        "conv_id", "_segment", F.lead("_segment").over(Window.partitionBy("conv_id").orderBy("_segment")).alias("_next")
    )
    handed = (
        last.join(following.where("_next IS NOT NULL"), ["conv_id", "_segment"])
        .select("conv_id", F.col("_next").alias("_segment"), "_handed")
    )
    inside = Window.partitionBy("conv_id", "_segment").orderBy("turn", "role", "text")
    before = placed.withColumn("_before", F.lag(message).over(inside)).where(F.col("role") == role)
    return (
        before.join(handed, ["conv_id", "_segment"], "left")
        .withColumn("_before", F.coalesce("_before", "_handed"))
        .where("_before IS NOT NULL")
        .select(
            "conv_id",
            "turn",
            "role",
            "text",
            F.col("_before.role").alias("prev_role"),
            F.col("_before.text").alias("prev_text"),
        )
    )
