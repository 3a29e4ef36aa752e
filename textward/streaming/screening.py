"""The same operators on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..config import ScreeningPolicy
from ..operators import chat, gates, kb, metrics
from ..sources import chunk_store, sinks


def read_stream(
    spark: SparkSession, path: str, ddl: str, files_per_trigger: int = 1000, fmt: str = "parquet"
) -> DataFrame:
    """A stream over the files of a folder."""
    reader = spark.readStream.schema(ddl).format(fmt)
    return reader.option("maxFilesPerTrigger", files_per_trigger).load(path)


def stream_screen(
    prompts: DataFrame, policy: ScreeningPolicy | None = None, **options
) -> DataFrame:
    """Screen every prompt of a stream: stateless, with the expressions of the batch form."""
    return gates.screen_input(prompts, policy, **options)


def write_stream(
    df: DataFrame, path: str, checkpoint: str, mode: str = "append", fmt: str = "parquet"
) -> DataStreamWriter:
    """A file sink that takes what is there and stops."""
    writer = df.writeStream.format(fmt).outputMode(mode).trigger(availableNow=True)
    return writer.option("checkpointLocation", checkpoint).option("path", path)


HISTORY = "conv_id bigint, turn bigint, role string, text string"


def stream_history(messages: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Store the messages of a stream, whenever they arrive: an append-only table.

    Nothing is folded on arrival, so late, resumed and repeated messages need no state and none
    is lost; a batch has its own folder and replaces it when it is run again.
    """
    rows = messages.select("conv_id", "turn", "role", "text")

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = rows.writeStream.foreachBatch(store).trigger(availableNow=True)
    return writer.option("checkpointLocation", checkpoint)


def read_history(
    spark: SparkSession,
    path: str,
    system: str = chat.DEFAULT_SYSTEM,
    turns: int = chat.SEGMENT_TURNS,
) -> DataFrame:
    """The stored messages as history segments: the batch form over all that has arrived."""
    stored = spark.read.schema(HISTORY).parquet(path)
    return chat.history_segments(chat.chat_history(stored, system), turns)


def last_windows(updates: DataFrame) -> DataFrame:
    """Of a table of window updates the last one of every window (counts only grow)."""
    return updates.groupBy("window_start").agg(
        F.max_by(F.struct("decisions", "filtered", "rate"), "decisions").alias("s")
    ).select("window_start", "s.decisions", "s.filtered", "s.rate")


def store_updates(df: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Write every update of a stream to a folder per batch, replaced when a batch is run again.

    In contrast to an append sink, groups that are still open are there too.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = df.writeStream.outputMode("update").foreachBatch(store).trigger(availableNow=True)
    return writer.option("checkpointLocation", checkpoint)


def stream_kb_upsert(
    documents: DataFrame, path: str, checkpoint: str, text: str = "text", **chunking
) -> DataStreamWriter:
    """Chunk arriving documents ``(url, topic, source, text)`` and store them batch by batch.

    A batch has its own folder, replaced when the batch is run again after a failure.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        rows = kb.chunk_rows(batch, text, "url", "topic", "source", **chunking)
        sinks.kb_append(rows, path, batch_id)

    return (
        documents.writeStream.foreachBatch(store)
        .trigger(availableNow=True)
        .option("checkpointLocation", checkpoint)
    )


def stream_chunk_store(
    documents: DataFrame, path: str, checkpoint: str, text: str = "text", **chunking
) -> DataStreamWriter:
    """As :func:`stream_kb_upsert`, into a store by buckets: a batch writes its new texts only."""

    def store(batch: DataFrame, batch_id: int) -> None:
        rows = kb.chunk_rows(batch, text, "url", "topic", "source", **chunking)
        spark = batch.sparkSession
        chunk_store.append(spark, chunk_store.open_store(spark, path), rows, batch_id)

    return (
        documents.writeStream.foreachBatch(store)
        .trigger(availableNow=True)
        .option("checkpointLocation", checkpoint)
    )


def stream_filter_rates(
    audit: DataFrame, filtered: Column | None = None, **options: str
) -> DataFrame:
    """Filter rate per time window of an audit stream."""
    flag = F.col("action") == gates.FILTER if filtered is None else filtered
    return metrics.filter_rates(audit, flag, **options)
