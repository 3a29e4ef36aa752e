"""Structured Streaming forms."""

from .screening import (
    last_windows,
    read_history,
    read_stream,
    store_updates,
    stream_chunk_store,
    stream_filter_rates,
    stream_history,
    stream_kb_upsert,
    stream_screen,
    write_stream,
)

__all__ = [
    "last_windows", "read_history", "read_stream", "store_updates", "stream_filter_rates",
    "stream_chunk_store", "stream_history", "stream_kb_upsert", "stream_screen", "write_stream",
]
