"""Helpers shared by the operators: reading, words, batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage

#: A word is a run of anything but the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

__all__ = ["SPACES", "WORD", "batches", "binary_column", "fresh_name", "lower_az", "read", "stage", "word_array"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table below a folder, by Spark's reader alone."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def word_array(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def lower_az(text: Column) -> Column:
    """Lower case for A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def binary_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as bytes; null counts as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name the frame does not have (in any letter case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches that hold rows."""
    return (b for b in frames if b.num_rows)
