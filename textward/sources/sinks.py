"""Sinks: audit table, metrics report, knowledge base batches."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.kb import latest

KB_STORED = schemas.KB + ", batch_no bigint"


def audit_rows(decisions: DataFrame) -> DataFrame:
    """Decisions in the audit schema."""
    return schemas.conform(decisions, schemas.AUDIT)


def write_audit(decisions: DataFrame, path: str) -> None:
    """Append to the audit table, partitioned by day."""
    rows = audit_rows(decisions).withColumn("run_date", F.to_date("ts"))
    rows.write.mode("append").partitionBy("run_date").parquet(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.AUDIT + ", run_date date").parquet(path)


def write_metrics(metrics: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a metrics report."""
    writer = metrics.write.mode("overwrite")
    (writer.option("header", "true") if fmt == "csv" else writer).format(fmt).save(path)


def kb_open(spark: SparkSession, path: str) -> DataFrame:
    """All stored batches; an empty frame of the same schema where nothing is stored yet."""
    try:
        return spark.read.schema(KB_STORED).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], KB_STORED)


def kb_append(batch: DataFrame, path: str, batch_no: int) -> None:
    """Store a batch under its number; writing the same batch again replaces it."""
    rows = batch
    for name in ("topic", "url", "source"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    if "embedding" not in rows.columns:
        rows = rows.withColumn("embedding", F.lit(None).cast("array<float>"))
    # copies inside the batch go first, so they are never stored
    rows = latest(schemas.conform(rows, schemas.KB).withColumn("batch_no", F.lit(batch_no)))
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_no")
        .parquet(path)
    )


def kb_current(spark: SparkSession, path: str) -> DataFrame:
    """The knowledge base: of every chunk the version of its last batch."""
    return latest(kb_open(spark, path))


def kb_compact(spark: SparkSession, path: str, target: str) -> None:
    """Write the current state to a new folder (the old one is being read, so it stays)."""
    current = kb_current(spark, path)
    current.write.mode("error").partitionBy("batch_no").parquet(target)
