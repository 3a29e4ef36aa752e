"""Reading input tables with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schemas
from ..operators import evalset

FORMATS = ("parquet", "json", "csv", "orc")


def read_table(
    spark: SparkSession, path: str, ddl: str, fmt: str = "parquet", **options: str
) -> DataFrame:
    """Read files under a fixed schema (no inference pass over the data)."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}, found {fmt!r}")
    if fmt == "csv":
        options = {"header": "true", "multiLine": "false", **options}
    return spark.read.schema(ddl).options(**options).format(fmt).load(path)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the known tables below a folder."""
    return read_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet", schemas.TABLES[name])


def load_eval_set(
    spark: SparkSession,
    paths: str | list[str],
    source: str,
    fmt: str = "parquet",
    red_team: bool = False,
    **options: str,
) -> DataFrame:
    """Labelled prompts from the files of one set (all its splits).

    ``red_team`` marks sets of malicious prompts with categories in list text.  CSV files whose
    prompts hold line breaks need ``multiLine="true"``; such files are not split, so JSON or
    Parquet is the better form for large sets.
    """
    ddl = (
        "prompt string, harm_category string"
        if red_team
        else "prompt string, attack_type string, malicious boolean"
    )
    parts = [
        read_table(spark, p, ddl, fmt, **options)
        for p in ([paths] if isinstance(paths, str) else paths)
    ]
    rows = evalset.combine_eval(*parts)
    if red_team:
        return evalset.red_team_set(rows, source)
    return evalset.labelled_set(rows, source)
