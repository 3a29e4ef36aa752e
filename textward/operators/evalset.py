"""Labelled prompt sets: union, attack types, fixed constants, batches."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import _col, flatten_list_text
from ..schemas import EVAL_SET, conform

# Fixed value: separator of the attack types of one prompt.
TYPE_SEPARATOR = " | "

BUCKET_DIGITS = 3


def fill_attack_type(df: DataFrame) -> DataFrame:
    """Null attack types become empty."""
    return df.withColumn("attack_type", F.coalesce("attack_type", F.lit("")))


def flatten_attack_type(c: Column | str) -> Column:
    """Attack types from the text form of a list."""
    return F.coalesce(flatten_list_text(_col(c), TYPE_SEPARATOR), F.lit(""))


def labelled_set(df: DataFrame, source: str) -> DataFrame:
    """A set that carries ``prompt``, ``attack_type`` and ``malicious`` already."""
    return conform(fill_attack_type(df).withColumn("source", F.lit(source)), EVAL_SET)


def red_team_set(df: DataFrame, source: str, category: str = "harm_category") -> DataFrame:
    """A set of malicious prompts whose categories are a list in text form."""
    renamed = df.withColumnRenamed(category, "attack_type").withColumns(
        {
            "attack_type": flatten_attack_type("attack_type"),
            "malicious": F.lit(True),
            "source": F.lit(source),
        }
    )
    return conform(renamed, EVAL_SET)


def combine_eval(*sets: DataFrame) -> DataFrame:
    """Bag union; the ``source`` column tells the parts apart."""
    return reduce(lambda a, b: a.unionByName(b), sets)


def eval_subset(df: DataFrame, *sources: str) -> DataFrame:
    """The rows of the named sources."""
    return df.where(F.col("source").isin(*sources))


def eval_batches(
    df: DataFrame,
    key: str,
    batch_size: int = 1,
    seed: int = 0,
    shuffle: bool = True,
    bucket_digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Add ``row_no`` (from 1) and ``batch_no`` (from 0) in a repeatable random order.

    The order is by md5 of seed and key.  Row numbers over all rows need no global sort: rows are
    numbered inside buckets of the first hash digits, and each bucket starts where the ones
    before it end.  The bucket table has at most ``16 ** bucket_digits`` rows.
    ``shuffle=False`` keeps the order of a numeric key; its buckets are quantiles.
    """
    if shuffle:
        text = F.concat(F.lit(str(seed)), F.lit(":"), F.col(key).cast("string"))
        keyed = df.withColumn("_hash", F.md5(text))
        keyed = keyed.withColumn("_bucket", F.substring("_hash", 1, bucket_digits))
        order = ["_hash", key]
    else:
        n = 16**bucket_digits
        cuts = df.select(F.col(key).cast("double").alias("k")).approxQuantile(
            "k", [i / n for i in range(1, n)], 0.5 / n
        )
        splits = [-float("inf"), *sorted(set(cuts)), float("inf")]
        numbers = df.withColumn("_key", F.col(key).cast("double"))
        keyed = Bucketizer(splits=splits, inputCol="_key", outputCol="_bucket").transform(numbers)
        order = [key]
    counts = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    numbered = keyed.withColumn("_rn", inside).join(F.broadcast(starts), "_bucket")
    row_no = (F.col("_start") + F.col("_rn")).cast("bigint")
    return numbered.withColumns(
        {"row_no": row_no, "batch_no": F.floor((row_no - 1) / batch_size).cast("bigint")}
    ).drop("_hash", "_key", "_bucket", "_rn", "_start")
