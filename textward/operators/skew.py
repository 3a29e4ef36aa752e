"""A join for a side in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with this many rows or fewer is never split.
LEAST_ROWS = 1000
SHARES = 1000
SALTS = 64


def join_hot(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread_by: str,
    how: str = "inner",
    least_rows: int = LEAST_ROWS,
) -> DataFrame:
    """``left.join(right, key, how)`` for a ``right`` that has every key once.

    Keys with more than 1/1000 of the rows of ``left`` (and more than ``least_rows``) are hot:
    there are fewer than 1000 of them, whatever the data, so their list may be broadcast.  Their rows are spread over
    ``SALTS`` parts by ``spread_by``, and their one row on the right is given to every part.
    ``left`` is counted first, so it should be stored, not computed on the way.
    """
    total = left.count()
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.where(F.col("_n") > max(total / SHARES, least_rows)).select(key, F.lit(True).alias("_hot"))
    part = F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int")
    spread = left.join(F.broadcast(hot), key, "left").withColumn(
        "_part", F.when(F.col("_hot"), part).otherwise(0)
    )
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1)))
    copied = right.join(F.broadcast(hot), key, "left").withColumn(
        "_part", F.explode(F.coalesce(parts, F.array(F.lit(0))))
    )
    return spread.drop("_hot").join(copied.drop("_hot"), [key, "_part"], how).drop("_part")
