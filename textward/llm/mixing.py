"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Every source gets a share of all words by its weight.  A share above ``max_epochs`` times the
source is clamped there and the excess goes to the open sources by weight, until none is above.
A source is then taken whole as often as its target allows, and once more for a seeded part of
its documents.

Cases: a null text has size 0; a null source is a source of its own; a source without words
gets target 0; rows that repeat get the same repetitions; a null id is hashed as text "";
an empty table gives an empty mix.  Columns of the input are kept, and the added ones get the
names of ``COLUMNS``, which replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh_name, stage

COLUMNS = ("size", "source_size", "target", "copies", "taken")
MAX_EPOCHS = 3
#: A source is cut into this many hash buckets at most, so its part is met to 1 / 65536.
BUCKETS = 1 << 16
#: Passes that fill what is left by buckets that still fit.
FILLS = 4


def n_words(text: Column) -> Column:
    """Number of words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def cyclic_weights(sources: DataFrame, source: str, cycle: int = 3) -> DataFrame:
    """Weights 1 to ``cycle``, repeating over the sources by code point, null last.

    One row per source takes part, so the sort is as small as the list of sources.
    """
    order = Window.orderBy(F.col(source).asc_nulls_last())
    return sources.withColumn("weight", (F.row_number().over(order) - 1) % cycle + 1)


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to rows of (source, source_size, weight).

    Two sums over the sources come back per step; every step clamps at least one source.
    """
    cap = (F.col("source_size") * max_epochs).cast("double")
    rows = sources.withColumn("clamped__", F.lit(False))
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]
    level = 0.0
    while True:
        sums = rows.agg(
            F.coalesce(F.sum(F.when(F.col("clamped__"), cap)), F.lit(0.0)).alias("taken"),
            F.coalesce(F.sum(F.when(~F.col("clamped__"), F.col("weight"))), F.lit(0)).alias("open"),
        ).first()
        if not sums["open"]:
            break
        level = (total - sums["taken"]) / float(sums["open"])
        above = ~F.col("clamped__") & (F.col("weight") * F.lit(level) > cap)
        if rows.where(above).isEmpty():
            break
        rows = rows.withColumn("clamped__", F.col("clamped__") | above)
    target = F.when(F.col("clamped__"), cap).otherwise(F.col("weight") * F.lit(level))
    return rows.withColumn("target", target).drop("clamped__")


def mix(
    df: DataFrame,
    weights: DataFrame | None = None,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    seed: int = 42,
    max_epochs: int = MAX_EPOCHS,
) -> DataFrame:
    """Every document with its size, its source's size and target, ``copies`` and ``taken`` words.

    ``weights`` holds (source, weight); without it weights repeat 1, 2, 3.  Documents are summed
    by source and hash bucket before anything is moved, so a source with most rows is no larger
    than any other behind the shuffle: at most ``BUCKETS`` rows.
    """
    df = df.drop(*[c for c in df.columns if c.lower() in COLUMNS])
    bucket, src, b = (fresh_name(df, x) for x in ("bucket__", "source__", "b__"))
    label = F.coalesce(F.col(key).cast("string"), F.lit(""))
    place = F.shiftrightunsigned(F.xxhash64(label, F.lit(seed)), 48)
    docs = df.withColumns({"size": n_words(F.col(text)), bucket: place})
    buckets = stage(
        docs.groupBy(F.col(source).alias(src), F.col(bucket).alias(b)).agg(
            F.sum("size").alias("words")
        ),
        "mix-buckets",
    )
    sources = stage(buckets.groupBy(src).agg(F.sum("words").alias("source_size")), "mix-sources")
    if weights is None:
        weighted = cyclic_weights(sources, src)
    else:
        named = weights.select(F.col("source").alias("s"), "weight")
        weighted = sources.join(named, F.col(src).eqNullSafe(F.col("s")), "left").drop("s")
        weighted = weighted.withColumn("weight", F.coalesce("weight", F.lit(0)))
    filled = stage(water_fill(stage(weighted, "mix-weights"), max_epochs), "mix-targets")
    plan = buckets.join(
        filled.withColumnRenamed(src, "s"), F.col(src).eqNullSafe(F.col("s"))
    ).drop("s")
    # floating point must not turn a full number of epochs into one less
    epochs = F.floor(F.col("target") / F.greatest("source_size", F.lit(1)) + 1e-9)
    plan = plan.withColumns(
        {
            "whole": epochs.cast("int"),
            "open": F.col("target") - epochs * F.col("source_size"),
            "extra": F.lit(0),
        }
    )
    own = Window.partitionBy(src)
    upto = own.orderBy(b).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for _ in range(FILLS):
        left = F.col("open") - F.coalesce(F.sum(F.when(F.col("extra") == 1, F.col("words"))).over(own), F.lit(0))
        plan = plan.withColumn("left", left)
        fits = (F.col("extra") == 0) & (F.col("words") > 0) & (F.col("words") <= F.col("left"))
        plan = plan.withColumn("run", F.sum(F.when(fits, F.col("words")).otherwise(0)).over(upto))
        plan = plan.withColumn(
            "extra", F.when(fits & (F.col("run") <= F.col("left")), 1).otherwise(F.col("extra"))
        )
    # one more bucket where it ends nearer to the target
    left = F.col("open") - F.coalesce(F.sum(F.when(F.col("extra") == 1, F.col("words"))).over(own), F.lit(0))
    plan = plan.withColumn("left", left)
    near = (F.col("extra") == 0) & (F.col("words") > 0) & (F.col("words") < 2 * F.col("left"))
    best = F.min(F.when(near & (F.col("whole") < max_epochs), F.struct("words", F.col(b).alias("b")))).over(own)
    plan = plan.withColumn("best", best)
    plan = plan.withColumn(
        "extra", F.when(F.col("best.b") == F.col(b), 1).otherwise(F.col("extra"))
    )
    chosen = plan.select(
        src, b, "source_size", "target", (F.col("whole") + F.col("extra")).alias("copies")
    )
    at = F.col(source).eqNullSafe(F.col(src)) & (F.col(bucket) == F.col(b))
    out = docs.alias("d").join(chosen.hint("shuffle_hash"), at, "left")
    return out.select(
        *[F.col(f"d.`{c}`") for c in df.columns],
        F.col("d.size").alias("size"),
        "source_size",
        "target",
        "copies",
        (F.col("d.size") * F.col("copies")).cast("bigint").alias("taken"),
    )
