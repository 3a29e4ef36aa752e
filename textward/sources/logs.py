"""Result logs: export of decisions as text, and reading them back in blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stage

# The log line format and the words looked for in it.
LEVEL = "RESULTS"
LINE_PREFIX = "Time: "
LEVEL_PREFIX = f" - Level: {LEVEL} - "
MARKER = "Malicious:"
PROMPT = "Prompt:"
FILTERED_WORD = "Filtered"

# A record is a prefixed line with the lines that continue it.
_RECORD = rf"(?s)^(?:{LINE_PREFIX})?(.+?) - Level: (\w+) - (.*?)\n?$"
_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss,SSS"


def log_line(message: Column, ts: Column) -> Column:
    """One line in the log format."""
    stamp = F.date_format(ts, _TIME_FORMAT)
    return F.concat(F.lit(LINE_PREFIX), stamp, F.lit(LEVEL_PREFIX), message)


def render_log(decisions: DataFrame) -> DataFrame:
    """Log text of an evaluation run, one entry per decision.

    Takes ``(text, attack_type, malicious, reason, gate, ts)``: the prompt, its type and truth,
    then the reason of the filter or a line that it passed.
    """
    ts = F.col("ts")
    truth = F.when(F.col("malicious"), "True").otherwise("False")
    verdict = F.coalesce("reason", F.lit("Passed Overall_Score"))
    lines = [
        log_line(F.concat(F.lit(PROMPT), F.coalesce("text", F.lit(""))), ts),
        log_line(F.concat(F.lit("Attack Type: "), F.coalesce("attack_type", F.lit(""))), ts),
        log_line(F.concat(F.lit(MARKER + " "), truth), ts),
        log_line(verdict, ts),
    ]
    return decisions.select(F.concat_ws("\n", *lines).alias("value"))


def write_log(decisions: DataFrame, path: str) -> None:
    """Export as text files."""
    render_log(decisions).write.mode("overwrite").text(path)


def read_results_log(spark: SparkSession, path: str) -> DataFrame:
    """Log records as ``(ts, level, message)``; a message keeps its line breaks.

    The text source cuts at the prefix of a line, so files stay splittable.  What stands before
    the first prefix has null ``ts`` and ``level``.  A missing path is an error of the read.
    """
    records = spark.read.option("lineSep", "\n" + LINE_PREFIX).text(path)
    hit = F.col("value").rlike(_RECORD)
    part = lambda i: F.when(hit, F.regexp_extract("value", _RECORD, i))
    return records.select(
        F.try_to_timestamp(part(1), F.lit(_TIME_FORMAT)).alias("ts"),
        part(2).alias("level"),
        F.coalesce(part(3), F.col("value")).alias("message"),
    )


def log_blocks(spark: SparkSession, path: str, mode: str = "fixed") -> DataFrame:
    """``(malicious, is_filtered)`` per evaluated prompt of a log.

    The text source cuts records at the marker instead of at line ends, so a record *is* a
    block.  Files stay splittable: no file is read as a whole and no window runs over it.

    ``fixed``: the marker counts only right after the line prefix, and the block ends at the
    next prompt line.  ``compat``: every marker counts and the block runs to the next marker.
    """
    if mode not in ("fixed", "compat"):
        raise ValueError(f"mode must be fixed or compat, found {mode!r}")
    cut = MARKER if mode == "compat" else LEVEL_PREFIX + MARKER
    blocks = spark.read.option("lineSep", cut).text(path)
    body = F.col("value")
    if mode == "fixed":
        following = rf"(?s)\n{LINE_PREFIX}[^\n]*?{LEVEL_PREFIX}{PROMPT}.*"
        body = F.regexp_replace(body, following, "")
    truth = r"^ (True|False)"
    # what stands before the first marker of a file has no truth value and drops out
    return blocks.where(F.col("value").rlike(truth)).select(
        (F.regexp_extract("value", truth, 1) == "True").alias("malicious"),
        body.contains(FILTERED_WORD).alias("is_filtered"),
    )


def log_blocks_by_line(spark: SparkSession, path: str, mode: str = "fixed") -> DataFrame:
    """As :func:`log_blocks`, for logs whose blocks may be of any length.

    Lines are read split by split, and only what counts is kept of them: marker, truth, prompt
    line, filtered.  Markers are counted in each split, a prefix sum over the splits of a file says
    where each of them starts, and a running count inside the split numbers its blocks.  So a block
    may reach over many splits, and a log without any marker is read in bounded memory.  What must
    fit a task is a line, and the marked lines of one split.  Files are told apart.
    """
    if mode not in ("fixed", "compat"):
        raise ValueError(f"mode must be fixed or compat, found {mode!r}")
    cut = MARKER if mode == "compat" else LEVEL_PREFIX + MARKER
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        # grows along a split
        F.monotonically_increasing_id().alias("line"),
        "value",
    )
    pieces = lines.select(
        "file", "split", "line", F.posexplode(F.split("value", rf"\Q{cut}\E", -1)).alias("piece", "body")
    )
    truth = F.regexp_extract("body", r"^ (True|False)", 1)
    prompt = (F.col("piece") == 0) & F.col("body").rlike(rf"^{LINE_PREFIX}.*?{LEVEL_PREFIX}{PROMPT}")
    flags = pieces.select(
        "file", "split", "line", "piece",
        (F.col("piece") > 0).cast("long").alias("marker"),
        (prompt if mode == "fixed" else F.lit(False)).cast("long").alias("prompt"),
        F.when(F.col("piece") > 0, truth).otherwise("").alias("truth"),
        F.col("body").contains(FILTERED_WORD).alias("filtered"),
    )
    flags = stage(flags.where("marker + prompt > 0 OR filtered"), "log-lines")
    # one row per split of a file
    totals = flags.groupBy("file", "split").agg(F.sum("marker").alias("_m"), F.sum("prompt").alias("_p"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    starts = totals.select(
        "file", "split",
        F.coalesce(F.sum("_m").over(earlier), zero).alias("_m"),
        F.coalesce(F.sum("_p").over(earlier), zero).alias("_p"),
    )
    inside = Window.partitionBy("file", "split").orderBy("line", "piece").rowsBetween(Window.unboundedPreceding, 0)
    numbered = (
        flags.withColumns({"_rm": F.sum("marker").over(inside), "_rp": F.sum("prompt").over(inside)})
        .join(starts, ["file", "split"])
        .select(
            "file", (F.col("_m") + F.col("_rm")).alias("block"), (F.col("_p") + F.col("_rp")).alias("prompts"),
            "truth", "filtered",
        )
    )
    # up to the next prompt line: the rows of a block with as many prompts before them as its marker
    parts = numbered.groupBy("file", "block", "prompts").agg(
        F.max("truth").alias("truth"), F.max("filtered").alias("filtered")
    )
    first = parts.groupBy("file", "block").agg(F.min_by(F.struct("truth", "filtered"), "prompts").alias("s"))
    return first.where("s.truth <> ''").select(
        (F.col("s.truth") == "True").alias("malicious"), F.col("s.filtered").alias("is_filtered")
    )
