"""Knowledge base rows: pages to text, text to chunks, topics to pages, upsert by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import (
    CHUNK_SEPARATOR,
    MIN_CHUNK_CHARS,
    _col,
    chunk_text,
    content_id,
    exploded,
    strip,
)

# Markup removed with what it holds, then paragraph ends, then any other tag.
_DROPPED = r"(?is)<(?:script|style|nav|head)\b.*?</(?:script|style|nav|head)>|<!--.*?-->"
_BREAKS = r"(?i)</(?:p|div|h[1-6]|li|article|section)>|<br\s*/?>"
_TAGS = r"(?s)<[^>]*>"
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&"))


def _unescape(c: Column) -> Column:
    for entity, char in _ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def page_title(html: Column | str) -> Column:
    return strip(_unescape(F.regexp_extract(_col(html), r"(?is)<title>(.*?)</title>", 1)))


def page_content(html: Column | str) -> Column:
    """Visible text; paragraphs are parted by a blank line."""
    text = F.regexp_replace(_col(html), _DROPPED, "")
    text = F.regexp_replace(text, _BREAKS, CHUNK_SEPARATOR)
    return strip(_unescape(F.regexp_replace(text, _TAGS, "")))


def parse_pages(pages: DataFrame) -> DataFrame:
    """``(page_id, url, title, content)`` from raw pages."""
    return pages.select(
        "page_id",
        "url",
        page_title("html").alias("title"),
        page_content("html").alias("content"),
    )


def chunk_rows(
    df: DataFrame,
    text: str,
    *keys: str,
    separator: str = CHUNK_SEPARATOR,
    min_chars: int = MIN_CHUNK_CHARS,
    max_chunks: int | None = None,
) -> DataFrame:
    """One row per chunk: keys, ``chunk_no`` (from 0), ``text``, ``chunk_id``."""
    chunks = chunk_text(text, separator, min_chars, max_chunks)
    # keys may hold the source column; the exploded piece takes the name "text"
    rows = exploded(df, keys, chunks, "chunk_no", "_chunk")
    return rows.select(
        *[k for k in keys if k != "text"],
        "chunk_no",
        F.col("_chunk").alias("text"),
        content_id("_chunk").alias("chunk_id"),
    )


def normal_title(c: Column | str) -> Column:
    """Title for matching: lower case, single blanks, stripped."""
    return F.lower(strip(F.regexp_replace(_col(c), r"(?U)\s+", " ")))


def resolve_topics(topics: DataFrame, pages: DataFrame) -> DataFrame:
    """``(topic, page_id)`` for the distinct topics; null where no page fits.

    A page with exactly this title comes first, then the lowest page under the same normalised
    title.  Pages are reduced to one per title *before* the joins (a number, so with hash
    aggregation and partial minima), which keeps a title shared by many pages from fanning out.
    """
    wanted = topics.select("topic").where(F.col("topic").isNotNull()).distinct()
    titled = pages.select("page_id", "title").where(F.length("title") > 0)
    # one aggregate serves both joins, so titles are read from the pages once
    per_title = titled.groupBy("title").agg(F.min("page_id").alias("_exact"))
    exact = per_title.withColumnRenamed("title", "topic")
    loose = per_title.groupBy(normal_title("title").alias("_norm")).agg(
        F.min("_exact").alias("_loose")
    )
    return (
        wanted.withColumn("_norm", normal_title("topic"))
        .join(exact, "topic", "left")
        .join(loose, "_norm", "left")
        .select("topic", F.coalesce("_exact", "_loose").alias("page_id"))
    )


def unresolved_topics(topics: DataFrame, pages: DataFrame) -> DataFrame:
    """Distinct topics no page fits."""
    norms = pages.select(normal_title("title").alias("_norm")).distinct()
    return (
        topics.select("topic")
        .where(F.col("topic").isNotNull())
        .distinct()
        .withColumn("_norm", normal_title("topic"))
        .join(norms, "_norm", "left_anti")
        .select("topic")
    )


# What follows the main part of a title: a qualifier in brackets, after a comma, colon or full stop.
_QUALIFIER = r"(?s)\s*[(,:.].*$"


def main_title(c: Column | str) -> Column:
    """A title without its qualifier: ``Mercury (planet)`` gives ``Mercury``."""
    return F.regexp_replace(_col(c), _QUALIFIER, "")


def title_aliases(pages: DataFrame) -> DataFrame:
    """``(alias, page_id, title, options)``: the page each name stands for.

    Names are the normalised titles and their main parts.  Where several titles share a name it is
    ambiguous: ``options`` counts them, and the first option counts - a full title before a main
    part, then the smallest title, then its smallest page.
    """
    titled = pages.select("page_id", "title").where(F.length("title") > 0)
    per_title = titled.groupBy("title").agg(F.min("page_id").alias("page_id"))
    names = F.array(normal_title("title"), normal_title(main_title("title")))
    named = per_title.select("title", "page_id", F.posexplode(names).alias("kind", "alias"))
    # a title without qualifier has one name, not two
    once = named.where("alias <> ''").groupBy("alias", "title").agg(
        F.min(F.struct("kind", "title", "page_id")).alias("option")
    )
    first = once.groupBy("alias").agg(F.min("option").alias("first"), F.count(F.lit(1)).alias("options"))
    return first.select("alias", F.col("first.page_id").alias("page_id"), F.col("first.title").alias("title"), "options")


def name_topics(topics: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(topic, page_id, options)`` for the distinct topics some page goes by."""
    wanted = topics.select("topic").where(F.col("topic").isNotNull()).distinct()
    return (
        wanted.withColumn("alias", normal_title("topic"))
        .join(aliases, "alias")
        .select("topic", "page_id", "options")
    )


def ingest_topics(
    topics: DataFrame, pages: DataFrame, max_chunks: int | None = None, source: str = "pages"
) -> DataFrame:
    """Chunks of the page of each distinct topic: one job for the whole list."""
    titles = pages.select("page_id", page_title("html").alias("title"))
    resolved = resolve_topics(topics, titles).where(F.col("page_id").isNotNull())
    # join first: only pages some topic asks for are stripped of their markup
    hits = pages.select("page_id", "url", "html").join(resolved, "page_id")
    hits = hits.select("topic", "url", page_content("html").alias("content"))
    rows = chunk_rows(hits, "content", "topic", "url", max_chunks=max_chunks)
    return rows.withColumn("source", F.lit(source))


def latest(rows: DataFrame) -> DataFrame:
    """One row per ``chunk_id``: the last batch wins, then the lowest url.

    ``row_number() = 1`` lets Spark keep one row per chunk in every partition before the
    shuffle, so a chunk with very many copies does not gather in one task.
    """
    order = Window.partitionBy("chunk_id").orderBy(
        F.col("batch_no").desc(), F.col("url"), F.col("topic"), F.col("chunk_no")
    )
    return rows.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def upsert(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Insert or replace the chunks of ``batch`` (both sides carry ``batch_no``)."""
    return latest(stored.unionByName(batch))


def new_chunks(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """One row per chunk of the batch that is not stored yet: what still needs an embedding."""
    return latest(batch).join(stored.select("chunk_id").distinct(), "chunk_id", "left_anti")


def browse(kb: DataFrame, limit: int = 100) -> DataFrame:
    """The first records by id."""
    return kb.orderBy("chunk_id").limit(limit)
