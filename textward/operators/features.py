"""Text features by word: a vocabulary kept as a table and sparse tf-idf vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import _col, let, tokens
from ..session import stage
from .evalset import eval_batches
from .skew import join_hot


def counted_words(text: Column | str) -> Column:
    """The distinct words of a text as ``(word, n)``, in the order of the words."""

    def runs(words: Column) -> Column:
        # places from 1 where a run of equal words ends
        last = F.filter(
            F.sequence(F.lit(1), F.size(words)), lambda i: ~F.get(words, i - 1).eqNullSafe(F.get(words, i))
        )

        def counted(ends: Column) -> Column:
            def term(end: Column, i: Column) -> Column:
                n = end - F.coalesce(F.get(ends, i - 1), F.lit(0))
                return F.struct(F.get(words, end - 1).alias("word"), n.cast("bigint").alias("n"))

            return F.transform(ends, term)

        return F.when(F.size(words) > 0, let(last, counted))

    return let(F.sort_array(tokens(F.coalesce(_col(text), F.lit("")))), runs)


def word_counts(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(key, word, n)``: how often each word stands in each text; null text has none.

    Words are counted in their row, so nothing is shuffled.  Texts that share a key, or have
    none, count as one text; only those are grouped.
    """
    several = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    several = stage(several.where("_n > 1").select("_key"), "repeated-keys")
    again = F.col(key).eqNullSafe(F.col("_key"))
    single = df if several.isEmpty() else df.join(several, again, "left_anti")
    # the outer form, as in exploded(): the words are counted once
    terms = single.select(key, F.explode_outer(counted_words(text)).alias("_t")).where("_t IS NOT NULL")
    counts = terms.select(key, "_t.word", "_t.n")
    if single is df:
        return counts
    shared = df.join(several, again, "left_semi")
    words = shared.select(key, F.explode(tokens(F.coalesce(F.col(text), F.lit("")))).alias("word"))
    return counts.unionByName(words.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n")))


def vocabulary(counts: DataFrame, texts: int) -> DataFrame:
    """``(word_id, word, texts, idf)`` with ids from 1 in a repeatable order, without a global sort.

    ``idf`` is log((texts + 1) / (texts with the word + 1)), with ``texts`` of the whole corpus.
    """
    seen = counts.groupBy("word").agg(F.count(F.lit(1)).alias("texts"))
    numbered = eval_batches(seen, "word").withColumnRenamed("row_no", "word_id")
    idf = F.log((F.lit(texts) + 1.0) / (F.col("texts") + 1.0))
    return numbered.select("word_id", "word", "texts", idf.alias("idf"))


def word_vectors(
    df: DataFrame, key: str, text: str = "text", words: DataFrame | None = None
) -> DataFrame:
    """``(key, terms)``: unit tf-idf vectors as ``(word_id, word, weight)`` sorted by ``word_id``.

    ``words`` is the vocabulary of another corpus (words it lacks have no weight); by default it
    is made of the texts themselves.  A row holds the distinct words of one text; a word found in
    very many texts is spread over tasks.  Texts without words have an empty vector.  ``key`` must
    be unique and not null.
    """
    counts = stage(word_counts(df, key, text), "word-counts", "zstd")
    if words is None:
        words = stage(vocabulary(counts, df.count()), "vocabulary")
    weighted = join_hot(counts, words.select("word_id", "word", "idf"), "word", key)
    term = F.struct("word_id", "word", (F.col("n") * F.col("idf")).alias("weight"))
    # rows come word by word: dealt as they are they take less room than in lists by text
    vectors = weighted.select(key, term.alias("_t")).repartition(key)
    vectors = vectors.groupBy(key).agg(F.sort_array(F.collect_list("_t")).alias("terms"))

    def scaled(terms):
        squares = F.aggregate(terms, F.lit(0.0), lambda a, t: a + t["weight"] * t["weight"])
        return let(
            F.sqrt(squares),
            lambda size: F.transform(
                terms,
                lambda t: t.withField("weight", F.when(size > 0, t["weight"] / size).otherwise(t["weight"])),
            ),
        )

    none = F.array().cast("array<struct<word_id:bigint,word:string,weight:double>>")
    out = df.select(key).join(vectors, key, "left")
    return out.select(key, let(F.coalesce("terms", none), scaled).alias("terms"))


def top_terms(terms: str, k: int = 5):
    """The ``k`` words of most weight (six decimals), then in the order of the words."""
    ranked = F.transform(
        terms, lambda t: F.struct((-F.round(t["weight"], 6)).alias("w"), t["word"].alias("word"))
    )
    return F.transform(F.slice(F.sort_array(ranked), 1, k), lambda t: t["word"])
