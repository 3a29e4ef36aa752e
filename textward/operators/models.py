"""Plug-in points for models: scorers, embedders, recognisers, generators.

A factory is called once per Python worker and returns a function over a batch of texts.  Texts
travel as Arrow batches; null texts never reach the model, which is how rows already decided are
kept away from it (a CASE WHEN around a Python UDF would not do that).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ScreeningPolicy
from ..functions.text import SPAN_TYPE, let
from ..functions.vectors import hash_counts, unit_length
from . import gates

BatchFn = Callable[[Sequence[str]], Sequence[Any]]
Factory = Callable[[], BatchFn]
ColumnFn = Callable[[Column], Column]


def _scalar_udf(factory: Factory, return_type: T.DataType, fill: Any, batch_size: int):
    def make():
        fn = factory()

        def predict(texts: np.ndarray) -> np.ndarray:
            some = np.array([isinstance(t, str) for t in texts], dtype=bool)
            out = np.full(len(texts), fill, dtype=object if fill is None else float)
            if some.any():
                out[some] = np.asarray(fn([t for t in texts if isinstance(t, str)]), out.dtype)
            return out

        return predict

    return predict_batch_udf(make, return_type=return_type, batch_size=batch_size)


def _in_pieces(factory: Factory, max_words: int) -> Factory:
    """A scorer of whole texts from one that takes ``max_words`` words at a time."""

    def make():
        fn = factory()

        def highest(texts):
            pieces, owner = [], []
            for i, text in enumerate(texts):
                words = text.split()
                if len(words) <= max_words:
                    pieces.append(text)
                    owner.append(i)
                    continue
                for k in range(0, len(words), max_words):
                    pieces.append(" ".join(words[k : k + max_words]))
                    owner.append(i)
            out = np.full(len(texts), -np.inf)
            np.maximum.at(out, owner, np.asarray(fn(pieces), float))
            return out

        return highest

    return make


def register_scorer(
    spark: SparkSession,
    name: str,
    factory: Factory,
    max_words: int | None = None,
    batch_size: int = 256,
) -> ColumnFn:
    """Make a text scorer usable as a column function and, under ``name``, in SQL.

    ``max_words`` is the input limit of the model, where it has one: a longer text is scored in
    pieces of that length, and the highest score is its score.
    """
    factory = factory if max_words is None else _in_pieces(factory, max_words)
    udf = _scalar_udf(factory, T.DoubleType(), np.nan, batch_size)
    spark.udf.register(name, udf)

    def score(text: Column) -> Column:
        return F.nanvl(udf(text), F.lit(None).cast("double"))

    return score


def register_generator(
    spark: SparkSession, name: str, factory: Factory, batch_size: int = 64
) -> ColumnFn:
    """Prompt to answer."""
    udf = _scalar_udf(factory, T.StringType(), None, batch_size)
    spark.udf.register(name, udf)
    return lambda prompt: udf(prompt)


def register_embedder(
    spark: SparkSession, name: str, factory: Factory, dims: int, batch_size: int = 256
) -> ColumnFn:
    """Text to a vector of ``dims`` floats; null text gives null."""

    def make():
        fn = factory()

        def predict(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), dims), dtype=np.float32)
            some = np.array([isinstance(t, str) for t in texts], dtype=bool)
            if some.any():
                out[some] = np.asarray(fn([t for t in texts if isinstance(t, str)]), np.float32)
            return out

        return predict

    udf = predict_batch_udf(
        make, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size
    )
    spark.udf.register(name, udf)
    return lambda text: F.when(text.isNotNull(), udf(text))


def register_recogniser(spark: SparkSession, name: str, factory: Factory) -> ColumnFn:
    """Text to entities, each a dict ``{text, label, start, end, score}``."""
    cache: dict[str, BatchFn] = {}

    @F.pandas_udf(SPAN_TYPE)
    def recognise(texts: pd.Series) -> pd.Series:
        if name not in cache:
            cache[name] = factory()
        some = texts.notna()
        out = pd.Series([[] for _ in range(len(texts))], index=texts.index, dtype=object)
        if some.any():
            found = cache[name](list(texts[some]))
            for i, spans in zip(texts.index[some], found, strict=True):
                out.at[i] = list(spans)
        return out

    spark.udf.register(name, recognise)
    return lambda text: recognise(text)


def screen_with_models(
    df: DataFrame,
    policy: ScreeningPolicy | None = None,
    toxicity: ColumnFn | None = None,
    injection: ColumnFn | None = None,
    text: str = "text",
    gate_order: str = "declared",
    **native: Any,
) -> DataFrame:
    """The input chain with model scorers; a model sees only rows still undecided before it.

    ``declared``: a row is kept from a model when an *earlier* gate filters it, so the deciding
    gate is that of the plain chain.  ``native_first``: all native gates come before the models,
    which saves more calls; the action is the same, the deciding gate may be another.
    One pass over the rows: nothing is cached and no branch is computed twice.
    """
    if gate_order not in ("declared", "native_first"):
        raise ValueError(f"unknown gate order {gate_order!r}")
    policy = policy or ScreeningPolicy()
    off = F.lit(0.0)
    scored = gates.with_scores(
        df, policy, text=text,
        toxicity=off if toxicity else None, injection=off if injection else None, **native,
    )
    modelled = {
        g for g, m in ((gates.TOXICITY, toxicity), (gates.INJECTION, injection)) if m is not None
    }
    chain = [g for g in gates.INPUT_GATES if g != gates.OVERALL]
    if gate_order == "native_first":
        chain = [g for g in chain if g not in modelled] + [g for g in chain if g in modelled]

    def undecided(gate: str) -> Column:
        table = gates.gate_table(policy)
        stop = F.lit(False)
        for earlier in chain[: chain.index(gate)]:
            state = gates.decide_action(*table[earlier], earlier, policy)
            stop = stop | F.coalesce(state == gates.FILTER, F.lit(False))
        return F.when(~stop, F.col(text))

    if toxicity and policy.threshold_toxicity > 0:
        score = toxicity(undecided(gates.TOXICITY))
        scored = scored.withColumn("toxicity", F.coalesce(score, off))
    injection_on = policy.mode == "compat" or policy.threshold_injection >= 0
    if injection and injection_on:
        score = injection(undecided(gates.INJECTION))
        scored = scored.withColumn("injection", F.coalesce(score, off))
    return gates.decide(scored, policy, (*chain, gates.OVERALL))


def toxicity_pipeline(n_features: int = 1 << 14) -> Pipeline:
    """Bag-of-words logistic regression on ``text`` and ``label`` columns."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[^\p{L}0-9]+"),
            HashingTF(inputCol="words", outputCol="tf", numFeatures=n_features),
            IDF(inputCol="tf", outputCol="tfidf"),
            LogisticRegression(featuresCol="tfidf", labelCol="label", maxIter=10, regParam=0.01),
        ]
    )


def fit_toxicity(labelled: DataFrame) -> PipelineModel:
    """Fit on rows ``(text, toxic)``."""
    return toxicity_pipeline().fit(
        labelled.select("text", F.col("toxic").cast("double").alias("label"))
    )


def predict_toxicity(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``toxicity``, the probability of the toxic class."""
    out = model.transform(df)
    return out.select(
        *df.columns, F.element_at(vector_to_array("probability"), 2).alias("toxicity")
    )


def text_features(df: DataFrame, dims: int = 64, text: str = "text") -> DataFrame:
    """Add ``embedding``: unit tf-idf vectors, the fallback where no embedder is at hand.

    Words are folded into slots by hash; a slot weighs log((texts + 1) / (texts with it + 1)).
    The statistics are one row of ``dims`` counts.
    """
    counted = df.withColumn("_tf", hash_counts(F.coalesce(F.col(text), F.lit("")), dims))
    with_slot = [F.count_if(F.col("_tf")[i] > 0).alias(f"s{i}") for i in range(dims)]
    seen = counted.agg(F.count(F.lit(1)).alias("n"), *with_slot).first()
    idf = F.array(*[F.lit(math.log((seen["n"] + 1) / (seen[f"s{i}"] + 1))) for i in range(dims)])
    weighted = F.zip_with("_tf", idf, lambda n, w: n * w)
    return counted.withColumn("embedding", let(weighted, unit_length)).drop("_tf")
