"""How well answers are supported by their contexts: whole answers and single claims."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bands import assessment_band, is_hallucination
from ..functions.text import clip, exploded, extract_claims, tokens
from ..functions.vectors import sparse_cosine, token_cosine

# Fixed values
SHOWN_CHARS = 200
METHODS = ("max_similarity", "average", "weighted_average")

CONTEXT_BLOCK = 1000

PairScore = Callable[[Column, Column], Column]


def _with_contexts(responses: DataFrame, contexts: DataFrame, block: int) -> DataFrame:
    """Left join of responses and contexts on ``response_id``.

    Contexts are joined in blocks of ``block`` positions: a response with very many contexts
    meets them in as many tasks as it has blocks, instead of one.
    """
    last = contexts.groupBy("response_id").agg(F.max("pos").alias("_last"))
    blocks = F.floor(F.coalesce("_last", F.lit(0)) / block).cast("int")
    spread = (
        responses.join(last, "response_id", "left")
        .withColumn("_block", F.explode(F.sequence(F.lit(0), blocks)))
        .drop("_last")
    )
    placed = contexts.withColumn("_block", F.floor(F.col("pos") / block).cast("int"))
    return spread.join(placed, ["response_id", "_block"], "left").drop("_block")


def score_pairs(
    responses: DataFrame,
    contexts: DataFrame,
    similarity: PairScore = sparse_cosine,
    left: str = "response",
    right: str = "context",
    block: int = CONTEXT_BLOCK,
) -> DataFrame:
    """One row per response and context with its ``score``; responses without context stay.

    ``responses``: ``(response_id, response)``; ``contexts``: ``(response_id, pos, context)``,
    ``pos`` from 0.  ``similarity`` works on the columns ``left`` and ``right`` (texts, or
    embeddings that came along).
    """
    pairs = _with_contexts(responses, contexts, block)
    # null text scores 0, no context scores null
    score = F.coalesce(similarity(F.col(left), F.col(right)), F.lit(0.0))
    return pairs.withColumn("score", F.when(F.col("pos").isNotNull(), score))


def assess_response(
    pairs: DataFrame, method: str = "max_similarity", mode: str = "fixed"
) -> DataFrame:
    """One row per response from the rows of :func:`score_pairs`.

    ``overall_score`` by ``method`` (an unknown one means the maximum), the best context (first
    among scores equal at six decimals; its start is shown), the flag and the assessment text.  A response without contexts
    scores 0.  Weights are lengths of whole contexts; ``compat`` weighs by what is shown.
    """
    shown = clip("context", SHOWN_CHARS)
    weight = F.length(shown if mode == "compat" else "context").cast("double")
    overall = {
        "average": F.avg("score"),
        "weighted_average": F.sum(F.col("score") * weight) / F.sum(weight),
    }.get(method, F.max("score"))
    best = F.when(
        # at six decimals, so the order of summation decides nothing
        F.col("score").isNotNull(),
        F.struct(F.round("score", 6).alias("score"), (-F.col("pos")).alias("neg_pos")),
    )
    out = pairs.groupBy("response_id").agg(
        F.count("score").alias("contexts"),
        overall.alias("_overall"),
        F.max_by(shown, best).alias("_best"),
    )
    return out.select(
        "response_id",
        "contexts",
        F.coalesce("_overall", F.lit(0.0)).alias("overall_score"),
        F.coalesce("_best", F.lit("")).alias("max_similar_chunk"),
        is_hallucination("_overall").alias("is_hallucination"),
        assessment_band("_overall").alias("assessment"),
    )


def semantic_similarity_run(
    responses: DataFrame,
    contexts: DataFrame,
    method: str = "max_similarity",
    similarity: PairScore = sparse_cosine,
) -> DataFrame:
    """Score and assess in one call; the frame form of a batch of responses."""
    return assess_response(score_pairs(responses, contexts, similarity), method)


batch_assess = semantic_similarity_run


def claim_rows(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """One row per claim: keys, ``claim_no`` (from 0), ``claim``."""
    return exploded(df, keys, extract_claims(text), "claim_no", "claim")


def score_claims(
    responses: DataFrame, contexts: DataFrame, block: int = CONTEXT_BLOCK
) -> DataFrame:
    """``(response_id, claim_no, claim, score)``: the best context of every claim.

    A context is compared with all claims of its response inside its own row, so the texts are
    never multiplied; what is shuffled afterwards are numbers, one per claim and partition.
    """
    prepared = responses.select("response_id", extract_claims("response").alias("claims"))
    words = prepared.withColumn(
        "_words", F.transform("claims", lambda c: F.sort_array(tokens(c)))
    )
    pairs = _with_contexts(
        words.select("response_id", "_words"),
        contexts.select(
            "response_id", "pos", F.sort_array(tokens("context")).alias("_context")
        ),
        block,
    )
    no_words = F.array().cast("array<string>")
    cosines = F.transform(
        "_words",
        lambda w: F.when(F.col("pos").isNull(), F.lit(0.0)).otherwise(
            token_cosine(w, F.coalesce("_context", no_words))
        ),
    )
    scored = exploded(pairs, ["response_id"], cosines, "claim_no", "score")
    best = scored.groupBy("response_id", "claim_no").agg(F.max("score").alias("score"))
    claims = exploded(prepared, ["response_id"], "claims", "claim_no", "claim")
    return claims.join(best, ["response_id", "claim_no"])


def flag_claims(claim_scores: DataFrame) -> DataFrame:
    """Add ``is_hallucination`` to each claim of :func:`score_claims`."""
    return claim_scores.withColumn("is_hallucination", is_hallucination("score"))


def assess_claims(responses: DataFrame, claim_scores: DataFrame) -> DataFrame:
    """Claims per response, how many are unsupported, their mean score (0 without claims)."""
    per = claim_scores.groupBy("response_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(is_hallucination("score")).alias("_bad"),
        F.avg("score").alias("_mean"),
    )
    zero = F.lit(0).cast("long")
    return (
        responses.select("response_id")
        .join(per, "response_id", "left")
        .select(
            "response_id",
            F.coalesce("_n", zero).alias("total_claims"),
            F.coalesce("_bad", zero).alias("hallucinated_claims"),
            F.coalesce("_mean", F.lit(0.0)).alias("avg_claim_score"),
        )
    )
