"""Column expressions shared by batch and stream."""

from .bands import (
    assessment_band,
    distance_band,
    distance_points,
    is_hallucination,
    strong_enough,
)
from .text import (
    any_match,
    chunk_text,
    clean_topic,
    clip,
    content_id,
    extract_claims,
    extract_fenced,
    find_all,
    find_spans,
    flatten_list_text,
    hit_ends,
    is_filtered_marker,
    list_text_items,
    strip,
    tokens,
    unicode_pattern,
    valid_topic,
)
from .vectors import (
    cosine_similarity,
    dot,
    hash_embedding,
    max_probability,
    norm,
    sigmoid,
    softmax,
    sparse_cosine,
    token_cosine,
)

__all__ = [
    "any_match", "assessment_band", "chunk_text", "clean_topic", "clip", "content_id", "cosine_similarity",
    "distance_band", "distance_points", "dot", "extract_claims", "extract_fenced", "find_all",
    "find_spans", "flatten_list_text", "hash_embedding", "hit_ends", "is_filtered_marker",
    "is_hallucination", "list_text_items", "max_probability", "norm", "sigmoid", "softmax",
    "sparse_cosine", "strip", "strong_enough", "token_cosine", "tokens", "unicode_pattern",
    "valid_topic",
]
