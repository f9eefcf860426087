"""Operators for preparing training data, with their queries.

Nothing outside this folder imports it; ``__spark_entry__`` adds ``QUERIES`` when it is there.
"""

from calorix.llm import (
    centroid_clusters,
    chat_format,
    contamination,
    hard_negatives,
    jaccard_join,
    minhash_dedup,
    packing,
    page_text,
    phrase_dedup,
    quality_rules,
    substring_dedup,
    toxicity,
    url_filter,
)
from calorix.llm.base import QUERIES

__all__ = [
    "QUERIES",
    "centroid_clusters",
    "chat_format",
    "contamination",
    "hard_negatives",
    "jaccard_join",
    "minhash_dedup",
    "packing",
    "page_text",
    "phrase_dedup",
    "quality_rules",
    "substring_dedup",
    "toxicity",
    "url_filter",
]
