"""Settings with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    auto_merge_enabled: bool = False
    fuzzy_name_threshold: float = 0.92
    node_similarity_threshold: float = 0.7
    node_similarity_top_k: int = 5
    embedding_threshold: float = 0.90
    embedding_top_k: int = 3
    embedding_name_min: float = 0.45
    embedding_cross_country_only: bool = True
    #: A vector index may report (1 + cosine) / 2 instead of the cosine.
    embedding_score: str = "raw"
    fulltext_limit: int = 20
    #: Tokens that more names hold are stop words: they neither retrieve nor score. None: there are none.
    fulltext_max_df: int | None = None
    resolver_min_name: int = 6
    resolver_fulltext_floor: float = 4.0
    #: Leave out of the cluster merge what a reviewer kept apart as related.
    exclude_kept: bool = False
