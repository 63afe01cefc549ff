"""Settings that define semantics, and their defaults.  Every time-dependent operator also takes `as_of`."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    backfill_days: int = 7
    backfill_buffer_days: int = 1
    retention_days: int = 90
    least_retention_days: int = 30
    fuzzy: bool = True
    review_from: float = 0.4
    review_to: float = 0.6
    order_min_confidence: float = 0.6
    order_min_relevance: int = 60
    freshness_days: int = 7
    ml_min_confidence: float = 0.7
    semantic_merge: float = 0.90
    semantic_review: float = 0.82
    semantic_window_days: int = 7
    semantic_candidates: int = 20
    weight_need: float = 0.18
    weight_task: float = 0.16
    weight_budget: float = 0.14
    weight_deadline: float = 0.08
    weight_contact: float = 0.10
    weight_niche: float = 0.14
    weight_freshness: float = 0.08
    weight_p_client: float = 0.12
    weight_ad: float = 0.10
    weight_spam: float = 0.10


DEFAULT = Settings()
