"""Defaults that are part of the operators' meaning."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    k1: float = 1.5
    b: float = 0.75
    rrf_k: int = 60
    pool: int = 20
    leg_k: int = 10
    context_chunks: int = 5
    context_budget: int = 900
    similarity: float = 0.85
    embedding_novelty: float = 0.93
    evidence_coverage: float = 0.5
    evidence_terms: int = 2
    topic_floor: float = 0.45
    max_retries: int = 3
    rerank: tuple[float, float, float, float] = (0.4, 0.25, 0.15, 0.2)
    fusion: dict = field(default_factory=lambda: {"vector": 0.5, "graph": 0.1, "concept": 0.15, "topic": 0.15, "provenance": 0.1})


DEFAULT = Config()
