"""Thresholds and switches, with the defaults of production."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    chunk_words: int = 512
    chunk_overlap: int = 50
    shortlist_similarity: float = 0.30
    shortlist_documents: int = 25
    seed_claims: int | None = 100  # None: all
    gate_similarity: float = 0.75
    gate_sample: float = 0.05
    top_k: int = 5
    retrieve_k: int = 10
    shared_terms: int = 1
    chunk_similarity: float = 0.60
    chunk_partners: int = 5
    verdict: float = 0.70
    entity_similarity: float = 0.65
    attribute_similarity: float = 0.55
    contradiction: float = 0.80
    contradiction_uneven: float = 0.85
    uneven_ratio: float = 2.0
    borderline: float = 0.65
    structured: float = 0.65
    alignment: float = 0.70
    dedup_similarity: float = 0.93
    hybrid_weight: float = 0.6
    lineage_similarity: float = 0.85
    dependency: float = 0.15
    dependency_similarity: float = 0.70
    impact_depth: int = 3
    half_life_days: float = 90.0
    table_cells: int = 400


DEFAULT = Config()
#: Calibrated for the driver's 64-dimensional vectors, whose largest cosine between two rows is about 0.5.
DRIVER_VECTORS = Config(shortlist_similarity=0.30, gate_similarity=0.40, dedup_similarity=0.40, dependency_similarity=0.25)
