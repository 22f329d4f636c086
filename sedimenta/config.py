"""Parameter defaults of the operators, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Defaults:
    chunk_size: int = 500
    chunk_overlap: int = 100
    max_text_length: int = 500_000
    similarity_threshold: float = 0.9
    knn_k: int = 10
    edit_distance: int = 3
    string_threshold: float = 0.7
    nil_threshold: float = 0.6
    recall_k: int = 5
    conflict_threshold: float = 0.5
    min_group: int = 2
    entity_limit: int = 15
    candidates: int = 20
    final_k: int = 3
    rrf_k: int = 60
    fact_limit: int = 20
    table_limit: int = 5
    section_limit: int = 5
    period_days: int = 15
    faithfulness: float = 0.7
    context_cut: int = 3000
    scan_bytes: int = 100_000
    section_min_length: int = 200
    bm25_k1: float = 1.2
    bm25_b: float = 0.75


DEFAULTS = Defaults()
