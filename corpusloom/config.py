"""Constants of ranking, graph and delivery in one frozen place. Plans read no environment and no clock."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    lane_top: int = 80
    rrf_k: int = 60
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    prior_cap: float = 0.15
    rerank_top: int = 50
    limit: int = 10
    comention: float = 1.05
    half_life_days: float = 14.0
    recency_weight: float = 0.2
    access_weight: float = 0.05
    path_token_least: int = 3
    path_hits_least: int = 2
    path_pins: int = 2
    chunk_words: int = 200
    chunk_overlap: int = 30
    head_bytes: int = 1 << 20
    stitch_overlap: int = 8192
    stitch_cap: int = 64 << 10
    entity_cap: int = 32
    direct_weight: float = 0.08
    neighbour_weight: float = 0.04
    community_weight: float = 0.05
    community_penalty: float = 0.03
    community_free: int = 24
    community_span: int = 72
    ppr_weight: float = 0.12
    ppr_restart: float = 0.5
    ppr_rounds: int = 30
    entity_files_least: int = 2
    entity_files_most: int = 64
    knn_neighbours: int = 6
    hub_quantile: float = 0.99
    god_nodes: int = 4
    adaptive_dominance: float = 0.30
    adaptive_cluster: float = 0.50
    adaptive_most: int = 10
    render_budget: int = 10 << 10
    hit_budget: int = 6 << 10


DEFAULT = Config()
