"""All tunables in one frozen tree with a fingerprint that runs record."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Dedup:
    permutations: int = 128
    shingle: int = 5
    jaccard: float = 0.88
    campaign_min_size: int = 20
    campaign_min_signals: int = 3
    burstiness: float = 3.0
    concentration_ratio: float = 1.5
    boilerplate: float = 0.50
    length_cv: float = 0.20


@dataclass(frozen=True)
class Cluster:
    fit_sample: int = 500_000
    assign_max_distance: float = 0.35
    related: float = 0.80


@dataclass(frozen=True)
class Novelty:
    weights: tuple[float, float] = (0.5, 0.5)
    threshold: float = 0.60
    coherence: float = 0.45
    persistence: float = 0.05

    def __post_init__(self):
        if abs(sum(self.weights) - 1) > 1e-9:
            raise ValueError("novelty weights must sum to 1")


@dataclass(frozen=True)
class Signals:
    min_a: int = 5
    fdr: float = 0.05
    ewma_lambda: float = 0.2
    ewma_width: float = 3.0
    ewma_baseline: int = 12
    pelt_penalty: float = 10.0
    min_supporting_groups: int = 15
    rank_by: str = "eb05"


@dataclass(frozen=True)
class Retrieval:
    top_k: int = 10
    candidate_k: int = 50
    rrf_k: int = 60


@dataclass(frozen=True)
class Config:
    window_start: str = "2015-01-01"
    cutoffs: tuple[str, ...] = tuple(f"{y}-01-01" for y in range(2017, 2025))
    seed: int = 20260803
    dedup: Dedup = field(default_factory=Dedup)
    cluster: Cluster = field(default_factory=Cluster)
    novelty: Novelty = field(default_factory=Novelty)
    signals: Signals = field(default_factory=Signals)
    retrieval: Retrieval = field(default_factory=Retrieval)

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(dataclasses.asdict(self), sort_keys=True).encode()).hexdigest()
