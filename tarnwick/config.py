"""Default parameters; every operator takes them as arguments, nothing reads them behind its back."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    """The defaults that results depend on."""

    recall_k: int = 10
    final_k: int = 3
    rrf_k: int = 60
    weight_vector: float = 0.45
    weight_bm25: float = 0.35
    weight_kg: float = 0.20
    weight_neighbor: float = 0.10
    neighbor_window: int = 1
    neighbor_budget: int = 2
    route_min_score: float = 0.45
    route_min_margin: float = 0.10
    align_min_length: int = 4
    align_min_confidence: float = 0.55
    align_max_expansions: int = 4
    align_max_terms: int = 6
    chunk_size: int = 512
    chunk_overlap: int = 64
    breakpoint_percentile: float = 85.0
    window_size: int = 2
    min_chunk: int = 80
    max_chunk: int = 1200
    parent_min: int = 500
    parent_max: int = 2500
    child_min: int = 80
    child_max: int = 400
    max_parents: int = 5
    kg_top_k: int = 5
    kg_score_base: float = 0.4
    kg_triples_per_chunk: int = 8
    kg_min_similarity: float = 0.35
    kg_hops: int = 2
    kg_max_triples: int = 30
    metrics_history: int = 200
    rerank_cache: int = 10_000
    history_turns: int = 3
    history_budget: int = 400
    prompt_tokens: int = 32000
    output_tokens: int = 2048
    token_margin: int = 500
    judge_context_chars: int = 2000
    judge_answer_chars: int = 800
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    vector_dims: int = 64


def required(names: tuple[str, ...]) -> dict[str, str]:
    """The values of environment variables that must be there, such as the keys of a caller's models."""
    missing = [n for n in names if not os.environ.get(n)]
    if missing:
        raise ValueError("not set: " + ", ".join(missing))
    return {n: os.environ[n] for n in names}


def from_environment(prefix: str = "TARNWICK_", base: Settings = Settings()) -> Settings:  # noqa: B008
    """Settings with typed overrides from environment variables; a value that does not parse raises."""
    given = {f.name: type(getattr(base, f.name))(os.environ[prefix + f.name.upper()]) for f in fields(base) if prefix + f.name.upper() in os.environ}
    return replace(base, **given)


DEFAULTS = Settings()
