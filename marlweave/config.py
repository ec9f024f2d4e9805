"""Settings of the engine, in one frozen place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Defaults of ranking, fusion and synthesis."""

    k1: float = 1.5
    b: float = 0.75
    idf_pow: float = 1.2
    title_weight: float = 4.0
    body_weight: float = 1.0
    memory_weight: float = 1.0
    lexical_weight: float = 0.8
    dense_weight: float = 1.0
    pool: int = 40
    vector_k: int = 20
    sem_ratio: float = 0.55
    sem_min: int = 4
    sem_max: int = 40
    mmr_lambda: float = 0.72
    evidence_k: int = 16
    rel_limit: int = 40
    seed_label_limit: int = 30
    neighbor_limit: int = 100
    instance_limit: int = 1000
    class_list_cap: int = 150
    graph_fusion: bool = True
    fusion_alpha: float = 0.9
    fusion_expand_top: int = 5
    fusion_neighbor_limit: int = 20
    fusion_direction: str = "out"
    system_prompt: str = "Answer from the evidence given; say so if it does not suffice."


DEFAULT = Config()
ISA = ("rdf:type", "subClassOf", "type", "instanceOf")
