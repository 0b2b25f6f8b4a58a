"""Settings of indexing, retrieval and ontology building; flags are positive."""

from __future__ import annotations

from dataclasses import dataclass, replace

from .functions.text import ATTRIBUTE_WORDS


@dataclass(frozen=True)
class Config:
    max_iterations: int = 3
    iteration_threshold: float = 0.5
    top_k_sentence: int = 1
    passage_ratio: float = 1.5
    passage_node_weight: float = 0.05
    damping: float = 0.5
    ppr_iterations: int = 30
    retrieval_top_k: int = 5
    matrix_propagation: bool = False
    attribute_fallback: bool = False
    attribute_boost: float = 0.25
    attribute_words: tuple[str, ...] = ATTRIBUTE_WORDS
    use_class_schema: bool = False
    edge_transition: bool = True  # class-aware search also reweights edges
    entity_classes_path: str = ""
    schema_state_path: str = ""
    query_type_cache_path: str = ""
    working_dir: str = "./import"
    chunk_tokens: int = 1000  # passages come cut; the three settings below describe them and the models, nothing else reads them
    chunk_overlap: int = 100
    embedding_model: str = "all-mpnet-base-v2"
    recogniser_model: str = "en_core_web_trf"
    encode_batch: int = 128
    schema_workers: int = 4
    llm_query_typing: bool = True
    overwrite_classes: bool = False
    max_classes: int = 4
    class_boost: float = 0.3
    class_prior: float = 0.3
    same_weight: float = 1.0
    descendant_weight: float = 0.9  # kept with the settings; compatibility is of equal classes only
    ancestor_weight: float = 0.5
    related_weight: float = 0.3
    edge_beta: float = 0.8
    edge_seed: float = 0.6
    edge_active: float = 0.4
    edge_two_hop: float = 0.4
    edge_min_compat: float = 0.01
    edge_max_boost: float = 2.5
    broadcast_limit: int = 2_000_000  # edges of a graph that may be sent to every task

    def __post_init__(self) -> None:
        if self.max_iterations < 1 or self.top_k_sentence < 1 or self.retrieval_top_k < 1 or not 0 < self.damping < 1:
            raise ValueError("iterations, top-k and damping must be positive")


#: Settings of the named datasets.
PROFILES = {
    "default": Config(),
    "medical": Config(max_iterations=3, passage_ratio=1.5, iteration_threshold=0.5, top_k_sentence=1),
    "musique": Config(max_iterations=5, passage_ratio=2.0, iteration_threshold=0.1, top_k_sentence=4),
    "2wikimultihop": Config(max_iterations=3, passage_ratio=0.05, iteration_threshold=0.4, top_k_sentence=1),
    "hotpotqa": Config(max_iterations=3, passage_ratio=0.05, iteration_threshold=0.4, top_k_sentence=1),
}


def profile(name: str, **changes) -> Config:
    return replace(PROFILES[name], **changes)
