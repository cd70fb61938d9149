"""Settings of retrieval, and the options of a query."""

from __future__ import annotations

from dataclasses import dataclass, fields

from brindle.errors import ValidationError


def _check(ok: bool, message: str) -> None:
    if not ok:
        raise ValidationError(message)


@dataclass(frozen=True)
class RetrievalConfig:
    """Defaults are the deployed ones. ``expansion_score_cap`` None: no cap."""

    vector_top_k: int = 5
    graph_top_k: int = 5
    alpha: float = 0.5
    beta: float = 0.5
    normalise: bool = True
    chunking: str = "recursive"
    chunk_size: int = 400
    chunk_overlap: int = 50
    embedding_dim: int = 32
    expansion: str = "greedy"
    expand_per_term_limit: int = 2
    max_expanded_terms: int = 10
    direct_hit_weight: float = 1.0
    expanded_hit_weight: float = 0.5
    expansion_score_cap: float | None = 2.0

    def __post_init__(self):
        for name in ("chunking", "expansion"):
            object.__setattr__(self, name, str(getattr(self, name)).strip().lower())
        _check(self.chunking in ("fixed", "recursive"), "chunking must be fixed or recursive")
        _check(self.expansion in ("greedy", "ranked"), "expansion must be greedy or ranked")
        _check(self.chunk_size > 0, "chunk_size must be > 0")
        _check(0 <= self.chunk_overlap < self.chunk_size, "chunk_overlap must be >= 0 and < chunk_size")
        for name in ("vector_top_k", "graph_top_k", "expand_per_term_limit", "max_expanded_terms", "embedding_dim"):
            _check(getattr(self, name) >= 1, f"{name} must be >= 1")
        _check(self.direct_hit_weight > 0, "direct_hit_weight must be > 0")
        _check(0 <= self.expanded_hit_weight <= self.direct_hit_weight, "expanded_hit_weight must be >= 0 and <= direct_hit_weight")
        _check(self.expansion_score_cap is None or self.expansion_score_cap >= 0, "expansion_score_cap must be >= 0")

    @property
    def formula(self) -> str:
        expanded = "sum(expanded_edge_weight * expanded_hit_weight)"
        if self.expansion_score_cap is not None:
            expanded = f"min({expanded}, {self.expansion_score_cap})"
        return f"score = direct_hit_count * direct_hit_weight + {expanded}"


@dataclass(frozen=True)
class QueryOptions:
    """``top_k`` None: each side's default. ``min_score`` None: no threshold."""

    top_k: int | None = None
    min_score: float | None = None
    enable_vector: bool = True
    enable_graph: bool = True

    def __post_init__(self):
        _check(self.top_k is None or self.top_k >= 1, "top_k must be >= 1")
        _check(self.min_score is None or self.min_score >= 0, "min_score must be >= 0")
        _check(self.enable_vector or self.enable_graph, "vector or graph must be enabled")

    @classmethod
    def merged(cls, options: QueryOptions | None = None, **explicit) -> QueryOptions:
        """Explicit arguments that aren't None, over ``options``, over the defaults."""
        base = options or cls()
        return cls(**{f.name: explicit[f.name] if explicit.get(f.name) is not None else getattr(base, f.name) for f in fields(cls)})

    def ks(self, cfg: RetrievalConfig) -> tuple[int, int, int]:
        """Results of the vector side, the graph side, and in the end."""
        return self.top_k or cfg.vector_top_k, self.top_k or cfg.graph_top_k, self.top_k or cfg.vector_top_k


@dataclass(frozen=True)
class SearchOptions:
    filter_doc_id: str | None = None
    min_score: float | None = None

    @classmethod
    def merged(cls, options: SearchOptions | None = None, filter_doc_id: str | None = None, min_score: float | None = None) -> SearchOptions:
        base = options or cls()
        return cls(filter_doc_id if filter_doc_id is not None else base.filter_doc_id, min_score if min_score is not None else base.min_score)
