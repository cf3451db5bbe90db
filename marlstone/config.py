"""Settings of the engine; validated on construction."""

from __future__ import annotations

from dataclasses import dataclass, field

# fixed values: authority of a document type, best first
AUTHORITY = {
    "Customs Act": 1.00, "Tariff Schedule": 0.95, "HSN Classification": 0.90, "Circular": 0.88, "Notification": 0.85,
    "Case Law": 0.75, "Trade Policy": 0.70, "BIS / Export Control": 0.65, "Other": 0.40,
}
# fixed values: output width of known embedding models
EMBEDDING_DIMENSIONS = {
    "nomic-embed-text": 768, "mxbai-embed-large": 1024, "all-minilm": 384, "bge-large": 1024, "text-embedding-3-small": 1536,
    "text-embedding-3-large": 3072, "text-embedding-ada-002": 1536, "models/embedding-001": 768, "models/text-embedding-004": 768,
}
DEFAULT_TYPE = "Other"


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 800
    chunk_overlap: int = 120
    min_chunk_chars: int = 120
    embed_batch: int = 32
    top_k: int = 6
    bm25_k: int = 10
    dense_weight: float = 0.75
    mmr_lambda: float = 0.95
    strong: float = 0.70
    weak: float = 0.45
    min_coverage: int = 3
    threshold: float = 0.90
    confidence_weights: tuple[float, float, float, float] = (0.45, 0.25, 0.20, 0.10)
    answer_weights: tuple[float, float, float, float] = (0.40, 0.30, 0.20, 0.10)
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25
    authority: dict[str, float] = field(default_factory=lambda: dict(AUTHORITY))

    def __post_init__(self):
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("the overlap must be smaller than the chunk size")
        if not 0 < self.top_k:
            raise ValueError("top_k must be positive")
        if not 0 <= self.dense_weight <= 1 or not 0 <= self.mmr_lambda <= 1:
            raise ValueError("weights lie between 0 and 1")
        if not 0 <= self.weak <= self.strong <= 1 or not 0 <= self.threshold <= 1:
            raise ValueError("need 0 <= weak <= strong <= 1 and a threshold between 0 and 1")
        if abs(sum(self.confidence_weights) - 1) > 1e-9 or abs(sum(self.answer_weights) - 1) > 1e-9:
            raise ValueError("weights must add up to 1")

    @property
    def fetch_k(self) -> int:
        """Candidates fetched for reranking."""
        return max(4 * self.top_k, 20)


SETTINGS = Settings()


def embedding_dimension(model: str) -> int:
    """Known width of a model; a miss is an error."""
    if model not in EMBEDDING_DIMENSIONS:
        raise ValueError(f"unknown embedding model: {model}")
    return EMBEDDING_DIMENSIONS[model]
