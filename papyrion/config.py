"""Settings of chunking, caching and retrieval."""

from __future__ import annotations

from dataclasses import dataclass, replace

STRATEGIES = ("hybrid", "semantic", "fixed")


@dataclass(frozen=True)
class ChunkConfig:
    """How pages become chunks; lengths are in code points.

    ``overlap_zero`` says what an overlap of 0 means: with ``compat`` the whole
    chunk before is put in front and an empty line behind, with ``off`` nothing is added.
    """

    strategy: str = "hybrid"
    size: int = 1000
    overlap: int = 100
    buffer: int = 1
    threshold: float = 85
    min_size: int = 200
    max_size: int = 1500
    hybrid_pages: int = 5
    overlap_zero: str = "compat"
    #: Names the embedder in strict cache keys; the class of the embedder where it is not given.
    embedder: str | None = None

    def __post_init__(self):
        if not 0 <= self.overlap < self.size:
            raise ValueError("overlap must be at least 0 and below size")
        if self.size < 2 or self.min_size > self.max_size or self.buffer < 0 or not 0 <= self.threshold <= 100:
            raise ValueError("sizes, buffer or threshold out of range")
        if self.overlap_zero not in ("compat", "off"):
            raise ValueError("overlap_zero is compat or off")


def chunk_config(strategy: str = "hybrid", **settings) -> ChunkConfig:
    """A configuration by name of strategy; an unknown name means fixed chunks."""
    return replace(ChunkConfig(strategy=strategy), **settings)


@dataclass(frozen=True)
class RetrievalConfig:
    k: int = 5
    metric: str = "l2"
    #: Rows of one block of vectors, and of queries, that a task compares at once.
    block: int = 4096
