"""Indexing settings with their defaults and checks."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class IndexingConfig:
    # The defaults that results depend on.
    max_node_text_length: int = 8000
    summary_max_tokens: int = 200
    batch_summary_size: int = 10
    toc_scan_pages: int = 10
    min_toc_line_count: int = 3
    min_header_count: int = 3
    verification_sample_size: int = 3
    verification_accuracy_threshold: float = 0.7
    max_fix_attempts: int = 2
    max_extraction_retries: int = 2
    page_group_max_tokens: int = 4000
    page_group_overlap: int = 1
    fix_search_radius: int = 3
    summary_concurrency: int = 5
    embedding_concurrency: int = 3
    structure_detection_concurrency: int = 5

    def __post_init__(self):
        may_be_zero = {"max_fix_attempts", "max_extraction_retries", "page_group_overlap", "fix_search_radius"}
        for f in fields(self):
            value = getattr(self, f.name)
            if f.name == "verification_accuracy_threshold":
                if not 0.0 <= value <= 1.0:
                    raise ValueError(f"{f.name} must be between 0 and 1, was {value}")
            elif f.name in may_be_zero or f.name == "verification_sample_size":
                if value < (0 if f.name in may_be_zero else 1):
                    raise ValueError(f"{f.name} must not be negative, was {value}" if f.name in may_be_zero else f"{f.name} must be positive, was {value}")
            elif value < 1:
                raise ValueError(f"{f.name} must be positive, was {value}")


# Constants of ranking, batching and discovery.
BM25_K1, BM25_B, MIN_TOKEN = 1.2, 0.75, 2
RRF_K = 60
EMBED_BATCH = 50
CHARS_PER_TOKEN = 4
DISCOVERY_PAGES, DISCOVERY_MAX_RATIO = 5, 0.5
CACHE_SIZE = 256
MAX_NODES = 5
