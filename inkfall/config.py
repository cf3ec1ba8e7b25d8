"""Settings of search, chunking, retrieval and guardrails, as one frozen value."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # search
    page_size: int = 20
    max_page_size: int = 100
    snippet_chars: int = 150
    tag: str = "mark"
    # chunks, in tokens of four characters
    chunk_tokens: int = 500
    overlap_tokens: int = 50
    min_tokens: int = 100
    chars_per_token: int = 4
    dim: int = 768
    # retrieval
    top_k: int = 5
    keyword_weight: float = 0.3
    vector_weight: float = 0.7
    max_context_tokens: int = 4000
    # guardrails
    max_file_bytes: int = 500 * 1024 * 1024
    max_pages: int = 1000
    max_chars: int = 10_000_000
    max_tokens: int = 2_000_000
    max_chunks: int = 5000
    max_chunks_per_page: int = 100
    max_seconds: float = 300
    max_sheets: int = 50
    max_rows_per_sheet: int = 100_000
    max_ocr_pages: int = 200
    max_cost_usd: float = 1.0


DEFAULTS = Settings()
