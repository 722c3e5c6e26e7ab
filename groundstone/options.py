"""Settings that change results, in one frozen record passed explicitly."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    """Defaults are the published ones; every query takes an ``Options``."""

    max_extraction_tokens: int = 900
    chars_per_token: float = 4.0
    retrieval_window: int = 900
    retrieval_overlap: int = 150
    min_chunk_chars: int = 80
    min_numeric_density: float = 0.02
    similarity_threshold: float = 0.82
    candidate_top_k: int = 6
    tolerance: float = 0.01
    min_quote_chars: int = 12
    max_span_chars: int = 240
    max_facts_per_chunk: int = 12
    min_table_lines: int = 4
    parser_version: str = "1"
    seconds_per_chunk: float = 0.02

    @property
    def max_extraction_chars(self) -> int:
        return int(self.max_extraction_tokens * self.chars_per_token)


DEFAULTS = Options()
