"""Defaults of all engines, and their JSON form."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from pathlib import Path


@dataclass(frozen=True)
class Config:
    min_chunk_length: int = 20
    max_chunk_length: int = 5000
    sample_fraction: float | None = None
    semantic_threshold: float = 0.95
    short_term_ttl_days: int = 30
    web_cache_ttl_days: int = 7
    long_term_review_days: int = 90
    stale_threshold_days: int = 180
    fail_on_error: bool = False
    max_failures_listed: int = 50
    alert_threshold: float = 0.6
    quarantine_below: float = 0.3
    gibberish_above: float = 0.3

    @classmethod
    def from_file(cls, path: str | Path) -> Config:
        """A missing file gives the defaults; unknown keys are an error."""
        path = Path(path)
        return cls(**json.loads(path.read_text())) if path.exists() else cls()

    def save(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2))


DEFAULT = Config()
