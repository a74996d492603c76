"""Run parameters; every operator takes them as arguments, this is the default set."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    business_timezone: str = "Asia/Riyadh"
    fuzzy_match_function: str = "jaccard"
    fuzzy_match_threshold: float | None = 80.0
    disappearance_misses: int = 1
    recent_window_days: int = 7
    aggregator_campaign_coverage: float = 1.0
    ats_collapse_ratio: float = 0.5
    ats_collapse_min_postings: int = 10

    def __post_init__(self) -> None:
        if self.fuzzy_match_function not in ("jaccard", "jaro_winkler"):
            raise ValueError(f"fuzzy_match_function must be jaccard or jaro_winkler, not {self.fuzzy_match_function}")
