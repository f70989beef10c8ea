"""Operator settings. Each operator takes one of these; the defaults are the working defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class DedupOptions:
    title_window_days: int = 7

    def __post_init__(self) -> None:
        if self.title_window_days < 1:
            raise ValueError("title_window_days must be at least 1")


@dataclass(frozen=True)
class GroupingOptions:
    window_hours: int = 168
    # How many of the newest candidates an item is compared with; None means all of them.
    max_comparisons: int | None = None
    merge_threshold: float = 0.78
    max_attempts: int = 5

    def __post_init__(self) -> None:
        capped = self.max_comparisons is not None and self.max_comparisons < 1
        if self.window_hours < 1 or capped or self.max_attempts < 1:
            raise ValueError("window_hours, max_comparisons and max_attempts must be positive")
        if not 0.0 < self.merge_threshold <= 1.0:
            raise ValueError("merge_threshold must lie in (0, 1]")


@dataclass(frozen=True)
class ScoringOptions:
    high_weight: float = 60.0
    medium_weight: float = 40.0
    low_weight: float = 20.0
    extra_points: float = 5.0
    extra_cap: float = 10.0
    recent_hours: int = 24
    recent_points: float = 20.0
    days_hours: int = 72
    days_points: float = 12.0
    week_hours: int = 168
    week_points: float = 5.0
    impact_high: float = 20.0
    impact_medium: float = 10.0
    two_hosts: float = 4.0
    three_hosts: float = 7.0
    threshold: float = 55.0


@dataclass(frozen=True)
class BriefOptions:
    max_items: int = 5
    lookback_days: int = 7

    def __post_init__(self) -> None:
        if self.max_items < 1 or self.lookback_days < 1:
            raise ValueError("max_items and lookback_days must be positive")
