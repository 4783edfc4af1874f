"""Tunables of the engine, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    # near-duplicates
    permutations: int = 128
    bands: int = 16
    shingle: int = 4
    jaccard: float = 0.7
    url_jaccard: float = 0.2
    dedup_ttl_s: int = 86_400
    # automation
    velocity_window_s: int = 3600
    velocity_full: int = 15
    self_dup_ttl_s: int = 86_400
    url_cap: float = 0.3
    hashtag_cap: float = 0.4
    caps_cap: float = 0.6
    prefix_words: int = 3
    suffix_words: int = 2
    template_ttl_s: int = 86_400
    template_full: int = 5
    weights: tuple[float, float, float, float] = (0.30, 0.25, 0.20, 0.25)
    bot_threshold: float = 0.5
    # topicality
    top_k: int = 3
    length_power: float = 0.3
    burst_full: int = 5
    burst_boost: float = 1.0
    burst_ttl_s: int = 10_800
    entity_chars: int = 100
    # ranking
    positivity: float = 0.3
    half_life_h: float = 12.0
    window_h: int = 72
    pool: int = 2000
    mmr_lambda: float = 0.7
    similarity_mix: float = 0.5
    least_decay: float = 1e-30
    # coordinated networks
    least_accounts: int = 5
    most_days: int = 14
    least_posts: int = 50
    # other
    retention_h: int = 24
    pipeline_version: str = "v3"
    batch: int = 500
    recheck_batch: int = 500
    language_confidence: float = 0.3
    devalue: float = 0.4
    lookup_batch: int = 25
    feed_limit: int = 20
    feed_limit_most: int = 100
    category_threshold: float = 0.65
    adult_labels: tuple[str, ...] = ("porn", "sexual", "graphic-media", "nudity")
    categories: tuple[str, ...] = field(default=("science_technology", "arts_culture", "food_dining", "diaries_daily_life"))

    def __post_init__(self):
        if self.dedup_ttl_s < self.retention_h * 3600:
            raise ValueError("duplicates must be remembered at least as long as posts are kept")


DEFAULT = Config()


def number(value: str | None, default: float) -> float:
    """A setting as a number; blank or not a number gives the default."""
    try:
        x = float(value) if value is not None and value.strip() else default
    except ValueError:
        return default
    return default if x != x else x
