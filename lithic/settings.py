"""Defaults that change results, in one place. Fixed values."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    max_page_mb: int = 10
    max_links_per_page: int = 2000
    max_depth: int = 3
    dedup_ttl_hours: int = 6
    oversized_days: int = 30
    breaker_open_seconds: int = 30
    query_chars: int = 200
    min_text_chars: int = 20
    embed_batch: int = 100
    embed_model: str = "offline-64"
    cache_hours: int = 24
    redelivery_minutes: int = 10
    daily_hour: int = 6
    rewrite_seconds: float = 3.0
    answer_seconds: float = 12.0
    interactive_seconds: float = 20.0
    batch_seconds: float = 60.0
    queue_capacity: int = 100_000
    listed_entities: int = 5
    index_chars: int = 500_000
    model_chars: int = 8_000
    embed_chars: int = 50_000
    chunk_tokens: int = 512
    chunk_overlap_percent: int = 15
    min_score: float = 0.45
    min_entity_confidence: float = 0.7
    max_entities: int = 200
    diff_min_chars: int = 40
    diff_max_chars: int = 4_000
    rrf_k: int = 60
    snippet_chars: int = 240
    overfetch: int = 10
    max_pool: int = 500
    max_page_size: int = 100
    context_chars: int = 12_000
    chat_sources: int = 8
    question_chars: int = 1_000
    prompt_reserve_tokens: int = 1_000
    max_ai_attempts: int = 5
    ai_batch: int = 20
    max_summary_attempts: int = 3
    quota_margin_percent: int = 5
    batch_reserve_percent: int = 30
    max_escalations: int = 2
    breaker_failures: int = 3
    change_window_days: int = 30
    agent_sources: int = 20


DEFAULTS = Settings()


def parse(lines: list[str], defaults: Settings = DEFAULTS) -> Settings:
    """Settings from lines of ``name: value``: names of blocks are passed over, dashes count as underscores, # starts a
    comment. What is not named keeps its default; a name that is none, or a value of another type, is an error."""
    kinds = {f.name: type(getattr(defaults, f.name)) for f in fields(defaults)}
    found: dict[str, object] = {}
    for line in lines:
        name, _, value = line.split("#", 1)[0].partition(":")
        name, value = name.strip().replace("-", "_"), value.strip().strip("\"'")
        if not name or not value:
            continue
        if name not in kinds:
            raise ValueError(f"unknown setting {name}")
        found[name] = kinds[name](value)
    return replace(defaults, **found)


def load(path: str) -> Settings:
    """Settings of a file; every one has a default, so a file that is not there gives the defaults."""
    try:
        with open(path, encoding="utf-8") as lines:
            return parse(list(lines))
    except FileNotFoundError:
        return DEFAULTS


#: The categories a page can have.
CATEGORIES = ("marketplace", "forum", "blog", "service", "institutional", "other")
