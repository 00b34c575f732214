"""Types, constants and settings that decide results."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

# Fixed values.
NODE_TYPES = ("TASK", "SKILL", "EVENT", "KNOWLEDGE", "STATUS", "TOPIC", "SESSION")
SEMANTIC_TYPES = ("TASK", "SKILL", "EVENT", "KNOWLEDGE", "STATUS")
CHAT_TYPES = ("direct", "group", "channel", "explicit")
TIERS = {"scope_hot": 6, "hot": 5, "active": 4, "L1": 3, "L2": 2, "L3": 1, "filtered": 0}
BELONGS, CONTAINS, PARENT = "主题属于", "主题包含", "主题父级"
IMPORTANCE = {"SKILL": 0.9, "TOPIC": 0.85, "KNOWLEDGE": 0.7, "TASK": 0.6, "EVENT": 0.5, "STATUS": 0.3}
FLOOR = {"STATUS": 0.1, "TASK": 0.25, "EVENT": 0.2, "KNOWLEDGE": 0.45, "SKILL": 0.6, "TOPIC": 0.55, "SESSION": 0.1}
BETA = {"STATUS": 1.3, "TASK": 1.0, "EVENT": 0.9, "KNOWLEDGE": 0.85, "SKILL": 0.8, "TOPIC": 0.8}
OTHER_IMPORTANCE, OTHER_FLOOR, OTHER_BETA = 0.5, 0.2, 1.0
DAY_MS = 86_400_000


# Fixed values.
@dataclass(frozen=True)
class Decay:
    half_life_days: float = 30.0
    recency: float = 0.4
    frequency: float = 0.3
    intrinsic: float = 0.3
    mu: float = 1.5
    stale_below: float = 0.3
    boost_min: float = 0.3


# The defaults, and below them the ranges.
@dataclass(frozen=True)
class Config:
    """Settings with their defaults; ``of`` reads raw values and keeps them in range."""

    enabled: bool = True
    recall_enabled: bool = True
    extraction_enabled: bool = True
    allowed_chat_types: tuple[str, ...] = CHAT_TYPES
    allowed_chat_ids: tuple[str, ...] = ()
    denied_chat_ids: tuple[str, ...] = ()
    recall_timeout_ms: int = 20_000
    recall_cache_ttl_ms: int = 15_000
    breaker_max_timeouts: int = 3
    breaker_cooldown_ms: int = 60_000
    recall_max_nodes: int = 15
    recall_max_depth: int = 2
    walk_max_nodes: int = 1500
    min_score: float = 0.35
    damping: float = 0.85
    iterations: int = 20
    dedup_threshold: float = 0.90
    dedup_max_pending: int = 2000
    dedup_max_pairs: int = 1000
    dedup_max_merges: int = 200
    retention_batch: int = 20_000
    compact_max: int = 100
    compact_enabled: bool = False
    decay_enabled: bool = True
    decay: Decay = Decay()

    #: Least and greatest value of the settings that are clamped to whole numbers.
    RANGES = {
        "recall_timeout_ms": (50, 120_000),
        "recall_cache_ttl_ms": (0, 120_000),
        "breaker_max_timeouts": (1, 20),
        "breaker_cooldown_ms": (1_000, 600_000),
        "dedup_max_merges": (0, 100_000),
        "dedup_max_pairs": (0, 10_000_000),
        "dedup_max_pending": (0, 100_000),
        "compact_max": (0, 10_000),
    }

    @classmethod
    def of(cls, raw: dict) -> Config:
        known = {f.name: f.default for f in fields(cls)}
        out = {k: v for k, v in raw.items() if k in known}
        for name, (low, high) in cls.RANGES.items():
            out[name] = clamp(raw.get(name), known[name], low, high)
        for name in ("enabled", "recall_enabled", "extraction_enabled"):
            out[name] = raw.get(name) is not False
        out["compact_enabled"] = raw.get("compact_enabled") is True
        for name in ("allowed_chat_ids", "denied_chat_ids"):
            out[name] = names(raw.get(name))
        kinds = raw.get("allowed_chat_types")
        kinds = tuple(dict.fromkeys(k for k in kinds if k in CHAT_TYPES)) if isinstance(kinds, (list, tuple)) else CHAT_TYPES
        out["allowed_chat_types"] = kinds or CHAT_TYPES
        return cls(**out)


def clamp(value: object, otherwise: int, low: int, high: int) -> int:
    """value as a whole number within the range; what isn't a finite number gives otherwise."""
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        return otherwise
    try:
        number = float(value)
    except ValueError:
        return otherwise
    return max(low, min(high, math.floor(number))) if math.isfinite(number) else otherwise


def names(values: object) -> tuple[str, ...]:
    """Distinct trimmed lower-case strings, in order."""
    if not isinstance(values, (list, tuple)):
        return ()
    return tuple(dict.fromkeys(t for v in values if isinstance(v, str) and (t := v.strip().lower())))
