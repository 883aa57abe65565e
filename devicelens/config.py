"""Settings of the operators (plain frozen dataclasses, no environment access)."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class SeverityProfile:
    """Inclusive lower bounds on |z| per severity."""

    low: float = 2.0
    medium: float = 2.5
    high: float = 3.0
    critical: float = 4.0


# The studied system ships two profiles: code defaults and deployment overrides.
CODE_PROFILE = SeverityProfile()
DEPLOYED_PROFILE = SeverityProfile(2.5, 3.0, 3.5, 4.0)


@dataclass(frozen=True)
class DetectorConfig:
    keys: tuple[str, ...] = ("device_id", "metric_type")
    window_s: int = 300
    min_samples: int = 10
    profile: SeverityProfile = CODE_PROFILE
    # A reading delivered twice (same value and time) counts once in the window.
    dedupe: bool = True
    # Time slots per window; see operators.rolling.
    slots: int = 10


@dataclass(frozen=True)
class GridConfig:
    """Evaluation grid of the series algebra."""

    step_s: int = 15
    range_s: int = 300
    short_range_s: int = 60
    offset_s: int = 900
    lookback_s: int = 300


@dataclass(frozen=True)
class RateLimits:
    window_s: int = 60
    limits: dict[str, int] = field(default_factory=lambda: {"ingestion": 1000, "query": 100})
    default_bucket: str = "query"


@dataclass(frozen=True)
class DiagnosisConfig:
    context_minutes: int = 30
    history_lines: int = 20
    top_k: int = 5
    chunk_size: int = 2048
    chunk_overlap: int = 200
    vector_dim: int = 64
