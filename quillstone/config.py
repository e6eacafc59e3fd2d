"""Thresholds and settings, from code or from ``QUILLSTONE_*`` environment variables."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class DecisionThresholds:
    """Limits of the decision ladder."""

    accepted_min_score: float = 0.72
    accepted_max_uncertainty: float = 0.28
    review_max_uncertainty: float = 0.62
    illegible_min_visual: float = 0.28
    consensus_min_support: int = 1
    high_risk_accepted_min_score: float = 0.82
    high_risk_max_uncertainty: float = 0.22
    max_ensemble_disagreement_accept: float = 0.40
    max_cross_model_accept: float = 0.35
    min_variant_agreement_accept: float = 0.5
    crossed_out_threshold: float = 0.55
    require_trocr_for_accepted: bool = True
    paddle_only_max_state: str = "REVIEW_REQUIRED"

    def as_numbers(self) -> dict[str, float]:
        """The limits that are numbers or switches, as a record of a decision keeps them."""
        return {f.name: float(getattr(self, f.name)) for f in fields(self) if not isinstance(getattr(self, f.name), str)}


@dataclass(frozen=True)
class BoxThresholds:
    """Limits of the geometry checks."""

    max_area_ratio: float = 0.22
    max_height_ratio: float = 0.18
    max_aspect_tall: float = 0.55
    min_line_height_px: float = 8.0
    max_line_height_px: float = 140.0
    min_width_px: float = 12.0
    min_ink_ratio: float = 0.004
    max_projected_lines: int = 2
    tiny_upscale_limit: float = 3.5
    target_height: int = 80


@dataclass(frozen=True)
class RerankSettings:
    max_token_distance: float = 0.18
    min_fuzz_score: float = 88.0
    lexicon_enabled: bool = True


def from_env(kind: type, prefix: str = "QUILLSTONE_"):
    """An instance of ``kind`` whose fields the environment may override."""
    given = {}
    for f in fields(kind):
        raw = os.getenv(prefix + f.name.upper())
        if raw is not None:
            default = getattr(kind(), f.name)
            given[f.name] = raw.lower() in ("1", "true", "yes") if isinstance(default, bool) else type(default)(raw)
    return kind(**given)
