"""Score weights and run settings, checked when they are built."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from typing import Any

from cuematch import fixed_values as fv

_FLAT_PREFIX = {
    "final": "",
    "embedding": "emb_",
    "semantic": "sem_",
    "targets": "tgt_",
    "tag_selection": "tag_",
}


def check_weights(weights, name: str = "weights") -> None:
    """Raise ValueError unless the weights sum to 1 within 1e-6."""
    values = list(weights.values()) if isinstance(weights, Mapping) else list(weights)
    if abs(sum(values) - 1.0) > 1e-6:
        raise ValueError(f"{name} must sum to 1.0, got {sum(values):.8f}")


for _name in ("TAG_PROMPT_WEIGHTS", "ENSEMBLE_PROMPTS", "HYBRID_WEIGHTS"):
    check_weights(getattr(fv, _name), _name)


def _default_group(name: str):
    return field(default_factory=lambda: dict(fv.SCORE_WEIGHTS[name]))


@dataclass(frozen=True)
class ScoringWeights:
    """Five groups of score weights; each group must sum to 1."""

    final: Mapping[str, float] = _default_group("final")
    embedding: Mapping[str, float] = _default_group("embedding")
    semantic: Mapping[str, float] = _default_group("semantic")
    targets: Mapping[str, float] = _default_group("targets")
    tag_selection: Mapping[str, float] = _default_group("tag_selection")

    def __post_init__(self) -> None:
        for group, known in fv.SCORE_WEIGHTS.items():
            given = getattr(self, group)
            unknown = set(given) - set(known)
            if unknown:
                raise ValueError(f"unknown {group} weights: {sorted(unknown)}")
            full = {key: float(given.get(key, default)) for key, default in known.items()}
            check_weights(full, f"{group} weights")
            object.__setattr__(self, group, full)

    @classmethod
    def from_mapping(cls, spec: Mapping[str, Any]) -> "ScoringWeights":
        """Accept nested groups, flat names (``emb_main``), or a mix of both."""
        groups: dict[str, dict[str, float]] = {group: {} for group in fv.SCORE_WEIGHTS}
        for group, known in fv.SCORE_WEIGHTS.items():
            nested = spec.get(group)
            if isinstance(nested, Mapping):
                groups[group].update(nested)
            if group == "final" and "final" in spec:
                continue
            for key in known:
                flat = spec.get(_FLAT_PREFIX[group] + key)
                if flat is not None and not isinstance(flat, Mapping):
                    groups[group][key] = float(flat)
        return cls(**groups)

    def nested(self) -> dict[str, dict[str, float]]:
        return {group: dict(getattr(self, group)) for group in fv.SCORE_WEIGHTS}

    def flat(self) -> dict[str, float]:
        return {
            _FLAT_PREFIX[group] + key: value
            for group, values in self.nested().items()
            for key, value in values.items()
        }


@dataclass(frozen=True)
class MatchConfig:
    """Settings of a matching run."""

    rank_top_n: int = 10
    preview_top_n: int = 5
    candidate_pool_hybrid: int = 150
    candidate_pool_ensemble: int = 60
    candidate_union_limit: int = 180
    enable_audio_aux: bool = True
    strict_dialogue_safe: bool = True
    style_duplicate_limit: int = 2
    low_confidence_threshold: float = fv.LOW_FINAL
    weights: ScoringWeights = field(default_factory=ScoringWeights)
    # Scene vectors are sent to every task up to this size; beyond it the
    # search runs once per slice of the queries (see operators/retrieval.py).
    broadcast_limit_bytes: int = 64 << 20

    def __post_init__(self) -> None:
        for name in ("rank_top_n", "preview_top_n", "candidate_pool_hybrid",
                     "candidate_pool_ensemble", "candidate_union_limit"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")

    @classmethod
    def from_options(cls, options: Mapping[str, Any]) -> "MatchConfig":
        """Build from string or typed options; names are case-insensitive."""
        lowered = {str(key).lower(): value for key, value in options.items()}
        values: dict[str, Any] = {}
        for spec in fields(cls):
            if spec.name not in lowered:
                continue
            raw = lowered[spec.name]
            if spec.name == "weights":
                values["weights"] = (
                    raw if isinstance(raw, ScoringWeights) else ScoringWeights.from_mapping(raw)
                )
            elif spec.type == "bool":
                values[spec.name] = raw if isinstance(raw, bool) else str(raw) == "1"
            elif spec.type == "float":
                values[spec.name] = float(raw)
            else:
                values[spec.name] = int(raw)
        return cls(**values)
