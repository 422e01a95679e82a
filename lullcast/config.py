"""Settings of a run as frozen dataclasses, with nested or dotted overrides and parameter sweeps."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Classify:
    adi_min: float = 1.32
    cv2_min: float = 0.49
    min_nonzero: int = 2


@dataclass(frozen=True)
class Sample:
    size: int = 40
    seed: int = 42
    rule: str = "minimum"


@dataclass(frozen=True)
class Origins:
    count: int = 2
    val_days: int = 120
    test_days: int = 120


@dataclass(frozen=True)
class Policy:
    review: int = 1
    lead: int = 7
    warmup: int = 28
    rounding: str = "none"
    moq: float = 0.0
    start: str = "level"
    taus: tuple[float, ...] = (0.5, 0.7, 0.85, 0.95, 0.99)
    targets: tuple[float, ...] = (0.9, 0.95, 0.98)
    scenarios: tuple[tuple[float, float], ...] = ((5.0, 1.0), (10.0, 1.0), (20.0, 1.0))


@dataclass(frozen=True)
class Config:
    classify: Classify = field(default_factory=Classify)
    sample: Sample = field(default_factory=Sample)
    origins: Origins = field(default_factory=Origins)
    policy: Policy = field(default_factory=Policy)
    alpha: float = 0.1
    round_digits: int = 6

    def override(self, changes: dict[str, Any]) -> Config:
        """``{"policy.lead": 3}`` or ``{"policy": {"lead": 3}}``; an unknown key is an error."""
        return _replace(self, changes)


def _replace(part: Any, changes: dict[str, Any]) -> Any:
    nested: dict[str, Any] = {}
    for key, value in changes.items():
        head, _, rest = key.partition(".")
        if head not in {f.name for f in dataclasses.fields(part)}:
            raise KeyError(key)
        if rest or isinstance(value, dict):
            nested.setdefault(head, {}).update({rest: value} if rest else value)
        else:
            old = getattr(part, head)
            nested[head] = tuple(tuple(v) if isinstance(v, list) else v for v in value) if isinstance(old, tuple) else type(old)(value)
    made = {k: _replace(getattr(part, k), v) if isinstance(v, dict) and dataclasses.is_dataclass(getattr(part, k)) else v for k, v in nested.items()}
    return dataclasses.replace(part, **made)


def load(path: str | None = None) -> Config:
    """From a JSON file, or YAML where a parser is installed."""
    if path is None:
        return Config()
    with open(path) as f:
        if path.endswith(".json"):
            return Config().override(json.load(f))
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML settings need the yaml package") from e
        return Config().override(yaml.safe_load(f))


def cells(base: Config, overrides: list[dict[str, Any]]) -> list[tuple[str, Config]]:
    """A sweep: one full configuration for each set of overrides, with its name."""
    return [(o.get("name", f"cell{i}"), base.override({k: v for k, v in o.items() if k != "name"})) for i, o in enumerate(overrides)]
