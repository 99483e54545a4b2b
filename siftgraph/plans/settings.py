"""Settings of a run: explicit values over the environment over a preset over the defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace

# The presets' graph node cap, pivots a domain and pending-queue cap.
PRESETS = {"low": {"node_cap": 50, "pivot_top_k": 3}, "medium": {"node_cap": 250, "pivot_top_k": 5}, "max": {"node_cap": 2000, "pivot_top_k": 8}, "quick": {"queue_cap": 300}, "deep": {"queue_cap": 5000}}


@dataclass(frozen=True)
class RunSettings:
    node_cap: int = 500
    pivot_top_k: int = 5
    queue_cap: int = 300
    max_depth: int = 1
    max_calls: int = 500
    max_units: float = 0.0
    cache_hours: float = 168.0
    model_calls: int = 50
    model_input_tokens: int = 200_000
    model_output_tokens: int = 25_600
    paid_approved: bool = False


def resolve(preset: str | None = None, prefix: str = "SIFTGRAPH_", env: dict[str, str] | None = None, **given) -> RunSettings:
    """``given`` wins over the environment, which wins over the preset. Bad values and unknown names raise."""
    if preset is not None and preset not in PRESETS:
        raise ValueError(f"unknown preset: {preset}")
    out = replace(RunSettings(), **PRESETS.get(preset, {}))
    source = os.environ if env is None else env
    for f in fields(RunSettings):
        if (raw := source.get(prefix + f.name.upper())) is not None:
            kind = type(getattr(out, f.name))
            out = replace(out, **{f.name: raw.lower() in ("1", "true", "yes") if kind is bool else kind(raw)})
    return replace(out, **{k: v for k, v in given.items() if v is not None})
