"""Run settings: one typed object in place of prompts on a console and scattered environment variables."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields

from quillon.functions.labels import FLOORS


@dataclass
class Config:
    """Defaults, overridden by `QUILLON_<FIELD>` in the environment, overridden by arguments of `load`."""

    results: str = "results"
    checkpoints: str = "checkpoints"
    exploratory_runs: int = 5
    longitudinal_runs: int = 5
    seed: int = 42
    heldout_share: float = 0.2
    bootstrap_resamples: int = 1000
    sample_cap: int = 100
    keep_noncore: bool = False
    models: tuple[str, ...] = ()
    floors: dict[str, float] = field(default_factory=lambda: dict(FLOORS["core"]))

    @classmethod
    def load(cls, **given) -> Config:
        values = {}
        for f in fields(cls):
            raw = os.environ.get(f"QUILLON_{f.name.upper()}")
            if raw is not None and f.name != "floors":
                kind = type(getattr(cls(), f.name))
                values[f.name] = raw.strip().lower() in ("true", "1", "yes", "y") if kind is bool else tuple(x for x in raw.split(",") if x) if kind is tuple else kind(raw)
        return cls(**(values | given))
