"""Run configurations: nested values in which {"_target_": "package.name", ...} stands for what that callable makes of the rest."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from importlib import import_module
from pathlib import Path


def instantiate(value: object) -> object:
    """value with every object that has a _target_ replaced by the target called with its other entries, from the inside out."""
    if isinstance(value, list):
        return [instantiate(x) for x in value]
    if not isinstance(value, dict):
        return value
    made = {k: instantiate(v) for k, v in value.items() if k != "_target_"}
    if "_target_" not in value:
        return made
    module, _, name = str(value["_target_"]).rpartition(".")
    return getattr(import_module(module), name)(**made)


@dataclass
class RunConfig:
    """What a run evaluates: where the tables are, which queries, and the models it plugs in."""

    sf_dir: str
    queries: list[str]
    models: dict[str, object] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> RunConfig:
        """From a JSON file; the models are instantiated."""
        return cls(**instantiate(json.loads(Path(path).read_text())))
