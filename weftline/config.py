"""Settings: where tables and files lie, which columns are typed, and how a run was trained."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

# Settings that a trained run hands on to its evaluation.
HANDED_ON = ("mask_stage", "height", "width")


def load_config(path: str) -> dict:
    """A JSON settings file, or YAML where a YAML package is installed. An empty file has no settings."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text) if text.strip() else {}
    import yaml

    return yaml.safe_load(text) or {}


def resolve(value: str | None, variable: str, base: str = ".") -> str | None:
    """An environment variable before the configured value before None; ``~`` is expanded, relative paths start at ``base``."""
    value = os.environ.get(variable) or value
    return os.path.normpath(os.path.join(base, os.path.expanduser(value))) if value else None


@dataclass(frozen=True)
class Roots:
    """Folders of a project. A root that isn't set is an error only when it is used."""

    raw: str | None = None
    cache: str | None = None
    stages: str | None = None
    missing: dict = field(default_factory=dict, compare=False)

    @classmethod
    def of(cls, config: Mapping, base: str = ".") -> Roots:
        p = config.get("paths") or {}
        return cls(resolve(p.get("raw_root"), "WEFTLINE_RAW_ROOT", base), resolve(p.get("cache_root"), "WEFTLINE_CACHE_ROOT", base), resolve(p.get("preproc_root"), "WEFTLINE_PREPROC_ROOT", base))

    def has(self, name: str) -> bool:
        return getattr(self, name) is not None

    def need(self, name: str) -> str:
        value = getattr(self, name)
        if value is None:
            raise RuntimeError(f"the {name} root is not set: give it in the settings or in the environment")
        return value

    def table(self, name: str) -> str:
        return f"{self.need('cache')}/{name}"

    def stage(self, name: str) -> str:
        return f"{self.need('stages')}/{name}"


def evaluation_settings(current: Mapping, snapshot: Mapping | None, trained: bool, mask_stage: str | None = None) -> tuple[dict, str]:
    """Settings for an evaluation and where they come from; the input isn't changed.

    | run | mask and size come from |
    |-|-|
    | untrained control | the current settings, or ``mask_stage`` if chosen |
    | trained, with a snapshot | the snapshot; choosing a mask is an error |
    | trained, without one | the current settings with the plain mask |
    """
    if trained and mask_stage:
        raise ValueError("a trained run keeps the mask it was trained with")
    chosen = {"mask_stage": mask_stage} if mask_stage else {}
    source, changes = {
        (False, False): ("untrained control", chosen),
        (False, True): ("untrained control", chosen),
        (True, False): ("no snapshot: plain mask", {"mask_stage": "agnostic"}),
        (True, True): ("snapshot of the run", {k: v for k, v in (snapshot or {}).items() if k in HANDED_ON}),
    }[trained, snapshot is not None]
    return {**current, **changes}, source


def mask_for_training(config: Mapping, stored: Callable[[str], bool]) -> str:
    """The configured mask stage, which must be one of the mask stages and must have been computed (``stored``): checked before anything is trained."""
    stage = config.get("mask_stage", "agnostic")
    if stage not in ("agnostic", "agnostic_refined"):
        raise ValueError(f"unknown mask stage {stage!r}")
    if not stored(stage):
        raise FileNotFoundError(f"mask stage {stage!r} hasn't been computed: run it before training")
    return stage
