"""Settings from a YAML file and the command line, checked."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field, fields, replace

import yaml


@dataclass(frozen=True)
class Config:
    """t: pings a vessel keeps whole; clusters, samples: by level, from the rows up; target: rows to draw."""

    t: int = 250
    clip_seconds: int = 10
    since: str = "2019-01-01"
    gap_seconds: int = 600
    clusters: list[int] = field(default_factory=lambda: [6000, 400, 40, 10])
    samples: list[int] = field(default_factory=lambda: [2200, 8, 5, 2])
    target: int = 731_447
    source: str = ""
    dest: str = ""

    def __post_init__(self) -> None:
        if self.t < 1:
            raise ValueError("t must be 1 or more")
        if len(self.clusters) != len(self.samples):
            raise ValueError("clusters and samples need as many levels")


def load(path: str) -> Config:
    """Unknown keys are an error."""
    with open(path) as f:
        return Config(**(yaml.safe_load(f) or {}))


def parse(args: list[str] | None = None) -> Config:
    """--config FILE, and an option for each setting, which wins over the file."""
    p = argparse.ArgumentParser()
    p.add_argument("--config")
    for f in fields(Config):
        many = f.name in ("clusters", "samples")
        p.add_argument(f"--{f.name}", type=str if f.name in ("since", "source", "dest") else int, nargs="+" if many else None)
    told = vars(p.parse_args(args))
    base = load(told.pop("config")) if told["config"] else (told.pop("config"), Config())[1]
    return replace(base, **{k: v for k, v in told.items() if v is not None})
