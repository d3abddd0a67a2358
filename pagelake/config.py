"""Settings: defaults, then the environment (PAGELAKE_*), then the command line."""

from __future__ import annotations

import argparse
import os
from collections.abc import Sequence
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    """Settings of a run; every one of them does something."""

    tables: str = ""
    output: str = ""
    query: str = "language_check"
    concurrency: int = 4
    retries: int = 2
    token_budget: int = 100_000

    def __post_init__(self):
        for name, low, high in (("concurrency", 1, 32), ("retries", 0, 5), ("token_budget", 1, 120_000)):
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} goes from {low} to {high}")


def load(argv: Sequence[str] | None = None, environ: dict[str, str] | None = None) -> Config:
    """Settings from ``argv`` before the environment before the defaults."""
    env = os.environ if environ is None else environ
    parser = argparse.ArgumentParser(prog="pagelake")
    for f in fields(Config):
        kind = type(f.default)
        parser.add_argument(f"--{f.name.replace('_', '-')}", type=kind, default=kind(env.get(f"PAGELAKE_{f.name.upper()}", f.default)))
    return Config(**vars(parser.parse_args(argv)))
